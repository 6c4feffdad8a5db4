"""Vectors of images from a pluggable model, with histogram features where it fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortwell.functions.rasters import color_histogram, raster
from sortwell.session import map_arrow

#: A model takes a list of BGR rasters and gives one vector for each.
Model = Callable[[list[np.ndarray]], np.ndarray]


def embed(images: DataFrame, load: Callable[[], Model], method: str, batch_size: int = 32) -> DataFrame:
    """``embed_chain`` with one model."""
    return embed_chain(images, {method: load}, batch_size)


def embed_chain(images: DataFrame, models: dict[str, Callable[[], Model]], batch_size: int = 32) -> DataFrame:
    """``images`` (height, width, channels, data and others) with ``embedding`` and ``embedding_method`` instead of data.

    Models are tried in order: images on which one fails go to the next, and from
    the last to histogram features, so every decoded image has a vector. The method is
    kept by row, so vectors of different kinds can be kept apart. A batch that fails is
    tried image by image. A model is made once in each task, when it is first needed;
    one that can't be made is passed over. Vectors are brought to length one; an image
    that was not decoded gets null.
    """
    keep = [c for c in images.columns if c != "data"]
    packed = images.select(F.struct(*keep).alias("row"), "height", "width", "channels", "data")
    schema = T.StructType([packed.schema["row"], T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("embedding_method", T.StringType())])

    def unit(v: np.ndarray) -> list[float]:
        n = np.linalg.norm(v)
        return (v / n if n > 0 else v).astype(np.float32).tolist()

    def tried(model: Model, there: list[np.ndarray]) -> list[list[float] | None]:
        """A vector for each image, null where the model fails; it may fail a batch for one bad image."""
        try:
            return [unit(v) for v in np.asarray(model(there))]
        except Exception:  # whatever a model raises on an image, the run goes on
            return [None] if len(there) == 1 else [v for m in there for v in tried(model, [m])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, Model | None] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, batch_size):
                batch = whole.slice(at, batch_size)
                read = [None if d is None else raster(d, h, w, c) for h, w, c, d in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)]
                out: list[tuple] = [(None, None)] * len(read)
                left = [i for i, m in enumerate(read) if m is not None]
                for method, load in models.items():
                    if left and method not in made:
                        try:
                            made[method] = load()
                        except Exception:  # its files or libraries are missing here
                            made[method] = None
                    if left and made[method] is not None:
                        for i, v in zip(left, tried(made[method], [read[i] for i in left]), strict=True):
                            if v is not None:
                                out[i] = (v, method)
                        left = [i for i in left if out[i][0] is None]
                for i in left:
                    out[i] = (unit(color_histogram(read[i].astype(np.int64))), "histogram")
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v for v, _ in out], pa.list_(pa.float32())), pa.array([k for _, k in out], pa.string())], names=["row", "embedding", "embedding_method"])

    return map_arrow(packed, run, schema).select("row.*", "embedding", "embedding_method")
