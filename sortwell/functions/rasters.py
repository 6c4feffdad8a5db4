"""The few measures of a decoded image that need its pixels, per Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sortwell.session import map_arrow


def raster(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels as height x width x 3, blue first."""
    m = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(m, 3, axis=2) if channels == 1 else m[:, :, :3]


def gray_of(bgr: np.ndarray) -> np.ndarray:
    return bgr.astype(np.float64) @ (0.114, 0.587, 0.299)  # fixed values


def thumbnail(gray: np.ndarray, size: int = 8) -> list[float]:
    """Means of ``size`` x ``size`` blocks, row by row."""
    at = lambda n: np.arange(size) * n // size
    wide = np.pad(gray, [(0, max(0, size - n)) for n in gray.shape], mode="edge")
    sums = np.add.reduceat(np.add.reduceat(wide, at(wide.shape[0]), axis=0), at(wide.shape[1]), axis=1)
    return (sums / np.outer(*(np.diff(at(n), append=n) for n in wide.shape))).ravel().tolist()


def color_histogram(bgr: np.ndarray, bins: int = 32) -> np.ndarray:
    """Shares of pixels in equal bins of each channel."""
    counts = [np.bincount(bgr[:, :, c].ravel() * bins // 256, minlength=bins) for c in range(3)]
    return np.concatenate(counts) / max(1, bgr.shape[0] * bgr.shape[1])


def image_measures(images: DataFrame) -> DataFrame:
    """``images`` (height, width, channels, data and others) with ``thumb, histogram, sharpness, resolution`` instead of data; nulls for a null image."""
    packed = images.select(F.struct(*[c for c in images.columns if c != "data"]).alias("row"), "height", "width", "channels", "data")
    numbers = T.ArrayType(T.DoubleType())
    schema = T.StructType([packed.schema["row"], T.StructField("thumb", numbers), T.StructField("histogram", numbers), T.StructField("sharpness", T.DoubleType())])

    def measured(h, w, c, data):
        if data is None:
            return None, None, None
        m = raster(data, h, w, c)
        g = gray_of(m)
        steps = [np.abs(np.diff(g, axis=k)).mean() for k in (0, 1) if g.shape[k] > 1]
        return thumbnail(g), color_histogram(m.astype(np.int64)).tolist(), float(np.mean(steps)) if steps else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [measured(*r) for r in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)]
            kinds = (pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)]], names=["row", "thumb", "histogram", "sharpness"])

    return map_arrow(packed, run, schema).select("row.*", "thumb", "histogram", "sharpness").withColumn("resolution", F.col("height").cast("double") * F.col("width"))
