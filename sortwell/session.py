"""Session helpers: reading tables and writing intermediate tables that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()

#: Bytes of a table, by Spark's estimate, up to which it may be dealt to all cores by a shuffle.
SMALL = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def evenly(df: DataFrame) -> DataFrame:
    """An input of at most ``SMALL`` bytes, perhaps a single row group, dealt to all cores.

    It moves ``SMALL`` bytes at most, whatever the cluster. A larger input is split by
    the reader (``spark.sql.files.maxPartitionBytes``) and never shuffled here. Rows
    are the same either way.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Where none is named, a local session gets a fresh temporary folder; on a cluster
    that is an error, since executors couldn't see the driver's folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, which ``sweep`` deletes."""
    path = f"{shared_dir(spark)}/sortwell-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(sweep)
    _written.append((spark, path))
    return path


def settle(df: DataFrame, what: str = "step") -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    It cuts lineage like ``checkpoint()`` but computes the plan once, keeps column
    pruning for later readers, and survives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files behind a settled table that nothing will read again."""
    known = {path for _, path in _written}
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        for spark, path in list(_written):
            if path in known and folder.endswith(path.rsplit("/", 1)[1]):
                _delete(spark, path)
                _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def sweep() -> None:
    """Delete all settled tables. It runs at exit; long sessions call it between queries whose results are written."""
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)
    _written.clear()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)


def map_arrow(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` by functions of this package."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)
