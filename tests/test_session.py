"""Session helpers."""

import pytest

from sortwell import session


def test_only_small_inputs_are_dealt(spark, monkeypatch, tmp_path):
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    cores = spark.sparkContext.defaultParallelism
    assert session.evenly(df).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "SMALL", 100)
    assert session.evenly(df).rdd.getNumPartitions() == 1


def test_a_cluster_has_to_name_its_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())
    Session.conf.get = staticmethod(lambda name, default=None: "hdfs:///shared")
    assert session.shared_dir(Session()) == "hdfs:///shared"


def test_settled_tables_are_released(spark):
    before = list(session._written)
    a, b = session.settle(spark.range(5)), session.settle(spark.range(7))
    session.release(a)
    assert b.count() == 7 and len(session._written) == len(before) + 1
    session.release(b)
    assert session._written == before
