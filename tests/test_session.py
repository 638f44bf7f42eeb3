"""Inputs spread over the cores, and the folder for intermediate data."""

import types

import pytest
from pyspark.sql import functions as F

from tidemark import session


def test_a_small_input_is_spread_evenly_and_whole(spark, tmp_path, monkeypatch):
    spark.range(4_000).select(F.lit(7).alias("key"), "id").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert session.scan_width(df) == 1
    parts = session.spread(df).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()
    assert len(parts) == spark.sparkContext.defaultParallelism and max(p.n for p in parts) < 1_500
    assert session.spread(df).columns == ["key", "id"] and session.spread(df).agg(F.count_distinct("id")).first()[0] == 4_000
    monkeypatch.setattr(session, "scan_width", lambda df: 10_000)
    assert session.spread(df) is df


def test_a_cluster_needs_a_shared_folder(spark):
    conf = types.SimpleNamespace(get=lambda name, default=None: default)
    remote = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(remote)
    named = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda name, default=None: "/shared/x/"), sparkContext=remote.sparkContext)
    assert session.shared_dir(named) == "/shared/x" and session.shared_dir(spark)
