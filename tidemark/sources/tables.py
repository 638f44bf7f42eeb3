"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``; lazy, so filters and columns reach the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
