"""Parquet tables of a data directory."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """One row for each key: the columns of its latest row. A null order comes first, a null key is kept
    as one key; ties are settled by the greatest value of the columns, so the result is the same on every run."""
    value = F.struct(*[F.col(c) for c in columns])
    return (df.groupBy(key)
            .agg(F.max(F.struct(F.col(order).alias("_o"), value.alias("_v"))).alias("_m"))
            .select(key, *[F.col(f"_m._v.{c}").alias(c) for c in columns]))
