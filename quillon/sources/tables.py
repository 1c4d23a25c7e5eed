"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` in ``folder``, with only ``columns`` read if any are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per non-null ``key``: the one with the least ``order``; ties by the whole row's hash.

    Map-side combined (``min_by``), so a key repeated many times costs one row per
    partition in the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    rank = F.struct(F.col(order).isNull(), F.col(order), F.xxhash64(*rest))
    best = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return best.select(key, "_row.*")
