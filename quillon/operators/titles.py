"""Titles that stand within other titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _runs(words: Column, least: int, longest: Column) -> Column:
    """Hashes of all runs of ``least`` to ``longest`` words, beside the last and the first word at most."""
    lengths = F.when(longest >= least, F.sequence(F.lit(least), longest)).otherwise(F.array().cast("array<int>"))
    at = lambda n: F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.array_distinct(F.flatten(F.transform(lengths, lambda n: F.transform(at(n), lambda i: F.xxhash64(F.array_join(F.slice(words, i, n), " "))))))


def contained(titles: DataFrame, key: str, title: str, least: int) -> DataFrame:
    """(short_id, long_id) of titles of which one stands within the other, character by character; equal titles are no case.

    ``titles``: distinct ``key``; ``title`` of single blanks, longer than ``least``
    characters. Where a title stands within another all its words but the first and the
    last are words there, in one run; so a title of three words or more meets, by an
    equi-join, the titles that have its inner words as a run. One of one or two words
    meets those that share the run of its first ``least`` + 1 characters. Pairs are then
    compared. Equal titles meet once. Nulls meet nothing; an empty table gives no pairs.
    """
    rows = titles.where(F.col(title).isNotNull()).select(F.col(key).alias("id"), F.col(title).alias("k"))
    once = rows.select("k").distinct().withColumn("words", F.split("k", " "))
    inner = F.col("words")
    most = F.size(inner) - 2
    few = F.size(inner) < 3
    grams = F.transform(F.sequence(F.lit(1), F.length("k") - least), lambda i: F.xxhash64(F.lit(0), F.substring("k", i, F.lit(least + 1))))
    # A run of inner words of the shorter one; the longer one has a word or part of one on either side of it.
    inside = once.where(few).select(F.col("k").alias("short"), F.xxhash64(F.lit(0), F.substring("k", 1, least + 1)).alias("h")).unionByName(once.where(~few).select(F.col("k").alias("short"), F.xxhash64(F.array_join(F.slice("words", F.lit(2), most), " ")).alias("h")))
    around = once.select(F.col("k").alias("long"), F.explode(F.array_union(_runs(inner, 1, most), grams)).alias("h"))
    met = inside.join(around.hint("merge"), "h").where((F.col("short") != F.col("long")) & F.contains("long", F.col("short"))).select("short", "long").distinct()
    a, b = rows.select(F.col("id").alias("short_id"), F.col("k").alias("short")), rows.select(F.col("id").alias("long_id"), F.col("k").alias("long"))
    return met.join(a, "short").join(b, "long").select("short_id", "long_id")
