"""Append-only history of what the engine did, entries of knowledge, and the weights of evaluators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent_events(events: DataFrame, prefix: str = "", most: int = 500) -> DataFrame:
    """The last ``most`` events whose topic begins with ``prefix``; ``prefix.*`` means all topics below it. Ties by topic."""
    prefix = prefix[:-1] if prefix.endswith(".*") else prefix
    return events.where(F.startswith("topic", F.lit(prefix))).orderBy(F.desc("ts"), "topic").limit(most)


def upsert(entries: DataFrame, new: DataFrame, key: str = "entry_id", order: str = "ts") -> DataFrame:
    """Entries with ``new`` merged in: of each key the row with the greatest ``order`` stays (nulls are oldest)."""
    both = entries.unionByName(new)
    rest = [c for c in both.columns if c != key]
    best = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order), F.xxhash64(*rest))).alias("r"))
    return best.select(*[key if c == key else f"r.{c}" for c in both.columns])


def keyword_index(entries: DataFrame, key: str = "entry_id", keywords: str = "keywords", kind: str = "hypothesis_type") -> DataFrame:
    """(word, key): lower-cased key words and ``type:<kind>`` of every entry, distinct."""
    words = F.concat(F.transform(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k.isNotNull()), lambda k: F.lower(k)), F.array(F.concat(F.lit("type:"), F.coalesce(kind, F.lit("other")))))
    return entries.select(F.explode(words).alias("word"), F.col(key)).distinct()


def blended_weights(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(operator, weight): 0.6 of the fresh and 0.4 of the old weight, either alone where the other is missing."""
    j = old.select("operator", F.col("weight").alias("o")).join(fresh.select("operator", F.col("weight").alias("f")), "operator", "full")
    return j.select("operator", F.round(F.when(F.col("o").isNotNull() & F.col("f").isNotNull(), 0.6 * F.col("f") + 0.4 * F.col("o")).otherwise(F.coalesce("f", "o")), 6).alias("weight"))


def health(trials: DataFrame, last: int = 20) -> DataFrame:
    """One row: min(1, 0.4 + 0.6 of the mean consistency of the last trials), 0.5 if there are none."""
    recent = trials.orderBy(F.desc("ts")).limit(last)
    return recent.agg(F.when(F.count("consistency") > 0, F.least(F.lit(1.0), 0.4 + 0.6 * F.avg("consistency"))).otherwise(0.5).alias("health"))


def retries(trials: DataFrame, most: int = 3) -> DataFrame:
    """Trials with their number per hypothesis, up to the first and ``most`` more."""
    w = Window.partitionBy("hypothesis_id").orderBy("ts")
    return trials.withColumn("retry_count", F.row_number().over(w) - 1).where(F.col("retry_count") <= most)


def evict(rows: DataFrame, most: int, *order) -> DataFrame:
    """The first ``most`` rows in ``order``: the bound of a cache or a pool."""
    return rows.orderBy(*order).limit(most)
