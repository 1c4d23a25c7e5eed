"""Results of external databases: a table to which they are imported and from which candidates are looked up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("composition", "database", "found", "value", "unit", "structure")
SCHEMA = "composition string, database string, found boolean, value double, unit string, structure string"


def imported(spark: SparkSession, rows: list[dict], known: DataFrame | None = None) -> DataFrame:
    """``known`` with ``rows`` in it; of one composition and database the last row counts. Rows without either are left out."""
    kept = {(r.get("composition"), r.get("database")): r for r in rows if r.get("composition") and r.get("database")}
    new = spark.createDataFrame([(k[0], k[1], bool(r.get("found")), None if r.get("value") is None else float(r["value"]), r.get("unit"), r.get("structure")) for k, r in kept.items()], SCHEMA)
    if known is None:
        return new
    return known.select(*COLUMNS).join(new.select("composition", "database"), ["composition", "database"], "left_anti").select(*COLUMNS).unionByName(new)


def save(lookups: DataFrame, path: str) -> None:
    """Written as parquet, in place of what was there; ``lookups`` is not to be read from the same path."""
    lookups.select(*COLUMNS).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def summary(candidates: DataFrame, lookups: DataFrame) -> DataFrame:
    """(database, candidates, found) of the candidates that were looked up."""
    met = candidates.select("composition").distinct().join(lookups, "composition")
    return met.groupBy("database").agg(F.count("*").alias("candidates"), F.count_if("found").alias("found"))
