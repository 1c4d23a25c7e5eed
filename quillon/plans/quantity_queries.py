"""Queries of problem 3: quantities recorded in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.quantities import common_units
from quillon.plans.registry import Registry
from quillon.sources.tables import table

registry = Registry()


@registry.query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Triples whose number in the common unit differs from the number as written."""
    triples = table(spark, folder, "csp_triples", "triple_id", "property_name", "property_value", "property_unit", "value_str", "loaded_at")
    return common_units(triples, table(spark, folder, "property_terms")).where(F.col("converted") & F.col("common_scaled").isNotNull()).select("triple_id", "common_scaled")


@registry.query("p3_common_values")
def p3_common_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every readable quantity in its common unit, changed or not."""
    triples = table(spark, folder, "csp_triples", "triple_id", "property_name", "property_value", "property_unit", "value_str", "loaded_at")
    return common_units(triples, table(spark, folder, "property_terms")).select("triple_id", "property_name", "common_unit", "common_scaled", "converted")
