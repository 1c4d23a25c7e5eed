"""Quantities in whatever unit to the common unit of their property.

Conversions are edges of a graph of units with affine functions
(``functions.units``); their shortest compositions are computed once on the driver
and meet the data in an equi-join on (spelled unit, common unit).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import units
from quillon.functions.names import NameIndex

_NUMBER = r"[-+]?(?:\d[\d.,]*|\.\d+)(?:[eE][-+]?\d+)?(?:\s*[×x*·⋅]\s*10\s*\^?\s*[-+]?\d+)?"
_ERROR = r"\s*(?:±|\+/-|\+-)\s*" + r"(?:\d[\d.,]*)(?:[eE][-+]?\d+)?"
_REST = f"{_NUMBER}(?:{_ERROR})?(.*)$"
_NAME_UNIT = r"(?:\s/\s+(.+)|\s*\[([^\]]+)\]|\s*\(((?:[^()]|\([^()]*\))+)\)|,\s+(.+)|[_\s]in[_\s](.+))\s*$"
_POWER = r"^\(?\s*[×x*·⋅]?\s*(?:10\s*\^\s*([-+]?\d+)|1[eE]([-+]?\d+))(?:\s*[·⋅*×])?\s*"


def _plain(text: Column) -> Column:
    """Signs and raised digits in ASCII; a raised exponent of ten gets a caret."""
    t = F.regexp_replace(text, r"10([⁻⁺]?[⁰¹²³⁴⁵⁶⁷⁸⁹]+)", "10^$1")
    return F.trim(F.translate(t, "−–‐‑⁻⁺⁰¹²³⁴⁵⁶⁷⁸⁹     ", "-----+0123456789     "))


def read_number(text: Column) -> Column:
    """The first number in the plain ``text`` as a double, null if there is none.

    A comma before exactly three digits groups thousands, any other is a decimal sign.
    """
    raw = F.regexp_extract(text, _NUMBER, 0)
    head = F.regexp_extract(raw, r"^[-+]?[\d.,]+(?:[eE][-+]?\d+)?", 0)
    head = F.regexp_replace(F.regexp_replace(head, r",(?=\d{3}(?!\d))", ""), ",", ".")
    head = F.regexp_replace(head, r"\.+$", "").try_cast("double")
    power = F.regexp_extract(raw, r"10\s*\^?\s*([-+]?\d+)$", 1)
    times = F.regexp_extract(raw, r"[×x*·⋅]", 0) != ""
    return F.when(times, head * F.pow(F.lit(10.0), power.try_cast("double"))).otherwise(head)


def name_unit(name: Column) -> Column:
    """What may be a unit at the end of a name: after a slash, a comma or ``in``, or in brackets; '' if nothing is."""
    return F.concat(*[F.coalesce(F.regexp_extract(name, _NAME_UNIT, k), F.lit("")) for k in range(1, 6)])


def unit_power(unit: Column) -> Column:
    """The power of ten written in a plain unit, as a factor."""
    e = F.concat(F.regexp_extract(unit, _POWER, 1), F.regexp_extract(unit, _POWER, 2))
    return F.when(e == "", 1.0).otherwise(F.pow(F.lit(10.0), e.try_cast("double")))


def name_forms(terms: DataFrame, name: str = "property_name", label: str | None = "label", aliases: str = "aliases") -> list[tuple[str, str]]:
    """(entry, surface form) of a reference table of bounded size."""
    cols = [name, *([label] if label else []), aliases]
    return [(r[0], form) for r in terms.select(*cols).where(F.col(name).isNotNull()).orderBy(name).collect() for form in [r[0], *([r[1]] if label else []), *(r[-1] or [])] if form]


def resolve_names(values: DataFrame, column: str, forms: list[tuple[str, str]]) -> DataFrame:
    """(``column``, entry) of each distinct value that means an entry of ``forms`` without being one."""
    exact = [e for e, _ in forms]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = NameIndex(forms)
        for b in batches:
            b["entry"] = [index.resolve(v) for v in b[column]]
            yield b[b["entry"].notna()]

    rest = values.select(column).where(F.col(column).isNotNull() & (F.trim(column) != "") & ~F.col(column).isin(exact)).distinct()
    # Few bytes, much work: spread beyond what the size of the values would ask for.
    rest = rest.repartition(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(column))
    return rest.mapInPandas(run, f"`{column}` string, entry string")


def resolved(triples: DataFrame, column: str, forms: list[tuple[str, str]]) -> DataFrame:
    """``triples`` with ``column`` in place of the entry of ``forms`` that its value means; rows whose value means none go.

    Each distinct free-entered value is resolved once. Null and blank values mean none.
    """
    known = F.col(column).isin(sorted({e for e, _ in forms}))
    found = resolve_names(triples, column, forms)
    free = triples.where(~known).join(found, column).withColumn(column, F.col("entry")).drop("entry")
    return triples.where(known).unionByName(free)


def common_units(
    triples: DataFrame,
    terms: DataFrame,
    *,
    key: str = "triple_id",
    name: str = "property_name",
    value: str = "property_value",
    unit: str = "property_unit",
    quoted: str = "value_str",
    version: str = "loaded_at",
) -> DataFrame:
    """Each quantity in the common unit of its property.

    Result: key, property_name (entry), common_unit, decimals, number (as written),
    factor, offset, common (double), common_scaled (bigint), converted (whether the
    number changed).

    The number is the one quoted in ``quoted``, else ``value``. Its unit is the one
    quoted, else ``unit``, else the one at the end of ``name``. A quotation that holds
    a number and no unit takes the unit from the other places. Left out: null keys;
    names that mean no entry; no readable number; units that are missing, arbitrary or
    of another kind; properties without a common unit. Rows repeated under one key
    count once, the one with the least ``version`` (nulls last). Other columns are not
    read, so names that clash do no harm. An empty table gives an empty result.
    """
    if units.cycle_error() > 1e-9:
        raise ValueError("conversions contradict each other around a cycle")
    forms = name_forms(terms)
    spark = triples.sparkSession
    meta = terms.select(F.col("property_name").alias("_entry"), F.col("common_unit").alias("_common"), F.col("decimals").cast("int").alias("_decimals")).where(F.trim(F.coalesce("_common", F.lit(""))) != "").dropDuplicates(["_entry"])
    # One row per reference entry and one per spelled unit: fixed by the reference table, so broadcast.
    targets = [r[0] for r in meta.select("_common").distinct().collect()]
    table = spark.createDataFrame(units.conversion_rows(targets), "_unit string, _common string, _factor double, _offset double")
    base = triples.select(
        F.col(key).alias("_key"), F.col(name).alias("_name"), F.col(value).cast("double").alias("_value"), F.col(unit).alias("_given"), F.col(quoted).alias("_quoted"), F.col(version).alias("_version")
    ).where(F.col("_key").isNotNull() & F.col("_name").isNotNull())
    known = F.col("_name").isin([e for e, _ in forms])
    # Distinct free-entered names only: pre-aggregated, each resolved once, then joined back.
    found = resolve_names(base.select("_name"), "_name", forms).withColumnRenamed("entry", "_found")
    free = base.where(~known).join(found, "_name").withColumnRenamed("_found", "_entry")
    rows = base.where(known).withColumn("_entry", F.col("_name")).unionByName(free).join(F.broadcast(meta), "_entry")

    keep = ["_key", "_entry", "_common", "_decimals", "_version"]
    # Each step stands behind a generator: filters are not pushed through it, so no pattern is matched twice.
    rows = rows.select(*keep, "_name", "_value", "_given", F.inline(F.array(F.struct(_plain(F.col("_quoted")).alias("_q")))))
    rows = rows.select(*keep, "_name", "_value", "_given", F.inline(F.array(F.struct(read_number(F.col("_q")).alias("_read"), F.regexp_replace(F.regexp_extract("_q", _REST, 1), f"{_ERROR}.*$", "").alias("_tail")))))
    missing = lambda c: F.coalesce(F.trim(c), F.lit("")).isin("", "?", "-", "–")
    own = F.when(F.col("_read").isNotNull() & ~missing(F.col("_tail")), F.col("_tail")).when(~missing(F.col("_given")), F.col("_given")).otherwise(name_unit(F.col("_name")))
    rows = rows.select(*keep, F.inline(F.array(F.struct(F.coalesce("_read", "_value").alias("_number"), _plain(own).alias("_u")))))
    rows = rows.where(F.col("_number").isNotNull() & ~F.isnan("_number") & (F.col("_u") != ""))
    rows = rows.select(*keep, "_number", F.inline(F.array(F.struct(units.unit_key(F.regexp_replace("_u", _POWER, "")).alias("_unit"), unit_power(F.col("_u")).alias("_power")))))
    joined = rows.join(F.broadcast(table), ["_unit", "_common"])
    common = F.col("_number") * F.col("_power") * F.col("_factor") + F.col("_offset")
    picked = joined.select("_key", "_version", F.struct("_entry", "_common", "_decimals", "_number", (F.col("_power") * F.col("_factor")).alias("f"), "_offset", common.alias("c")).alias("_s"))
    once = picked.groupBy("_key").agg(F.min_by("_s", F.struct(F.col("_version").isNull(), "_version", "_s")).alias("_s"))
    changed = F.abs(F.col("_s.c") - F.col("_s._number")) > 1e-9 * F.greatest(F.abs("_s.c"), F.abs("_s._number"))
    return once.select(
        F.col("_key").alias(key),
        F.col("_s._entry").alias("property_name"),
        F.col("_s._common").alias("common_unit"),
        F.col("_s._decimals").alias("decimals"),
        F.col("_s._number").alias("number"),
        F.col("_s.f").alias("factor"),
        F.col("_s._offset").alias("offset"),
        F.col("_s.c").alias("common"),
        F.round(F.col("_s.c") * F.pow(F.lit(10.0), F.col("_s._decimals"))).cast("bigint").alias("common_scaled"),
        changed.alias("converted"),
    )
