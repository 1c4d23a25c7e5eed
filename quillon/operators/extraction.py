"""Composition-structure-property facts from abstracts: sentence by sentence, with the formula carried on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.chemistry import formulas, mentioned, plain_formula, sentences

# A number stands by itself: digits within formulas and words are none.
VALUE = r"^.{0,60}?(?<=[\s(≈=~])(-?[0-9]+(?:\.[0-9]+)?)\s*([A-Za-zµμΩÅ°%‰][A-Za-zµμΩÅ°%‰0-9/²³·()\-]*)?"
ERROR_WORDS = ("error", "uncertainty", "deviation", "within", "cycles")
COMPOSITIONS = 2  # the first formulas of a sentence that a fact may be about


def sentence_rows(papers: DataFrame, key: str = "paper_id", text: str = "abstract") -> DataFrame:
    """(key, ord, sentence, compositions): each sentence with its own first formulas, else those of the last sentence that had any."""
    s = papers.where(F.col(key).isNotNull()).select(F.col(key).alias(key), F.posexplode(sentences(F.col(text))).alias("ord", "sentence"))
    own = s.select(key, "ord", plain_formula(F.col("sentence")).alias("sentence")).select(key, "ord", "sentence", F.slice(formulas(F.col("sentence")), 1, COMPOSITIONS).alias("own"))
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last(F.when(F.size("own") > 0, F.col("own")), ignorenulls=True).over(w)
    return own.select(key, "ord", "sentence", F.coalesce(carried, F.array().cast("array<string>")).alias("compositions"), (F.size("own") > 0).alias("has_own"))


def extract(papers: DataFrame, forms: list[tuple[str, str]], structures: list[str], *, key: str = "paper_id", text: str = "abstract") -> DataFrame:
    """(key, ord, composition, structure, property_name, property_value, property_unit, confidence), one row per fact.

    ``forms``: (property, surface form) of a reference list of fixed size; a property
    counts by its longest form in the sentence. The value is the first number within 60
    characters after the form, unless an error word stands between them. The structure
    is the longest named in the sentence, else 'unknown'. Confidence is 0.7 with a
    value, 0.4 with a structure or an own formula, else 0.3. Facts with neither value
    nor structure are left out. Null and empty texts give no rows.
    """
    rows = sentence_rows(papers, key, text).where(F.size("compositions") > 0).withColumn("low", F.lower("sentence"))
    lexicon = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(f.lower()).alias("f")) for p, f in sorted(set(forms), key=lambda x: (-len(x[1]), x))])
    hits = F.filter(lexicon, lambda x: F.contains("low", x["f"]))
    found = rows.select(key, "ord", "sentence", "low", "compositions", "has_own", F.explode(hits).alias("x"))
    bounded = found.where(F.col("low").rlike(r"[a-z0-9]") & F.regexp_like("low", F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.col("x.f"), F.lit(r"\E($|[^a-z0-9])"))))
    longest = bounded.groupBy(key, "ord", F.col("x.p").alias("property_name")).agg(F.max_by(F.struct("sentence", "low", "compositions", "has_own", F.col("x.f").alias("f")), F.struct(F.length("x.f"), "x.f")).alias("s")).select(key, "ord", "property_name", "s.*")
    after = F.substring("sentence", F.instr("low", F.col("f")) + F.length("f"), F.lit(150))
    read = longest.withColumns({"_n": F.regexp_extract(after, VALUE, 1), "_u": F.regexp_extract(after, VALUE, 2), "_gap": F.lower(F.regexp_extract(after, r"^(.{0,60}?)(?<=[\s(≈=~])-?[0-9]", 1))})
    clear = ~F.exists(F.array(*[F.lit(w) for w in ERROR_WORDS]), lambda w: F.contains("_gap", w))
    value = F.when(clear, F.nullif("_n", F.lit("")).try_cast("double"))
    structure = F.coalesce(F.get(mentioned(F.col("low"), [s.lower() for s in structures]), F.lit(0)), F.lit("unknown"))
    out = read.select(key, "ord", F.explode("compositions").alias("composition"), structure.alias("structure"), "property_name", value.alias("property_value"), F.when(value.isNotNull(), F.col("_u")).alias("property_unit"), "has_own")
    confidence = F.when(F.col("property_value").isNotNull(), 0.7).when((F.col("structure") != "unknown") | F.col("has_own"), 0.4).otherwise(0.3)
    return out.withColumn("confidence", confidence).drop("has_own").where(F.col("property_value").isNotNull() | (F.col("structure") != "unknown"))
