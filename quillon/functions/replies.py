"""JSON in free text: raw, fenced, between brackets, with trailing commas, or object by object. All as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = "array<struct<composition: string, structure: string, property: string, value: string, unit: string>>"
VAGUE = ("may be related", "could be interesting", "some effect", "further study", "it is possible")


def parse_list(text: Column, schema: str = TRIPLE) -> Column:
    """The list of objects that ``text`` holds, [] if none can be read, null for null.

    Tried in order: the text, a fenced block, what stands between the outer brackets,
    the same without trailing commas, and the objects one by one.
    """
    element = schema[len("array<") : -1]
    fence = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    inner = F.regexp_extract(F.when(fence != "", fence).otherwise(text), r"(?s)(\[.*\])", 1)
    repaired = F.regexp_replace(inner, r",\s*([\]}])", "$1")
    read = lambda t: F.from_json(F.when(F.trim(t).rlike(r"(?s)^\[.*\]$"), F.trim(t)), schema)
    one_by_one = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0)), lambda o: F.from_json(o, element)), lambda o: o.isNotNull())
    full = lambda c: F.when((F.size(c) > 0) & ~F.exists(c, lambda o: o.isNull()), c)
    return F.when(text.isNotNull(), F.coalesce(full(read(text)), full(read(fence)), full(read(inner)), full(read(repaired)), one_by_one))


def checked_hypotheses(df: DataFrame, statement: str = "statement", confidence: str = "confidence", kind: str = "hypothesis_type") -> DataFrame:
    """Hypotheses from outside: too short or vague ones go, confidence falls without a causal word, missing kinds follow cue words."""
    s = F.lower(F.col(statement))
    vague = F.exists(F.array(*[F.lit(v) for v in VAGUE]), lambda v: F.contains(s, v))
    causal = s.rlike(r"\b(because|since|leads? to|causes?|due to|therefore|if)\b")
    kept = df.where((F.length(F.trim(statement)) >= 30) & ~vague)
    guess = F.when(s.rlike("contradict|conflict"), "contradiction").when(s.rlike("combin|together"), "combination").when(s.rlike("gap|not (yet )?reported"), "gap_filling").otherwise("hidden_link")
    return kept.withColumns({confidence: F.when(causal, F.col(confidence)).otherwise(F.col(confidence) * 0.6), kind: F.coalesce(kind, guess)})
