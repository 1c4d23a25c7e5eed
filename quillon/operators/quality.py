"""The explainable quality gate: score, reasons, and a gate that degrades rather than reject a whole batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.lexicons import EVIDENCE_TERMS, MECHANISM_TERMS, METADATA_TERMS, WEAK_BRIDGE_TERMS
from quillon.functions.settle import settle
from quillon.functions.text import has_metric, literal, matched_terms, whitespace_normal


@dataclass(frozen=True)
class QualityRules:
    enabled: bool = True
    focus_terms: tuple[str, ...] = ()
    require_focus: bool = True
    min_score: float = 0.40
    min_mechanism_hits: int = 1
    min_evidence_hits: int = 1
    min_abstract_chars: int = 80
    mechanism_terms: tuple[str, ...] = MECHANISM_TERMS
    evidence_terms: tuple[str, ...] = EVIDENCE_TERMS


def assess(papers: DataFrame, rules: QualityRules = QualityRules(), *, title: str = "title", abstract: str = "abstract", keywords: str = "keywords") -> DataFrame:
    """``papers`` with score, accepted, focus_terms, mechanism_terms, evidence_terms, has_metric, metadata_only and reasons.

    Null texts and key words count as empty. Existing columns of those names are
    replaced. An empty table gives an empty result.
    """
    made = ["score", "accepted", "focus_terms", "mechanism_terms", "evidence_terms", "has_metric", "metadata_only", "reasons"]
    base = papers.drop(*made)
    empty = F.array().cast("array<string>")
    base = base.withColumns({"_text": whitespace_normal(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit("")), F.array_join(F.coalesce(F.col(keywords), empty), " "))), "_title": whitespace_normal(F.col(title)), "_chars": F.length(F.trim(F.coalesce(abstract, F.lit(""))))})
    base = settle(base, {"focus_terms": matched_terms(F.col("_text"), rules.focus_terms, phrases=True) if rules.focus_terms else empty, "mechanism_terms": matched_terms(F.col("_text"), rules.mechanism_terms), "evidence_terms": matched_terms(F.col("_text"), rules.evidence_terms), "has_metric": has_metric(F.col("_text"))})
    tokens = F.array_distinct(F.regexp_extract_all("_title", F.lit("[a-z][a-z0-9-]{2,}"), F.lit(0)))
    few = F.size(F.array_except(tokens, literal(METADATA_TERMS))) < 2
    identifier = F.col("_title").rlike(r"^[a-z0-9]+(?:[-_][a-z0-9]+)+$") & F.col("_title").rlike(r"\d")
    focus = F.lit(1.0) if not rules.focus_terms else F.least(F.lit(1.0), F.size("focus_terms") / F.lit(max(1, min(2, len(rules.focus_terms)))))
    score = F.round(
        0.35 * focus
        + 0.35 * F.least(F.lit(1.0), F.size("mechanism_terms") / 2.0)
        + 0.25 * F.least(F.lit(1.0), F.size("evidence_terms") / 2.0 + F.when(F.col("has_metric"), 0.25).otherwise(0.0))
        + 0.05 * F.when(F.col("_chars") >= rules.min_abstract_chars, 1.0).otherwise(0.0),
        3,
    )
    base = settle(base, {"score": score, "metadata_only": (F.col("_chars") < rules.min_abstract_chars) & ~F.col("has_metric") & few})
    checks = [
        (F.lit(bool(rules.require_focus and rules.focus_terms)) & (F.size("focus_terms") == 0), "no_focus_term"),
        (F.size("mechanism_terms") < rules.min_mechanism_hits, "insufficient_mechanism"),
        ((F.size("evidence_terms") < rules.min_evidence_hits) & ~F.col("has_metric"), "insufficient_evidence"),
        (F.col("metadata_only"), "metadata_only"),
        (identifier, "identifier_title"),
        (F.col("score") < rules.min_score, "score_below_threshold"),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in checks]), lambda r: r.isNotNull()) if rules.enabled else empty
    return settle(settle(base, {"reasons": reasons}), {"accepted": F.size("reasons") == 0}).drop("_text", "_title", "_chars")


def gate(assessed: DataFrame, batch: list[str], key: str) -> DataFrame:
    """Rows that pass, with ``degraded``: of a batch in which none is accepted, the best fifth (at least one) by score.

    The rank is taken within ``batch``; a batch is one delivery, not the corpus.
    """
    size = F.count("*").over(Window.partitionBy(*batch))
    passed = F.sum(F.col("accepted").cast("int")).over(Window.partitionBy(*batch))
    rank = F.row_number().over(Window.partitionBy(*batch).orderBy(F.desc("score"), key))
    marked = assessed.withColumns({"_n": size, "_ok": passed, "_rank": rank})
    keep = F.col("accepted") | ((F.col("_ok") == 0) & (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_n") / 5))))
    return marked.where(keep).withColumn("degraded", F.col("_ok") == 0).drop("_n", "_ok", "_rank")


def technical_overlap(a: Column, b: Column) -> Column:
    """Mechanism terms of both, without weak ones, in the order of the list."""
    return F.array_except(F.array_intersect(a, b), literal(WEAK_BRIDGE_TERMS))
