"""The ensemble of rule-based evaluators, its consistency check, trials and repeat verification, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.settle import settle
from quillon.functions.text import literal

# By hypothesis type the bonus of the graph evaluator, the unreducible uncertainty and the causal base for materials.
TYPES = {
    "analogy": (0.08, 0.35, 0.45), "combination": (0.12, 0.30, 0.45), "gap": (0.08, 0.50, 0.45), "contradiction": (0.04, 0.60, 0.45), "structure_property": (0.12, 0.25, 0.65),
    "composition_transfer": (0.10, 0.30, 0.60), "process_optimization": (0.08, 0.35, 0.50), "hidden_link": (0.10, 0.35, 0.55), "gap_filling": (0.08, 0.30, 0.50),
}
OTHER = (0.03, 0.40, 0.45)
PLACEHOLDERS = ("domain A", "domain B", "target problem", "the proposed method", "shared concept")
METHOD_CUES = ("transformer", "neural", "learning", "optimization", "bayesian", "graph", "quantum", "diffusion", "causal", "digital twin")
MATERIAL_CUES = ("perovskite", "bandgap", "conductivity", "formation energy", "cohesive energy", "seebeck", "piezoelectric", "dielectric", "thermal conductivity", "young", "hardness", "curie", "cubic", "tetragonal", "orthorhombic", "hexagonal", "wurtzite", "olivine", "garnet", "layered", "bcc", "fcc", "predict", "≈", "dft", "alloy", "cathode", "electrolyte")
# Cue words of each type; the statements here are English.
TYPE_CUES = {
    "analogy": ("transfer", "borrow", "similar", "unif"), "contradiction": ("contradict", "conflict", "opposite", "boundary"), "gap": ("unexplored", "not yet", "interact", "combined"), "combination": ("combin", "together", "end-to-end", "bridge"),
    "structure_property": ("predict", "≈", "structure", "property"), "composition_transfer": ("replac", "transfer", "component"), "process_optimization": ("process", "optimal", "window"), "hidden_link": ("hidden", "link", "bridge", "report"), "gap_filling": ("gap", "not yet", "unreported"),
}
OPERATORS = ("cross_domain", "knowledge_graph", "uncertainty", "causal", "llm_reasoning", "multi_fidelity")
THRESHOLDS = (0.50, 0.65, 0.55, 0.70, 0.60)
SUBSETS = (("cross_domain", "causal", "uncertainty"), ("knowledge_graph", "llm_reasoning", "multi_fidelity"), OPERATORS)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def by_type(kind: Column, which: int) -> Column:
    out = F.lit(OTHER[which])
    for t, v in TYPES.items():
        out = F.when(kind == t, F.lit(v[which])).otherwise(out)
    return out


def any_of(text: Column, words) -> Column:
    return F.exists(literal(words), lambda w: F.contains(text, w))


def evaluate(hypotheses: DataFrame) -> DataFrame:
    """``hypotheses`` with e1..e6, the scores of OPERATORS.

    Read: keywords (null counts as empty), statement, hypothesis_type (null is 'other'),
    and the booleans cross_domain, materials and numeric (a number is predicted; null is false).
    """
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    base = hypotheses.withColumns({"_k": F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda w: w.isNotNull()), "_s": F.coalesce("statement", F.lit("")), "_t": F.coalesce("hypothesis_type", F.lit("other")), "_mn": no("materials") & no("numeric")})
    n, length = F.size("_k"), F.length("_s")
    base = base.withColumn("_ph", any_of(F.col("_s"), PLACEHOLDERS) | (~no("materials") & F.contains("_s", F.lit("unknown"))))
    half = F.floor(n / 2).cast("int")
    a, b = F.slice("_k", F.lit(1), half), F.slice("_k", half + 1, n - half)
    e1 = F.when(~no("cross_domain"), 0.6).when(n < 4, 0.35).otherwise(clamp(0.3 + 0.35 * F.least(F.lit(1.0), F.size(F.array_union(a, b)) / 8) + 0.1 * F.size(F.array_intersect(a, b)), 0.2, 0.8))
    e2 = F.when(n == 0, 0.2).when(F.col("_ph"), 0.15).otherwise(clamp(0.25 + by_type(F.col("_t"), 0) + F.when(n >= 4, 0.05).when(n < 2, -0.1).otherwise(0.0) + F.when(F.col("_mn"), 0.10).otherwise(0.0), 0.1, 0.8))
    evidence = F.least(F.lit(1.0), n / 16 + length / 400)
    epistemic = 1 - evidence + F.when(F.col("_ph"), 0.2).otherwise(0.0) + F.when(n < 3, 0.15).otherwise(0.0) - F.when(F.col("_mn"), 0.15).otherwise(0.0)
    e3 = clamp(1 - 0.8 * clamp((epistemic + by_type(F.col("_t"), 1)) / 2, 0.0, 1.0), 0.1, 1.0)
    t = F.col("_t")
    general = F.when(t == "contradiction", F.when(n >= 2, 0.55).otherwise(0.25)).when(t == "analogy", F.when(no("cross_domain"), 0.45).otherwise(0.6)).when(t == "combination", F.when(n >= 3, 0.55).otherwise(0.3)).when(t == "gap", F.when(n >= 3, 0.5).otherwise(0.3)).otherwise(0.35)
    e4 = F.when(F.col("_ph"), 0.2).when(no("materials"), F.least(F.lit(0.85), by_type(t, 2) + F.when(no("numeric"), 0.10).otherwise(0.0) + F.when(n >= 4, 0.05).otherwise(0.0))).otherwise(general)
    low = F.lower("_s")
    coverage = F.when(n > 0, F.size(F.filter("_k", lambda w: F.contains(low, F.lower(w)))) / n).otherwise(0.0)
    cue = F.lit(False)
    for kind, words in TYPE_CUES.items():
        cue = cue | ((t == kind) & any_of(low, words))
    bonus = lambda c, v: F.when(c, v).otherwise(0.0)
    e5 = F.least(F.lit(1.0), 0.3 + 0.3 * coverage + bonus(any_of(low, METHOD_CUES), 0.15) + bonus(any_of(low, MATERIAL_CUES), 0.15) + bonus(length > 30, 0.1) + bonus(cue, 0.1) + bonus(F.col("_mn"), 0.10))
    base = settle(base, {"e1": e1, "e2": e2, "e3": e3, "e4": e4, "e5": e5})
    five = F.array_sort(F.array("e1", "e2", "e3", "e4", "e5"))
    mean = (F.col("e1") + F.col("e2") + F.col("e3") + F.col("e4") + F.col("e5")) / 5
    median = F.element_at(five, 3)
    return settle(base, {"e6": clamp(0.6 * median + 0.2 * mean + 0.2 * (1 - 2 * F.abs(median - mean)), 0.1, 1.0)}).drop("_k", "_s", "_t", "_mn", "_ph")


def fuse(scores: list[Column], weights: list[Column] | None = None) -> tuple[Column, Column]:
    """Weighted mean and consistency, max(0, 1 - 3 * population deviation), both to four digits."""
    w = weights or [F.lit(1.0)] * len(scores)
    total, mean = sum(w[1:], w[0]), sum(scores[1:], scores[0]) / len(scores)
    weighted = sum((a * b for a, b in zip(scores[1:], w[1:])), scores[0] * w[0]) / total
    variance = sum(((s - mean) * (s - mean) for s in scores[1:]), (scores[0] - mean) * (scores[0] - mean)) / len(scores)
    return F.round(weighted, 4), F.round(F.greatest(F.lit(0.0), 1 - 3 * F.sqrt(variance)), 4)


def safe(scores: list[Column], weighted: Column, consistency: Column, threshold: Column) -> Column:
    """No veto below 0.2, consistent, at least three evaluators, mean of 0.3 or more."""
    return (F.least(*scores) >= 0.2) & (consistency >= threshold) & F.lit(len(scores) >= 3) & (weighted >= 0.3)


def _flag(df: DataFrame, name: str) -> Column:
    """A boolean column, false where it is null or missing."""
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def trial(evaluated: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds score, consistency, is_safe, passed, weakest (evaluator) and failure_reason.

    Numeric materials hypotheses gain a factor of 1.15. Where ``evaluated`` has the
    columns, ``violations`` of the content gate end a trial with score and consistency 0,
    and ``number_violations`` fail one at half its score; ``model_score``, an outside
    judgement, counts as a further evaluator of weight 1.5 where it is not null.
    """
    scores = [F.col(f"e{i}") for i in range(1, 7)]
    w = [F.lit((weights or {}).get(o, 1.0)) for o in OPERATORS]
    mn = F.coalesce(F.col("materials") & F.col("numeric"), F.lit(False))
    listed = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0 if c in evaluated.columns else F.lit(False)
    weighted, consistency = fuse(scores, w)
    if "model_score" in evaluated.columns:
        m = F.col("model_score")
        also, spread = fuse([*scores, m], [*w, F.lit(1.5)])
        weighted, consistency = F.when(m.isNull(), weighted).otherwise(also), F.when(m.isNull(), consistency).otherwise(spread)
    base = settle(evaluated, {"score": weighted, "consistency": consistency, "_bad": listed("violations"), "_off": listed("number_violations")})
    base = settle(base, {"is_safe": safe(scores, F.col("score"), F.col("consistency"), F.when(mn, 0.45).otherwise(0.6))})
    raised = F.when(F.col("_off"), F.round(F.col("score") * 0.5, 6)).when(mn, F.least(F.lit(1.0), F.round(F.col("score") * 1.15, 4))).otherwise(F.col("score"))
    weakest = F.array_min(F.array(*[F.struct(F.round(F.col(f"e{i}"), 6).alias("s"), F.lit(o).alias("o")) for i, o in enumerate(OPERATORS, 1)]))["o"]
    zero = lambda c: F.when(F.col("_bad"), 0.0).otherwise(c)
    base = settle(base, {"score": zero(raised), "consistency": zero(F.col("consistency")), "is_safe": F.col("is_safe") & ~F.col("_bad"), "weakest": weakest})
    base = settle(base, {"passed": F.col("is_safe") & ~F.col("_off") & (F.col("score") >= 0.5)})
    reason = F.when(F.col("passed"), None).when(F.col("_bad"), "content").when(F.col("_off"), "numbers").when(~F.col("is_safe"), "unsafe").otherwise("low_score")
    return base.withColumn("failure_reason", reason).drop("_bad", "_off")


def heuristic_trial(hypotheses: DataFrame) -> DataFrame:
    """Trials without the ensemble: ``hypotheses`` with score, consistency, passed from plain signs.

    0.25, and more for a statement of 30 characters, three key words, a number, a cue of
    its type and a causal word; 0.15 less for each of ``violations``. Nulls count as empty.
    """
    s, t = F.coalesce("statement", F.lit("")), F.coalesce("hypothesis_type", F.lit("other"))
    low = F.lower(s)
    cue = F.lit(False)
    for kind, words in TYPE_CUES.items():
        cue = cue | ((t == kind) & any_of(low, words))
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    bad = F.coalesce(F.size("violations"), F.lit(0)) if "violations" in hypotheses.columns else F.lit(0)
    score = 0.25 + plus(F.length(s) > 30, 0.1) + plus(F.size(F.coalesce("keywords", F.array().cast("array<string>"))) >= 3, 0.1) + plus(s.rlike("[0-9]"), 0.1) + plus(cue, 0.1) + plus(low.rlike(r"\b(because|leads? to|causes?|due to|therefore|if)\b"), 0.1) - 0.15 * bad
    base = settle(hypotheses, {"score": F.round(clamp(score, 0.0, 1.0), 4)})
    return base.withColumns({"consistency": F.lit(0.5), "passed": F.col("score") >= 0.5})


def verify(trials: DataFrame) -> DataFrame:
    """Adds reproduce_rate, cross_share, stability, discovery and level: five repeats against THRESHOLDS and three subsets of evaluators.

    All repeats share one score, so its spread is none and the penalty for it is 0.10.
    Where ``trials`` has the columns: known_principle, fallback limit the stability to
    0.59, pending (and no number, and key words 'unknown' or 'general') to 0.79;
    number_violations, a range_problem and self-reference among ``violations`` make it 0.
    """
    repro = sum((F.when(F.col("is_safe") & (F.col("score") >= t), 1).otherwise(0) for t in THRESHOLDS[1:]), F.when(F.col("is_safe") & (F.col("score") >= THRESHOLDS[0]), 1).otherwise(0)) / len(THRESHOLDS)
    ok = []
    mn = F.coalesce(F.col("materials") & F.col("numeric"), F.lit(False))
    for subset in SUBSETS:
        scores = [F.col(f"e{OPERATORS.index(o) + 1}") for o in subset]
        weighted, consistency = fuse(scores)
        ok.append(F.when(safe(scores, weighted, consistency, F.when(mn, 0.45).otherwise(0.6)), 1).otherwise(0))
    base = settle(trials, {"reproduce_rate": repro, "cross_share": (ok[0] + ok[1] + ok[2]) / 3})
    raw = 0.5 * F.col("reproduce_rate") + 0.5 * F.col("cross_share") - F.when(F.col("score") > 0, 0.10).otherwise(0.0)
    vague = F.exists(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: F.lower(k).isin("unknown", "general"))
    cap = F.when(_flag(trials, "known_principle") | _flag(trials, "fallback"), 0.59).when(_flag(trials, "pending") | ~F.coalesce("numeric", F.lit(False)) | F.coalesce(vague, F.lit(False)), 0.79).otherwise(1.0)
    out = F.lit(False)
    if "number_violations" in trials.columns:
        out = out | (F.coalesce(F.size("number_violations"), F.lit(0)) > 0)
    if "violations" in trials.columns:
        out = out | F.coalesce(F.arrays_overlap("violations", literal(("same_source_and_target", "refers_to_itself", "twice_the_same"))), F.lit(False))
    if "range_problem" in trials.columns:
        out = out | F.col("range_problem").isNotNull()
    base = settle(base, {"stability": F.when(out, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(raw, cap)), 6))})
    base = settle(base, {"discovery": (F.col("stability") >= 0.55) & (F.col("reproduce_rate") >= 0.6) & (F.col("cross_share") == 1.0)})
    return base.withColumn("level", F.when(~F.col("discovery"), "none").when(F.col("stability") >= 0.8, "gold").when(F.col("stability") >= 0.6, "silver").otherwise("bronze"))


def calibrate(predictions: DataFrame, operator: str = "operator", predicted: str = "predicted", passed: str = "passed") -> DataFrame:
    """(operator, n, accuracy, weight, rmse) from predictions in long form; the weight has a floor of 0.3."""
    p = predictions.where(F.col(predicted).isNotNull() & F.col(passed).isNotNull())
    right = F.when((F.col(predicted) >= 0.5) == F.col(passed), 1.0).otherwise(0.0)
    off = F.pow(F.col(predicted) - F.when(F.col(passed), 1.0).otherwise(0.0), F.lit(2.0))
    out = p.groupBy(operator).agg(F.count("*").alias("n"), F.avg(right).alias("accuracy"), F.sqrt(F.avg(off)).alias("rmse"))
    return out.select(operator, "n", F.round("accuracy", 6).alias("accuracy"), F.round(F.greatest(F.lit(0.3), F.col("accuracy")), 6).alias("weight"), F.round("rmse", 6).alias("rmse"))
