"""Statements of hypotheses: validity, falsifiability, content and number gates, ranges, labels, templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.chemistry import stoichiometry_violation
from quillon.functions.settle import settle
from quillon.functions.text import literal, unigrams
from quillon.operators import physics

# Cue words of these English statements.
OBSERVABLE = ("conductivity", "hardness", "modulus", "fatigue", "wear", "efficiency", "strength", "capacity", "band gap", "expansion", "resistance", "mobility", "polarization", "expected", "improve", "predict", "≈")
FILLERS = ("may produce", "may exist", "may share", "may have", "not yet studied", "unexplored")
VAGUE_TERMS = ("approach", "method", "framework", "model", "system", "analysis", "study", "research", "performance", "design")
FRAGMENT = r"\b(numerical|investigation|experimental|theoretical|comprehensive)\s+(study|investigation|analysis|research|approach)\s+(of|on|for|protective|enhanced|novel)\b|\b(preliminary|detailed|systematic)\s+(study|investigation|analysis)\s+[a-z]{4,}\b"

def technical_terms(text: Column, most: int = 5) -> Column:
    """The first distinct words of five letters or more that are no stop words."""
    return F.slice(F.array_distinct(F.filter(unigrams(text), lambda w: F.length(w) >= 5)), 1, most)


def falsifiability(statement: Column) -> Column:
    """0 to 1: substantive terms, observables and a stated number count for, filler and vague words against. ``statement`` is to be a plain column."""
    s = F.lower(F.coalesce(statement, F.lit("")))
    solid = F.size(F.filter(technical_terms(statement), lambda w: ~w.isin(*VAGUE_TERMS)))
    vague = F.size(F.filter(literal(VAGUE_TERMS), lambda w: F.contains(s, w)))
    plus = lambda c, v: F.when(c, v).otherwise(0.0)
    score = F.when(solid >= 2, 0.4).when(solid == 1, 0.3).when(F.size(technical_terms(statement)) > 0, 0.05).otherwise(0.0)
    score = score + plus(F.exists(literal(OBSERVABLE), lambda w: F.contains(s, w)), 0.3) + plus(s.rlike(r"≈\s*[0-9]"), 0.2) - 0.1 * F.size(F.filter(literal(FILLERS), lambda w: F.contains(s, w)))
    phrases = F.regexp_extract_all(s, F.lit(r"[a-z]{3,}[- ][a-z]{3,}"), F.lit(0))
    solid_phrase = F.exists(phrases, lambda p: ~F.exists(literal(VAGUE_TERMS), lambda v: F.contains(p, v)))
    score = score + plus(F.length(F.coalesce(statement, F.lit(""))) > 50, 0.1) - plus((vague >= 2) & ~solid_phrase & ~s.rlike(r"≈\s*[0-9]"), 0.25)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))


def content_violations(h: DataFrame) -> DataFrame:
    """``h`` with ``violations``: reasons for which the content of a hypothesis fails, [] if it passes.

    Read: statement, keywords, hypothesis_type, cross_domain, materials; nulls count as empty.
    """
    s, t = F.coalesce("statement", F.lit("")), F.coalesce("hypothesis_type", F.lit("other"))
    low = F.lower(s)
    kw = F.transform(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: k.isNotNull()), lambda k: F.lower(k))
    move = lambda k: F.trim(F.regexp_extract(low, r"from (.+?) to (.+?)(?:[,.;]|$)", k))
    pairwise = t.isin("analogy", "combination")
    checks = [
        (pairwise & (move(1) != "") & (move(1) == move(2)), "same_source_and_target"),
        (pairwise & low.rlike(r"\b(\w{2,20}) in \1\b"), "refers_to_itself"),
        (pairwise & (F.size(kw) >= 2) & (F.size(F.array_distinct(kw)) < 0.5 * F.size(kw)), "repeated_keywords"),
        (low.rlike(FRAGMENT), "title_fragment"),
        (F.coalesce("materials", F.lit(False)) & low.rlike(r"\(unknown\)|unknown structure"), "unknown_structure"),
        (F.coalesce("materials", F.lit(False)) & low.rlike(r"\bgeneral\b.*≈|general property"), "general_property"),
        (low.rlike(r"\b(\w{2,20}) and \1\b"), "twice_the_same"),
        ((t == "analogy") & F.contains(low, F.lit("transfer")) & ~F.coalesce("cross_domain", F.lit(False)), "not_across_domains"),
        (F.length(F.trim(s)) < 20, "too_short"),
    ]
    return settle(h, {"violations": F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())})


NUMBER = r"(?:^|[\s≈=(])(-?[0-9]+(?:\.[0-9]+)?)(?:[\s%,;)]|\.?$)"


def stated_bounds() -> dict[str, tuple[float, float]]:
    """Bounds by the names that statements use for properties of four letters or more."""
    out = {k.replace("_", " "): (a, b) for k, (a, b, _) in physics.bounds().items() if len(k) >= 4}
    return dict(sorted(out.items()))


def number_violations(statement: Column) -> Column:
    """Properties with a number out of their bounds near their name (50 characters before, 150 after); digits within words do not count.

    Every place of a name counts, as a whole word; places that lie within the reach of
    one before are read with it.
    """
    # Blanks are doubled, so that a number takes none from the next one.
    low = F.replace(F.lower(F.coalesce(statement, F.lit(""))), F.lit(" "), F.lit("  "))
    limits = F.array(*[F.struct(F.lit(n.replace(" ", "  ")).alias("n"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in stated_bounds().items()])
    near = lambda x: F.flatten(F.transform(F.regexp_extract_all(low, F.concat(F.lit(r"(?s).{0,50}\b"), x["n"], F.lit(r"\b.{0,150}")), F.lit(0)), lambda t: F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1))))
    bad = F.filter(F.filter(limits, lambda x: F.contains(low, x["n"])), lambda x: F.exists(near(x), lambda v: (v.try_cast("double") < x["a"]) | (v.try_cast("double") > x["b"])))
    return F.transform(bad, lambda x: F.replace(x["n"], F.lit("  "), F.lit(" ")))


def stated_range(statement: Column) -> tuple[Column, Column]:
    """Bounds read from ``a–b`` or ``≈x`` (both bounds x); null if there are none."""
    pair = r"(-?[0-9]+(?:\.[0-9]+)?)\s*[–~]\s*(-?[0-9]+(?:\.[0-9]+)?)"
    single = F.nullif(F.regexp_extract(statement, r"≈\s*(-?[0-9]+(?:\.[0-9]+)?)", 1), F.lit(""))
    low, high = (F.coalesce(F.nullif(F.regexp_extract(statement, pair, k), F.lit("")), single).try_cast("double") for k in (1, 2))
    return low, high


def merged_keywords(a: Column, b: Column, most: int = 10) -> Column:
    """Words of ``a``, then ``b``, the first of each whatever the case, at most ``most``."""
    both = F.filter(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))), lambda k: k.isNotNull())
    keep = F.aggregate(both, F.array().cast("array<string>"), lambda acc, k: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(k)), acc).otherwise(F.array_append(acc, k)))
    return F.slice(keep, 1, most)


def credibility(override: Column, assisted: Column, fallback: Column) -> Column:
    return F.when(override, "agent_override").when(assisted, "assisted").when(fallback, "fallback").otherwise("simulated")


LABELS = {"analogy": "Transfer", "combination": "Combination", "gap": "Gap", "contradiction": "Contradiction", "gap_filling": "Gap filling", "method_transfer": "Method transfer", "cross_domain": "Across domains"}


def direction_label(kind: Column, keywords: Column) -> Column:
    """The name of the kind and the first three key words that are not vague."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), F.coalesce(kind, F.lit(""))), F.lit("Direction"))
    words = F.slice(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: k.isNotNull() & ~F.lower(k).isin(*VAGUE_TERMS)), 1, 3)
    return F.concat(name, F.lit(": "), F.array_join(words, " + "))


SYNONYMS = {"thermal conductivity": ("heat conductivity", "heat transport"), "hardness": ("indentation hardness", "Vickers hardness"), "band gap": ("energy gap", "optical gap"), "ionic conductivity": ("ion conductivity", "ion transport"), "yield strength": ("yield stress", "proof stress")}


def search_queries(composition: Column, prop: Column, most: int = 5) -> Column:
    """Queries for a composition with a property and its synonyms, at most ``most``."""
    words = F.array(prop)
    for p, others in SYNONYMS.items():
        words = F.when(F.lower(prop) == p, F.concat(F.array(prop), literal(others))).otherwise(words)
    return F.slice(F.transform(words, lambda w: F.concat_ws(" ", composition, w)), 1, most)


def material_branches(pairs: DataFrame) -> DataFrame:
    """``pairs`` with branch, u (relative uncertainty) and pending, by which facts the two papers share.

    Read: valid_a, valid_b (has a usable triple), shared (property in common), value_a,
    value_b, same_structure, same_composition; nulls are false.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(False))
    both = c("valid_a") & c("valid_b")
    direct = both & c("shared") & c("value_a") & ~c("same_composition")
    cases = [
        (~c("valid_a") & ~c("valid_b"), "fallback", None, False),
        (direct & c("same_structure"), "structure_property", 0.10, False),
        (direct, "hidden_link", 0.15, False),
        (both & c("shared"), "fallback", None, False),
        (both & c("value_a") & c("value_b") & ~c("same_composition"), "hidden_link", 0.40, True),
        (c("valid_a") & ~c("valid_b") & c("value_a"), "gap_filling", 0.30, True),
    ]
    pick = F.struct(F.lit("fallback").alias("branch"), F.lit(None).cast("double").alias("u"), F.lit(False).alias("pending"))
    for when, branch, u, pending in reversed(cases):
        pick = F.when(when, F.struct(F.lit(branch).alias("branch"), F.lit(u).cast("double").alias("u"), F.lit(pending).alias("pending"))).otherwise(pick)
    return settle(pairs, {"_p": pick}).select(*pairs.columns, "_p.*")


TEMPLATES = {
    "analogy": ("Transferring {w} from {a} to {b} may improve {c}", "What {w} does in {a} suggests a use in {b} for {c}"),
    "combination": ("Combining {w} and {c} links {a} with {b}",),
    "contradiction": ("{a} and {b} disagree on {w}; the boundary lies in {c}",),
    "gap": ("The role of {w} for {c} between {a} and {b} is not reported",),
}


def template_statement(kind: Column, key: Column, **slots: Column) -> Column:
    """A statement of the kind, the template chosen by a hash of ``key``; equal a and b are written as a combination."""
    same = F.lower(slots["a"]) == F.lower(slots["b"])
    effective = F.when(same & (kind == "analogy"), "combination").otherwise(kind)

    def filled(t: str) -> Column:
        out = F.lit(t)
        for name, column in slots.items():
            out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column, F.lit("")))
        return out

    result = F.lit(None).cast("string")
    for k, options in TEMPLATES.items():
        chosen = F.element_at(F.array(*[filled(t) for t in options]), (F.pmod(F.xxhash64(key), F.lit(len(options))) + 1).cast("int"))
        result = F.when(effective == k, chosen).otherwise(result)
    return result


def policy(trials: DataFrame) -> DataFrame:
    """``trials`` with what their outcome suggests: threshold, batch and focus factor."""
    return trials.withColumns({"threshold": F.when(F.col("consistency") < 0.4, 0.05).otherwise(0.10), "batch": F.when(F.col("score") > 0.7, 30).otherwise(20), "focus": F.when(F.col("score") < 0.3, 1.5).otherwise(1.0)})


def structure_violations(composition: Column, structures: Column) -> Column:
    """Those of ``structures`` that cannot have as many elements as ``composition`` names."""
    return F.filter(structures, lambda s: stoichiometry_violation(composition, s).isNotNull())
