"""Text functions as Column expressions; each stays inside generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.lexicons import METRIC_UNITS, STOP_WORDS

Words = Sequence[str]


def literal(words: Words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def whitespace_normal(text: Column) -> Column:
    """Lower case, one blank for any white space, trimmed; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def unigrams(text: Column) -> Column:
    """Runs of two or more letters, lower-cased, without stop words and words of two letters, in order; [] for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z]{2,}"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def with_bigrams(tokens: Column) -> Column:
    """Unigrams, then the pairs of neighbours. ``tokens`` is to be a plain column."""
    pairs = F.when(F.size(tokens) > 1, F.zip_with(F.slice(tokens, 1, F.size(tokens) - 1), F.slice(tokens, 2, F.size(tokens)), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(tokens, F.coalesce(pairs, F.array().cast("array<string>")))


def keywords(text: Column, most: int = 10) -> Column:
    """The first distinct words of more than three characters that are no stop words, with edge punctuation off."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))), 1, most)


# Openings that titles are compared without, taken off in this order.
TITLE_OPENINGS = ("a novel", "towards", "enhanced", "adaptive", "scalable", "robust", "efficient", "unified", "deep", "progressive")


def title_key(title: Column) -> Column:
    """A title without its openings, signs and repeated blanks; '' for null."""
    t = F.lower(F.coalesce(title, F.lit("")))
    for p in TITLE_OPENINGS:
        t = F.regexp_replace(t, f"^{p} ", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9\s]", ""), r"\s+", " "))


def matched_terms(text: Column, terms: Words, phrases: bool = False) -> Column:
    """The terms found in ``text`` (normalized) as substrings, or, with ``phrases``, word by word, in the order of ``terms``."""
    words = F.split(text, " ")

    def hit(t: Column) -> Column:
        here = F.contains(text, t)
        return here | ((F.size(F.split(t, " ")) > 1) & F.forall(F.split(t, " "), lambda w: F.array_contains(words, w))) if phrases else here

    return F.filter(literal(terms), hit)


def has_metric(text: Column) -> Column:
    """Whether a number with a unit stands in ``text``."""
    return text.rlike(r"\d+(?:\.\d+)?\s*(?:" + "|".join(METRIC_UNITS) + ")")


def inverted_index(text: Column) -> Column:
    """Map of each word of ``text`` to its positions. ``text`` is to be a plain column."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.map_from_arrays(F.array_distinct(words), F.transform(F.array_distinct(words), lambda k: F.filter(F.transform(words, lambda w, i: F.when(w == k, i)), lambda i: i.isNotNull())))


def from_inverted_index(index: Column) -> Column:
    """The text that a map of words to positions stands for; null for null, '' for an empty map."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.sort_array(at), lambda s: s["w"]), " ")


# Names of subject categories.
DOMAINS = {
    "cs.AI": "artificial intelligence", "cs.LG": "machine learning", "cs.RO": "robotics", "cs.CL": "natural language processing", "cs.CV": "computer vision", "cs.MA": "multi-agent systems", "cs.GT": "game theory", "cs.CR": "cryptography and security",
    "cs.DB": "databases", "cs.IR": "information retrieval", "cs.DC": "distributed computing", "cs.NI": "networking", "cs.NA": "numerical analysis", "stat.ML": "statistical machine learning", "stat.ME": "statistical methodology", "q-bio.QM": "quantitative biology",
    "q-bio.NC": "computational neuroscience", "physics": "physics", "physics.chem-ph": "chemical physics", "physics.flu-dyn": "fluid dynamics", "physics.comp-ph": "computational physics", "quant-ph": "quantum computing", "cond-mat.mtrl-sci": "materials science", "eess.SP": "signal processing",
}


def domain(category: Column) -> Column:
    """The name of a subject category; a category without one names itself, a missing one is 'the target domain'."""
    c = F.coalesce(category, F.lit(""))
    named = F.element_at(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv]), c)
    return F.when(c.isin("", "unknown"), "the target domain").otherwise(F.coalesce(named, c))


def without_opening(title: Column) -> Column:
    """``title`` without one of TITLE_OPENINGS and the blank behind it, whatever the case; null for null."""
    return F.regexp_replace(title, "^(?i:" + "|".join(TITLE_OPENINGS) + ") ", "")


def short_id(prefix: str, *parts: Column, length: int = 8) -> Column:
    """``prefix`` and the first characters of the MD5 of the parts joined by '|'."""
    return F.concat(F.lit(prefix), F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, length))


def set_jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)
