"""Research directions as keyed state: matching by key words, support, failure, decay and hints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.lexicons import EVIDENCE_TERMS, MECHANISM_TERMS, METADATA_TERMS, STOP_WORDS
from quillon.functions.text import literal, matched_terms

MATCH, BOOST, LOSS, DECAY, LEAST, MOST = 0.25, 0.1, 0.05, 0.995, 0.05, 100
SCHEMA = "direction_id string, label string, keywords array<string>, confidence double, support int, failures int, promising boolean"


@dataclass
class Direction:
    direction_id: str
    keywords: list[str]
    confidence: float
    kind: str = ""
    support: int = 1
    failures: int = 0
    sources: list[str] = field(default_factory=list)

    @property
    def promising(self) -> bool:
        total = self.support + self.failures
        return self.confidence >= 0.5 and self.support >= 2 and (total == 0 or self.failures / total <= 0.6)


class Directions:
    """State of one stream of events in order. Kinds of event: support, failure, hint, round."""

    def __init__(self, state: Iterable[Direction] = ()):
        self.all: list[Direction] = list(state)
        self.made = len(self.all)

    def similar(self, words: list[str]) -> Direction | None:
        """The best match with a Jaccard similarity of MATCH or more; ties to the oldest."""
        mine = {w.lower() for w in words}
        best, found = MATCH, None
        for d in self.all:
            theirs = {w.lower() for w in d.keywords}
            j = len(mine & theirs) / len(mine | theirs) if mine | theirs else 0.0
            if j > best or (j == best and found is None):
                best, found = j, d
        return found

    def apply(self, kind: str, words: list[str] | None, score: float = 0.0, novelty: float = 0.0, source: str = "", label: str = "") -> None:
        words = [w for w in dict.fromkeys(words if words is not None else []) if w]
        if kind == "round":
            self.decay()
            return
        if not words:
            return
        d = self.similar(words)
        if kind == "failure":
            if d:
                d.failures += 1
                d.confidence = max(0.0, d.confidence - LOSS)
            return
        if d:
            d.confidence = min(1.0, d.confidence + (0.15 if kind == "hint" else BOOST))
            d.support += kind == "support"
            d.keywords += [w for w in words if w not in d.keywords]
            if source and source not in d.sources:
                d.sources.append(source)
            return
        start = 0.2 if kind == "hint" else min(1.0, 0.15 + 0.3 * score + 0.2 * novelty)
        self.all.append(Direction(f"dir_{self.made}", words, start, label, 0 if kind == "hint" else 1, 0, [source] if source else []))
        self.made += 1

    def decay(self, rounds: int = 1) -> None:
        """Every direction loses confidence; the weakest go, and so do those beyond MOST."""
        for d in self.all:
            d.confidence *= DECAY**rounds
        self.all = [d for d in self.all if d.confidence >= LEAST]
        if len(self.all) > MOST:
            keep = {id(d) for d in sorted(self.all, key=lambda d: -d.confidence)[:MOST]}
            self.all = [d for d in self.all if id(d) in keep]

    def rows(self) -> list[tuple]:
        return [(d.direction_id, " + ".join([d.kind, *d.keywords[:3]] if d.kind else d.keywords[:3]), d.keywords, float(d.confidence), d.support, d.failures, d.promising) for d in self.all]


def replay(events: DataFrame, host: str, order: list[str]) -> DataFrame:
    """The state of each host after all its events, in ``order``.

    ``events``: kind, keywords, score, novelty, source, label. The state depends on the
    order of one host's events, so a host is worked on in one task, in which sorted
    batches stream past a state of at most MOST directions; no host's events are held
    together. Hosts run side by side. Events with a null host are left out.
    """
    n = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [host, *[c.split()[0] for c in SCHEMA.split(", ")]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, Directions()
        for pdf in batches:
            for e in pdf.itertuples(index=False):
                if e._0 != at:
                    if at is not None:
                        yield pd.DataFrame([(at, *r) for r in state.rows()], columns=columns)
                    at, state = e._0, Directions()
                state.apply(e.kind, list(e.keywords) if e.keywords is not None else [], 0.0 if pd.isna(e.score) else e.score, 0.0 if pd.isna(e.novelty) else e.novelty, e.source, e.label or "")
        if at is not None:
            yield pd.DataFrame([(at, *r) for r in state.rows()], columns=columns)

    sorted_ = events.where(F.col(host).isNotNull()).repartition(n, host).sortWithinPartitions(host, *order)
    return sorted_.select(F.col(host).alias("_0"), "kind", "keywords", "score", "novelty", "source", "label").mapInPandas(run, f"`{host}` string, {SCHEMA}")


def summary(directions: DataFrame) -> DataFrame:
    """One row: directions, promising ones and their mean confidence (0 if there are none)."""
    return directions.agg(F.count("*").alias("directions"), F.count_if("promising").alias("promising"), F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 3).alias("mean_confidence"))


def technical_keywords(df: DataFrame, *texts: str, keywords: str = "keywords", most: int = 10) -> DataFrame:
    """``df`` with ``technical``: terms of mechanism, then of evidence, in its texts and key words; at most ``most``."""
    text = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in texts], F.col(keywords))
    return df.withColumn("technical", F.slice(F.array_distinct(F.concat(matched_terms(text, MECHANISM_TERMS, True), matched_terms(text, EVIDENCE_TERMS, True))), 1, most))


# Technical terms that stand in where a hypothesis has no key words.
FALLBACK_TERMS = (
    "transformer", "neural", "network", "learning", "optimization", "gradient", "embedding", "attention", "diffusion", "gaussian", "bayesian", "graph", "federated", "quantum", "blockchain", "reinforcement", "digital twin", "physics-informed", "causal",
    "counterfactual", "evidential", "knowledge graph", "meta-learning", "transfer", "evolutionary", "game theory", "perovskite", "catalyst", "alloy", "composite", "ceramic", "polymer", "semiconductor", "crystal", "nanostructure", "thin film", "battery",
    "electrode", "electrolyte", "bandgap", "conductivity", "magnetization", "dielectric", "piezoelectric", "thermoelectric", "photocatalysis", "corrosion", "coating", "sintering", "annealing", "doping", "deposition", "crystallization", "phase transition",
    "high-entropy alloy", "metal-organic framework", "graphene", "nanotube", "quantum dot", "superconductor", "ferroelectric", "antiferromagnetic", "paramagnetic", "piezoresistive",
)


def fallback_keywords(statement: Column, kind: Column, titles: Column, most: int = 5) -> Column:
    """Key words for a hypothesis without any: technical terms of its texts, its kind, then long words of its titles; 'research' if none."""
    text = F.lower(F.concat_ws(" ", statement, titles))
    terms = F.filter(literal(FALLBACK_TERMS), lambda t: F.contains(text, t))
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(titles, F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:!?()\[\]]+|[.,;:!?()\[\]]+$", "")), lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS, *METADATA_TERMS))
    found = F.slice(F.array_distinct(F.filter(F.concat(terms, F.array(F.nullif(kind, F.lit(""))), words), lambda w: w.isNotNull())), 1, most)
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("research")))


def rank(directions: DataFrame, most: int = 10) -> DataFrame:
    """The best directions by 0.6 confidence + 0.05 support + 0.3 if promising."""
    score = 0.6 * F.col("confidence") + 0.05 * F.col("support") + F.when(F.col("promising"), 0.3).otherwise(0.0)
    return directions.withColumn("rank_score", F.round(score, 6)).orderBy(F.desc("rank_score"), "direction_id").limit(most)
