"""The engine as one object: tables in, DataFrames out. Stages are pure; feedback is data."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import short_id
from quillon.operators import directions, ensemble, gaps, generation, graph, history, pairing, quality, reports, search, statements, tfidf
from quillon.session import cut
from quillon.sources import lookups
from quillon.sources import papers as sources


@dataclass(frozen=True)
class Settings:
    """Limits of one round and thresholds; ``quick`` and ``production`` are presets."""

    papers: int = 20
    pairs: int = 50
    hypotheses: int = 10
    trials: int = 20
    per_paper: int = 5
    retries: int = 3
    domain_words: tuple[str, ...] = ()
    gated: bool = False
    rules: quality.QualityRules = field(default_factory=quality.QualityRules)

    @classmethod
    def quick(cls) -> Settings:
        return cls(papers=20, pairs=20, hypotheses=8, trials=15)

    @classmethod
    def production(cls) -> Settings:
        return cls(papers=50, pairs=100, hypotheses=20, trials=40)


class Engine:
    """Stages of discovery over tables: crawl, pair, hypothesize, trial, verify, and the reads over their results."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], settings: Settings | None = None, client: generation.Client | None = None):
        self.spark, self.tables, self.settings, self.client = spark, dict(tables), settings or Settings(), client
        self.feedback = {"focus": [], "force_pass": [], "force_fail": [], "hints": []}
        self.events: list[tuple[float, str, str]] = []
        self.handlers: list[tuple[str, Callable[[str, str], None]]] = []
        self.round, self.errors, self.running = 0, 0, False

    def give(self, **feedback: list[str]) -> None:
        """Feedback between stages: ids to focus on, to pass or to fail, and hinted key words."""
        unknown = set(feedback) - set(self.feedback)
        if unknown:
            raise ValueError(f"unknown feedback: {sorted(unknown)}")
        for k, v in feedback.items():
            self.feedback[k] = list(v)

    def _table(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(f"stage needs the table {name!r}")
        return self.tables[name]

    def add_papers(self, rows: list[dict]) -> DataFrame:
        new = sources.fresh(sources.manual(self.spark, rows), self._table("papers"))
        self.tables["papers"] = self._table("papers").unionByName(new, allowMissingColumns=True)
        return new

    def crawl(self, cursor: int = 0) -> DataFrame:
        """The papers of one round that pass the gate."""
        batch = sources.offline_batch(self._table("papers").dropDuplicates(["paper_id"]), self.settings.papers, cursor)
        assessed = quality.assess(batch, self.settings.rules).withColumn("batch", F.lit(cursor))
        self.tables["accepted"] = quality.gate(assessed, ["batch"], "paper_id")
        return self.tables["accepted"]

    def pair(self) -> DataFrame:
        """Pairs of accepted papers by TF-IDF, kind and bridge, chosen greedily; focused papers come first."""
        p = self._table("accepted")
        docs = p.select("paper_id", F.concat_ws(". ", "title", "abstract", F.array_join(F.coalesce("keywords", F.array().cast("array<string>")), " ")).alias("t"), pairing.primary(F.col("categories")).alias("category"), pairing.folded(F.col("keywords")).alias("kw"))
        counts = cut(tfidf.term_counts(docs, "paper_id", "t"))
        vecs = tfidf.vectors(counts, tfidf.vocabulary(counts, docs.count()), "paper_id")
        sim = tfidf.cosine_pairs(vecs, "paper_id")
        if "pairs" in self.tables:
            sim = sim.join(self.tables["pairs"].select("paper_id_a", "paper_id_b"), ["paper_id_a", "paper_id_b"], "left_anti")
        side = lambda s: docs.select(F.col("paper_id").alias(f"paper_id_{s}"), F.col("category").alias(f"category_{s}"), F.col("kw").alias(f"kw_{s}"))
        judged = cut(pairing.evaluate(sim.join(side("a"), "paper_id_a").join(side("b"), "paper_id_b")))
        chosen = pairing.greedy(judged, "paper_id_a", "paper_id_b", "similarity", per_node=self.settings.per_paper, most=self.settings.pairs)
        focus = F.col("paper_id_a").isin(self.feedback["focus"]) | F.col("paper_id_b").isin(self.feedback["focus"])
        self.tables["pairs"] = cut(judged.join(chosen.select("paper_id_a", "paper_id_b"), ["paper_id_a", "paper_id_b"], "left_semi").withColumn("focused", focus).orderBy(F.desc("focused"), F.desc("similarity"), "paper_id_a", "paper_id_b"))
        return self.tables["pairs"]

    def _triples(self) -> DataFrame:
        t = self._table("triples")
        made = {c: F.lit(None).cast("string") for c in ("property_unit", "source_paper_id") if c not in t.columns}
        if "triple_id" not in t.columns:
            made["triple_id"] = F.xxhash64("composition", "structure", "property_name")
        return t.withColumns(made) if made else t

    def hypothesize(self) -> DataFrame:
        """Hypotheses of the pairs: a model's where there is a client and it gives a valid one, else from triples, else from templates; focused pairs first."""
        p = self._table("accepted")
        side = lambda s: p.select(F.col("paper_id").alias(f"paper_id_{s}"), F.col("title").alias(f"paper_{s}_title"), F.col("keywords").alias(f"paper_{s}_keywords"), F.col("abstract").alias(f"paper_{s}_abstract"))
        pairs = self._table("pairs").join(side("a"), "paper_id_a").join(side("b"), "paper_id_b")
        pairs = pairs.select(short_id("pair_", F.col("paper_id_a"), F.col("paper_id_b")).alias("pair_id"), F.col("paper_id_a").alias("paper_a_id"), F.col("paper_id_b").alias("paper_b_id"), *[f"paper_{s}_{c}" for s in "ab" for c in ("title", "keywords", "abstract")], "similarity", "cross_domain", "pair_type", F.col("bridge").alias("bridge_keywords"), F.col("reason").alias("connection_reason"), "category_a", "category_b", "focused")
        pairs = cut(pairs)
        s = self.settings
        options = {"domain_words": list(s.domain_words), "rules": s.rules if s.gated else None}
        # With triples the material way, which falls back on templates.
        made = generation.material(pairs, self._triples(), **options) if "triples" in self.tables else generation.general(pairs, **options)
        if self.client is not None:
            prompt = F.concat_ws("\n", F.lit("State one falsifiable hypothesis that links these papers, as JSON."), "paper_a_title", "paper_a_abstract", "paper_b_title", "paper_b_abstract", "connection_reason")
            told = cut(generation.accepted_replies(generation.ask(pairs.withColumn("prompt", prompt), "prompt", self.client)))
            made = told.unionByName(made.join(told.select("pair_id"), "pair_id", "left_anti"), allowMissingColumns=True)
        made = made.withColumns({"materials": F.lit("triples" in self.tables), "numeric": F.coalesce("numeric", F.lit(False)) if "numeric" in made.columns else F.lit(False)})
        ranked = made.join(pairs.select("pair_id", "focused"), "pair_id")
        self.tables["hypotheses"] = cut(ranked.orderBy(F.desc("focused"), F.desc("similarity"), "hypothesis_id").limit(s.hypotheses))
        self.publish("hypothesis.generated", str(s.hypotheses))
        return self.tables["hypotheses"]

    def trial(self) -> DataFrame:
        """Trials of the hypotheses behind the gates of content and numbers, with forced verdicts applied; focused ones first, as many as a round takes."""
        h = self._table("hypotheses")
        if "trials" not in self.tables:
            h = h.limit(self.settings.trials)
        h = statements.content_violations(h).withColumn("number_violations", F.when(F.coalesce("materials", F.lit(False)), statements.number_violations(F.col("statement"))).otherwise(F.array().cast("array<string>")))
        if self.client is not None:
            prompt = F.concat(F.lit("Score this hypothesis from 0 to 1, as JSON.\n"), "statement")
            h = generation.ask(h.withColumn("_p", prompt), "_p", self.client, "_r").withColumn("model_score", F.get(generation.parse_list(F.col("_r"), generation.SCORE), F.lit(0))["score"]).drop("_p", "_r")
        weights = {r["operator"]: r["weight"] for r in self.tables["weights"].collect()} if "weights" in self.tables else None
        t = ensemble.trial(ensemble.evaluate(h), weights)
        forced = F.when(F.col("hypothesis_id").isin(self.feedback["force_pass"]), True).when(F.col("hypothesis_id").isin(self.feedback["force_fail"]), False)
        self.tables["trials"] = cut(t.withColumn("forced", forced.isNotNull()).withColumn("passed", F.coalesce(forced, "passed")))
        return self.tables["trials"]

    def verify(self) -> DataFrame:
        """Reports of the trials that passed; forced passes are kept apart and are never discoveries."""
        v = ensemble.verify(self._table("trials").where("passed"))
        self.tables["verified"] = v.withColumn("discovery", F.col("discovery") & ~F.col("forced")).withColumn("level", F.when(F.col("forced"), "override").otherwise(F.col("level")))
        return self.tables["verified"]

    def learn(self) -> None:
        """What a round leaves: entries of knowledge, weights of evaluators, and the feedback taken back."""
        t = self._table("trials").select(F.col("hypothesis_id").alias("entry_id"), "hypothesis_type", "statement", "keywords", "passed", "score", "novelty", F.current_timestamp().alias("ts"))
        self.tables["entries"] = cut(history.upsert(self.tables["entries"], t) if "entries" in self.tables else t)
        long = self._table("trials").select("passed", F.explode(F.array(*[F.struct(F.lit(o).alias("operator"), F.col(f"e{i}").alias("predicted")) for i, o in enumerate(ensemble.OPERATORS, 1)])).alias("x")).select("passed", "x.*")
        fresh = ensemble.calibrate(long).select("operator", "weight")
        self.tables["weights"] = cut(history.blended_weights(self.tables["weights"], fresh) if "weights" in self.tables else fresh)
        self.feedback = {k: [] for k in self.feedback}

    def step(self) -> dict[str, int]:
        """One round of all stages: papers, pairs, hypotheses, trials, discoveries."""
        self.publish("cycle.started", str(self.round))
        self.crawl(self.round * self.settings.papers)
        for t in ("pairs", "hypotheses", "trials", "verified"):
            self.tables.pop(t, None)
        self.pair(), self.hypothesize(), self.trial(), self.verify()
        out = {"papers": self.tables["accepted"].count(), "pairs": self.tables["pairs"].count(), "hypotheses": self.tables["hypotheses"].count(), "passed": self.tables["trials"].where("passed").count(), "discoveries": self.tables["verified"].where("discovery").count()}
        self.learn()
        self.round += 1
        self.publish("cycle.finished", json.dumps(out))
        return out

    def run_cycles(self, rounds: int, *, pause: float = 0.0, most_errors: int = 10, after: Callable[[dict], None] | None = None) -> list[dict[str, int]]:
        """``rounds`` rounds; an error costs its round, ``most_errors`` in a row end the run, ``stop`` ends it after the round."""
        self.running, self.errors, out = True, 0, []
        for _ in range(rounds):
            if not self.running:
                break
            try:
                out.append(self.step())
                self.errors = 0
                if after:
                    after(out[-1])
            except Exception as e:  # noqa: BLE001  a round that fails is reported, the run goes on
                self.errors += 1
                self.round += 1
                self.publish("cycle.failed", str(e)[:200])
                if self.errors >= most_errors:
                    break
            time.sleep(pause)
        self.running = False
        return out

    def stop(self) -> None:
        self.running = False

    def subscribe(self, prefix: str, handler: Callable[[str, str], None]) -> None:
        """``handler(topic, detail)`` for topics that begin with ``prefix``; ``prefix.*`` means all below it."""
        self.handlers.append((prefix[:-1] if prefix.endswith(".*") else prefix, handler))

    def publish(self, topic: str, detail: str = "") -> None:
        """Keeps the last 500 events and tells subscribers; a handler that fails disturbs nothing."""
        self.events = [*self.events, (time.time(), topic, detail)][-500:]
        for prefix, handler in self.handlers:
            if topic.startswith(prefix):
                try:
                    handler(topic, detail)
                except Exception:  # noqa: BLE001
                    continue

    def history(self, prefix: str = "", most: int = 500) -> DataFrame:
        """The engine's events, the last first."""
        df = self.spark.createDataFrame(self.events, "ts double, topic string, detail string")
        return history.recent_events(df, prefix, most)

    def status(self) -> dict:
        return {"round": self.round, "running": self.running, "errors": self.errors, "tables": sorted(self.tables), "last": self.events[-1][1] if self.events else None}

    # Reads. Lists are short by their purpose; what they are taken from stays on the cluster.
    def knowledge(self) -> DataFrame:
        """(passed, entries, mean_score, mean_novelty, pass_rate) of the entries, one row for each verdict."""
        e = self._table("entries")
        n = e.agg(F.count("*").alias("all")).withColumn("one", F.lit(1))
        g = e.groupBy("passed").agg(F.count("*").alias("entries"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("novelty"), 4).alias("mean_novelty")).withColumn("one", F.lit(1))
        return g.join(n, "one").select("passed", "entries", "mean_score", "mean_novelty", F.round(F.col("entries") / F.greatest(F.col("all"), F.lit(1)), 4).alias("share"))

    def search_knowledge(self, word: str, most: int = 20) -> DataFrame:
        """Entries with a key word that equals, contains or stands in ``word``, passed and failed ones."""
        w = word.strip().lower()
        index = history.keyword_index(self._table("entries")).where(~F.startswith("word", F.lit("type:")) & (F.trim("word") != ""))
        hits = index.where(F.contains("word", F.lit(w)) | F.contains(F.lit(w), F.col("word"))).select("entry_id").distinct() if w else index.limit(0).select("entry_id")
        return self._table("entries").join(hits, "entry_id", "left_semi").orderBy(F.desc("score"), "entry_id").limit(most)

    def top_validated(self, most: int = 10) -> DataFrame:
        return self._table("entries").where("passed").orderBy(F.desc(F.round(0.6 * F.col("score") + 0.4 * F.coalesce("novelty", F.lit(0.0)), 9)), "entry_id").limit(most)

    def failures(self, most: int = 10) -> DataFrame:
        return self._table("entries").where("not passed").orderBy(F.desc("ts"), "entry_id").limit(most)

    def discoveries(self, most: int = 10) -> DataFrame:
        return self._table("verified").where("discovery").orderBy(F.desc("stability"), "hypothesis_id").limit(most)

    def overrides(self) -> DataFrame:
        return self._table("verified").where("level = 'override'").orderBy("hypothesis_id")

    def discovery_stats(self) -> DataFrame:
        v = self._table("verified")
        return v.agg(F.count("*").alias("verified"), F.count_if("discovery").alias("discoveries"), *[F.count_if(F.col("level") == x).alias(x) for x in ("gold", "silver", "bronze", "override")], F.round(F.avg("stability"), 6).alias("mean_stability"))

    def verification(self, hypothesis_id: str) -> DataFrame:
        return self._table("verified").where(F.col("hypothesis_id") == hypothesis_id)

    def top_pairs(self, most: int = 20) -> DataFrame:
        return self._table("pairs").orderBy(F.desc("similarity"), "paper_id_a", "paper_id_b").limit(most)

    def facts(self, composition: str = "", prop: str = "", most: int = 50) -> DataFrame:
        """Triples whose composition and property contain these, whatever the case."""
        has = lambda c, x: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(x.lower()))
        return self._triples().where(has("composition", composition) & has("property_name", prop)).orderBy("triple_id").limit(most)

    def papers_for_facts(self, most: int = 20) -> DataFrame:
        """Accepted papers of which no triple is known yet."""
        return self._table("accepted").join(self._triples().select(F.col("source_paper_id").alias("paper_id")).distinct(), "paper_id", "left_anti").orderBy("paper_id").limit(most)

    def submit_facts(self, rows: list[dict], paper_id: str | None = None) -> DataFrame:
        """Triples found outside: those that are new are added and returned."""
        names = ("composition", "structure", "property_name", "property_value", "property_unit")
        df = self.spark.createDataFrame([(*[None if r.get(n) is None else str(r[n]) for n in names], i) for i, r in enumerate(rows)], ", ".join(f"{n} string" for n in names) + ", ord int")
        new = cut(sources.submitted_triples(df, self._triples()).withColumn("source_paper_id", F.lit(paper_id)))
        self.tables["triples"] = self._table("triples").unionByName(new, allowMissingColumns=True)
        return new

    def gap_records(self, most: int = 15) -> DataFrame:
        """Gaps with supporting papers, counter-evidence, scores, chain and plan; near-duplicates once."""
        return gaps.distinct_gaps(gaps.records(self._table("hypotheses"), self._triples(), self._table("papers"))).orderBy(F.desc("rank_score"), "gap_id").limit(most)

    def gap_report(self, most: int = 10) -> DataFrame:
        """The gaps of the last five hypotheses and of directions that only failed."""
        h = self._table("hypotheses")
        h = h if "created_at" in h.columns else h.withColumn("created_at", F.lit(self.round))
        return gaps.simple_report(h, self._table("entries"), self._triples(), self._directions(), most=most)

    def validate_external(self, candidates: DataFrame, most: int = 20) -> DataFrame:
        """The first candidates with what the imported look-ups say of them."""
        return sources.lookup(candidates.limit(most), self._table("lookups"))

    def import_lookup(self, rows: list[dict]) -> DataFrame:
        """Results of external databases entered by hand; a later one for a composition and database replaces the earlier."""
        self.tables["lookups"] = lookups.imported(self.spark, rows, self.tables.get("lookups"))
        return self.tables["lookups"]

    def attention(self, stage: str) -> list[str]:
        """Reasons for which a stage's result asks for feedback; [] if it does not."""
        if stage == "crawl":
            t = self._table("accepted").agg(F.count("*").alias("n"), F.count_if(F.col("data_source") == "offline_fallback").alias("f")).first()
            checks = [(t.n == 0, "no_papers"), (t.f > 0, "fallback_papers")]
        elif stage == "pair":
            t = self._table("pairs").agg(F.count("*").alias("n"), F.count_if("cross_domain").alias("x")).first()
            checks = [(t.n == 0, "no_pairs"), (t.x > 0, "cross_domain_pairs")]
        elif stage == "hypothesize":
            t = self._table("hypotheses").agg(F.count("*").alias("n"), F.count_if("numeric").alias("x")).first()
            checks = [(t.n == 0, "no_hypotheses"), (t.n > 0 and t.x == 0, "none_numeric")]
        elif stage == "trial":
            t = self._table("trials").agg(F.count_if("passed").alias("p"), F.count_if(~F.col("passed")).alias("f")).first()
            checks = [(t.p > 0 and t.f == 0, "all_pass"), (t.f > 0 and t.p == 0, "all_fail"), (t.p > 0 and t.f > 0 and abs(t.p - t.f) <= 2, "mixed")]
        else:
            raise ValueError(f"unknown stage: {stage!r}")
        return [reason for hit, reason in checks if hit]

    def graph(self) -> DataFrame:
        e = graph.paper_edges(self._table("papers"))
        return e.unionByName(graph.hypothesis_edges(self._table("hypotheses"), e, self._table("papers")))

    def _directions(self) -> DataFrame:
        t = self._table("trials").select(F.lit("host").alias("host"), F.lit(0).alias("turn"), F.col("hypothesis_id").alias("source"), F.when(F.col("passed"), "support").otherwise("failure").alias("kind"), "keywords", "score", F.coalesce("novelty", F.lit(0.0)).alias("novelty"), F.col("hypothesis_type").alias("label"))
        if self.feedback["hints"]:
            hint = self.spark.createDataFrame([("host", 1, "hint", "hint", self.feedback["hints"], 0.0, 0.0, None)], t.schema)
            t = t.unionByName(hint)
        return directions.replay(t, "host", ["turn", "source"])

    def directions(self) -> DataFrame:
        """Directions after the trials of this engine and the hints given to it."""
        return directions.rank(self._directions())

    def gaps(self) -> DataFrame:
        h = self._table("hypotheses").where(F.col("hypothesis_type").isin("gap", "gap_filling"))
        return gaps.support(gaps.mentions(h, "hypothesis_id", "keywords", self._table("papers")), "hypothesis_id")

    def candidates(self, properties: list[str], **options: int) -> DataFrame:
        return search.search(self._table("triples"), properties, **options)

    def report(self, title: str, properties: list[str]) -> str:
        return reports.report(title, papers=self._table("papers"), assessed=self._table("accepted"), triples=self._table("triples"), pairs=self._table("pairs"), trials=self._table("trials"), verified=self._table("verified"), gaps=self.gaps(), candidates=self.candidates(properties, generations=1).select("composition", "structure", "property_name", "fitness"))

    def snapshot(self, path: str) -> None:
        """The size of every table, the five best directions and the last twenty events, as one row of JSON under ``path``."""
        top = [r.asDict() for r in self.directions().select("direction_id", "label", "confidence").limit(5).collect()] if "trials" in self.tables else []
        state = json.dumps({"tables": {k: v.count() for k, v in sorted(self.tables.items())}, "feedback": self.feedback, "directions": top, "events": self.events[-20:]})
        self.spark.createDataFrame([(state,)], "value string").write.mode("overwrite").text(path)
