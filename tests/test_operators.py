import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.functions import chemistry, replies, text
from quillon.operators import components, directions, ensemble, gaps, graph, pairing, quality, search, tfidf, vectors
from quillon.sources import papers as sources


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first().r


def test_tokens(spark):
    assert one(spark, text.unigrams(F.col("v")), "The robot's ARM, an arm of 3 it") == ["robot", "arm", "arm"]
    assert one(spark, text.unigrams(F.col("v")), None) == []
    assert one(spark, text.with_bigrams(F.col("v")), ["a", "b", "c"], "array<string>") == ["a", "b", "c", "a b", "b c"]
    assert one(spark, text.with_bigrams(F.col("v")), [], "array<string>") == []


def test_keywords_titles_and_index(spark):
    assert one(spark, text.keywords(F.col("v")), '"Deep" learning, (deep) for robots; the robots!') == ["deep", "learning", "robots"]
    assert one(spark, text.title_key(F.col("v")), "A Novel towards: X-ray  Things") == "towards xray things"
    df = spark.createDataFrame([("a b  a c",)], "v string").withColumn("ix", text.inverted_index(F.col("v")))
    assert df.select(text.from_inverted_index(F.col("ix")).alias("r")).first().r == "a b a c"


def test_matched_terms_follow_the_list(spark):
    df = spark.createDataFrame([("soft gear in a train, robotic",)], "v string")
    assert df.select(text.matched_terms(F.col("v"), ("robot", "gear train", "soft")).alias("r")).first().r == ["robot", "soft"]
    assert df.select(text.matched_terms(F.regexp_replace("v", ",", ""), ("robot", "gear train"), phrases=True).alias("r")).first().r == ["robot", "gear train"]


PAPER = "paper_id string, title string, abstract string, keywords array<string>"


def test_quality(spark):
    rows = [
        ("noise", "Proceedings of the International Conference", "", ["conference"]),
        ("good", "Cable driven robot joint", "We measured torque and friction of a prototype actuator with 5 Nm load and high efficiency over time.", ["actuator"]),
        ("ident", "tr-2024-17", "", None),
        ("null", None, None, None),
    ]
    got = {r.paper_id: r for r in quality.assess(spark.createDataFrame(rows, PAPER).withColumn("score", F.lit("clash"))).collect()}
    assert got["good"].accepted and got["good"].reasons == [] and got["good"].score == pytest.approx(1.0)
    assert "insufficient_evidence" in got["noise"].reasons and "metadata_only" in got["noise"].reasons
    assert "identifier_title" in got["ident"].reasons and not got["null"].accepted
    gated = quality.gate(quality.assess(spark.createDataFrame(rows[:1] + rows[2:], PAPER)).withColumn("b", F.lit(1)), ["b"], "paper_id").collect()
    assert len(gated) == 1 and gated[0].degraded
    assert quality.assess(spark.createDataFrame([], PAPER)).count() == 0
    off = quality.assess(spark.createDataFrame(rows, PAPER), quality.QualityRules(enabled=False))
    assert off.where("not accepted").count() == 0


def test_cosine(spark):
    docs = spark.createDataFrame([("a", "red green blue"), ("b", "red green blue"), ("c", "red yellow white"), ("d", None)], "id string, t string")
    counts = tfidf.term_counts(docs, "id", "t", bigrams=False)
    v = tfidf.vectors(counts, tfidf.vocabulary(counts, 4), "id")
    sims = {(r.id_a, r.id_b): r.similarity for r in tfidf.cosine_pairs(v, "id").collect()}
    assert sims["a", "b"] == pytest.approx(1.0) and 0 < sims["a", "c"] < 1 and len(sims) == 3


def test_greedy_matches_a_plain_pass(spark):
    rng = random.Random(2)
    rows = [(f"n{rng.randrange(30):02}", f"n{rng.randrange(30):02}", round(rng.random(), 2)) for _ in range(600)]
    used, want = {}, []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(want) < 40 and used.get(a, 0) < 3 and used.get(b, 0) < 3:
            want.append((a, b, s))
            used[a] = used.get(a, 0) + 1
            used[b] = used.get(b, 0) + 1
    got = pairing.greedy(spark.createDataFrame(rows, "a string, b string, s double"), "a", "b", "s", per_node=3, most=40)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_pair_kinds(spark):
    rows = [
        ("cross", 0.2, "x", "y", ["alloy", "k"], ["k", "z"]), ("nobridge", 0.2, "x", "y", ["a"], ["b"]), ("method", 0.2, "x", "x", ["doping"], ["wear"]), ("reverse", 0.2, "x", "x", ["wear"], ["doping"]),
        ("complement", 0.2, "x", "x", ["k", "a"], ["k", "b"]), ("direct", 0.7, "x", "x", ["k"], ["k"]), ("low", 0.07, "x", "x", ["k"], ["k"]), ("generic", 0.9, "x", "y", ["novel"], ["novel"]),
    ]
    df = spark.createDataFrame(rows, "id string, similarity double, category_a string, category_b string, kw_a array<string>, kw_b array<string>")
    got = {r.id: (r.pair_type, r.bridge) for r in pairing.evaluate(df).collect()}
    assert got == {"cross": ("cross_domain_bridge", ["k"]), "method": ("method_transfer", ["doping", "wear"]), "reverse": ("method_transfer", ["doping", "wear"]), "complement": ("concept_complement", ["k"]), "direct": ("direct_similarity", ["k"])}


HYPO = "hypothesis_id string, hypothesis_type string, statement string, keywords array<string>, cross_domain boolean, materials boolean, numeric boolean"


def test_evaluators_by_hand(spark):
    rows = [("a", "gap", "If x rises, the hardness drops above 300 K now", ["hardness", "x", "q", "z"], False, True, True), ("b", None, None, None, None, None, None), ("c", "analogy", "domain A helps", ["k"], True, False, False)]
    got = {r.hypothesis_id: r for r in ensemble.evaluate(spark.createDataFrame(rows, HYPO)).collect()}
    a = got["a"]
    assert (a.e1, a.e2, a.e4) == (0.6, pytest.approx(0.48), pytest.approx(0.6))
    n = len(rows[0][2])
    assert a.e3 == pytest.approx(1 - 0.8 * ((1 - (4 / 16 + n / 400)) - 0.15 + 0.5) / 2)
    assert a.e5 == pytest.approx(0.3 + 0.3 * 3 / 4 + 0.15 + 0.1 + 0.1) or a.e5 == pytest.approx(0.3 + 0.3 * 2 / 4 + 0.15 + 0.1 + 0.1)
    assert (got["b"].e1, got["b"].e2, got["c"].e2, got["c"].e4) == (0.6, 0.2, 0.15, 0.2)
    t = ensemble.verify(ensemble.trial(ensemble.evaluate(spark.createDataFrame(rows, HYPO)))).collect()
    assert all(0 <= r.score <= 1 and 0 <= r.stability <= 1 and (not r.discovery or r.cross_share == 1.0) for r in t)


def test_calibration(spark):
    df = spark.createDataFrame([("o", 0.9, True), ("o", 0.1, True), ("o", 0.2, False), ("o", None, True), ("p", 0.4, True)], "operator string, predicted double, passed boolean")
    got = {r.operator: r for r in ensemble.calibrate(df).collect()}
    assert got["o"].n == 3 and got["o"].accuracy == pytest.approx(2 / 3, abs=1e-6) and got["p"].weight == 0.3


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(220)] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [(None, "x"), ("s", "s")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_graph(spark):
    papers = spark.createDataFrame([("p1", ["Thin film", "x", None]), ("p2", ["x"]), ("p3", None)], "paper_id string, keywords array<string>")
    hypos = spark.createDataFrame([("h1", "p1", "gone", ["x", "new"])], "hypothesis_id string, paper_a_id string, paper_b_id string, keywords array<string>")
    e = graph.paper_edges(papers)
    h = graph.hypothesis_edges(hypos, e, papers)
    assert {(r.src, r.dst, r.relation) for r in h.collect()} == {("h1", "p1", "derives_from"), ("h1", "concept_x", "validates")}
    hops = {r.node: r.hops for r in graph.hops(e.unionByName(h), "p1").collect()}
    assert hops == {"p1": 0, "concept_thin_film": 1, "concept_x": 1, "h1": 1, "p2": 2}
    nodes = spark.createDataFrame([("p1", 1), ("concept_x", 2), ("p2", 3)], "node_id string, added_at int")
    kept, left = graph.evict(nodes, e, 2)
    assert {r.node_id for r in kept.collect()} == {"concept_x", "p2"} and left.count() == 1


def test_directions_event_by_event(spark):
    d = directions.Directions()
    d.apply("support", ["a", "b", "c"], 0.8, 0.5, "h1")
    assert d.all[0].confidence == pytest.approx(0.49)
    d.apply("support", ["a", "b", "d"], 0.9, 0.5, "h2")
    assert len(d.all) == 1 and d.all[0].support == 2 and d.all[0].promising and d.all[0].keywords == ["a", "b", "c", "d"]
    d.apply("failure", ["a", "b"])
    assert d.all[0].failures == 1 and d.all[0].confidence == pytest.approx(0.54)
    d.apply("hint", ["z"])
    assert d.all[1].confidence == 0.2 and not d.all[1].promising
    d.apply("round", None)
    assert d.all[0].confidence == pytest.approx(0.54 * 0.995)
    t0 = datetime(2024, 1, 1)
    rows = [("h", t0 + timedelta(1), "failure", ["a"], 0.0, 0.0, "2", "t"), ("h", t0, "support", ["a"], 1.0, 0.0, "1", "t")]
    df = spark.createDataFrame(rows, "host string, at timestamp, kind string, keywords array<string>, score double, novelty double, source string, label string")
    r = directions.replay(df, "host", ["at"]).first()
    assert (r.support, r.failures, round(r.confidence, 3)) == (1, 1, 0.4)


def test_support_against_brute_force(spark):
    rng = random.Random(6)
    words = ["alloy", "thin film", "x9.5", "wear", "grain", "film", "Zr"]
    papers = [(f"p{i}", " ".join(rng.choice(words + ["and", "of"]) for _ in range(6)), None if i % 5 == 0 else " ".join(rng.choice(words) for _ in range(4))) for i in range(40)]
    hypos = [(f"h{i}", rng.sample(words, 3) + [None, " "]) for i in range(6)]
    got = {(r.h, r.paper_id): r.hits for r in gaps.mentions(spark.createDataFrame(hypos, "h string, k array<string>"), "h", "k", spark.createDataFrame(papers, "paper_id string, title string, abstract string")).collect()}
    want = {}
    for h, ks in hypos:
        for p, t, a in papers:
            doc = f"{t} {a or ''}".lower()
            hits = sum((k.lower() in doc.split()) if " " not in k else (k.lower() in doc) for k in ks if k and k.strip())
            if hits:
                want[h, p] = hits
    assert got == want


def test_search_invariants(spark):
    t = spark.createDataFrame([("LiFeO2", "perovskite", "hardness", 1.0, "p"), ("SiC", "wurtzite", "hardness", None, "q"), ("NaCl", None, "band_gap", 2.0, None)], "composition string, structure string, property_name string, property_value double, source_paper_id string")
    a = search.search(t, ["hardness", "band_gap"], generations=3, parents=3, population=8).collect()
    b = search.search(t, ["hardness", "band_gap"], generations=3, parents=3, population=8).collect()
    assert [tuple(r) for r in a] == [tuple(r) for r in b] and len({r.candidate_id for r in a}) == len(a) <= 8 and max(r.generation for r in a) > 0
    assert all(0 <= r.fitness <= 1 for r in a)
    assert search.search(t.limit(0), ["hardness"], generations=1).count() == 0


def test_nearest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0])], "i int, v array<double>")
    got = [tuple(r)[:2] for r in vectors.nearest(df.where("i = 0"), df, "i", "v", 2).orderBy("similarity", ascending=False).collect()]
    assert got == [(0, 1), (0, 2)]


def test_formulas(spark):
    assert one(spark, chemistry.formulas(chemistry.plain_formula(F.col("v"))), "Li₀.₅FeO$_{2}$ and H2O, THE MIT and Li0.5FeO2") == ["Li0.5FeO2", "H2O"]
    assert one(spark, chemistry.sentences(F.col("v")), "It is 3.5 K. Short. Then; more of it") == ["It is 3.5 K", "more of it"]
    df = spark.createDataFrame([("NaCl", "rocksalt"), ("C", "rocksalt"), ("ABCDE", "perovskite"), ("X", None)], "c string, s string")
    assert [r.r for r in df.select(chemistry.stoichiometry_violation(F.col("c"), F.col("s")).alias("r")).collect()] == [None, "too_few_elements", "too_many_elements", None]


def test_replies(spark):
    good = '[{"composition": "SiC", "property": "hardness", "value": "3"}]'
    cases = [good, f"Sure!\n```json\n{good}\n```", f"so {good} ok", good.replace("}]", "},]"), '{"composition": "SiC", "property": "hardness", "value": "3"} and more', "nothing", None]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", replies.parse_list(F.col("t")).alias("r")).orderBy("i").collect()
    assert [None if r.r is None else [x.composition for x in r.r] for r in rows] == [["SiC"]] * 5 + [[], None]


def test_sources(spark):
    page = '{"results": [{"id": "https://x/W1", "display_name": "T", "abstract_inverted_index": {"b": [1], "a": [0, 2]}, "publication_year": 2020, "authorships": [{"author": {"display_name": "Z"}}], "concepts": [{"display_name": "c", "score": 0.5}]}, {"id": "https://x/W2", "display_name": null}]}'
    r = sources.from_openalex(spark.createDataFrame([(page,), ("broken",), (None,)], "body string")).collect()
    assert len(r) == 1 and r[0].paper_id == "openalex_W1" and r[0].abstract == "a b a" and r[0].year == 2020
    page = '{"data": [{"doc_id": "1", "title": "T", "abstract": "", "chunk": "passage", "topic": "{\\"display_name\\": \\"phys\\"}"}, {"doc_id": "2", "title": "T", "abstract": "x"}]}'
    r = sources.from_sciverse(spark.createDataFrame([(page,)], "body string")).collect()
    assert len(r) == 1 and r[0].abstract == "passage" and r[0].categories == ["phys"]
    feed = '<feed><entry><id>http://a/abs/2401.1v2</id><title>An  entry</title><summary>Text here</summary><published>2024-01-02</published><author><name>N</name></author><category term="cs.LG"/></entry></feed>'
    r = sources.from_atom(spark.createDataFrame([(feed,)], "body string")).collect()
    assert len(r) == 1 and r[0].paper_id == "arxiv_2401.1" and r[0].year == 2024 and r[0].title == "An entry"
    m = sources.manual(spark, [{"title": "Mine"}])
    assert m.first().paper_id.startswith("manual_")
    assert sources.fresh(m, m).count() == 0
    corpus = sources.manual(spark, [{"paper_id": f"paper_{i}", "title": str(i)} for i in range(10)])
    first, second = ({r.paper_id for r in sources.offline_batch(corpus, 4, c).collect()} for c in (0, 4))
    assert len(first) == len(second) == 4 and not first & second
    v = sources.variants(corpus).collect()
    assert len({r.paper_id for r in v}) == 10 and all(2018 <= r.year <= 2025 for r in v)


def test_submitted_triples(spark):
    rows = spark.createDataFrame([("SiC", "", "hardness", "3.5", "GPa", 1), ("SiC", "unknown", "hardness", "9", "GPa", 2), ("SiC", None, None, "1", None, 3), ("AlN", "wurtzite", "band_gap", "n/a", "eV", 4), ("Old", "s", "p", "1", "", 5)], "composition string, structure string, property_name string, property_value string, property_unit string, ord int")
    known = spark.createDataFrame([("Old", "s", "p")], "composition string, structure string, property_name string")
    got = {r.composition: r for r in sources.submitted_triples(rows, known).collect()}
    assert set(got) == {"SiC", "AlN"} and got["SiC"].property_value == 3.5 and got["AlN"].property_value is None
