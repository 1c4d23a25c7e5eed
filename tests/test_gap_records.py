"""Gaps with evidence, duplicates, reports; greedy pairs with hubs; directions in order; nearest vectors."""

import random

import numpy as np
from pyspark.sql import functions as F

from quillon.operators import directions, gaps, pairing, vectors

HYP = "hypothesis_id string, hypothesis_type string, statement string, keywords array<string>, paper_a_id string, paper_b_id string, created_at int"
TRI = "triple_id long, composition string, structure string, property_name string, property_value double, source_paper_id string"


def inputs(spark):
    h = [("h1", "gap", "The hardness of BaTiO3 is unexplored in this structure", ["BaTiO3", "hardness", "tape"], "p1", "p2", 1), ("h2", "gap_filling", "Property of nothing known here", ["zzz"], "p1", None, 2), ("h3", "gap", "The hardness of BaTiO3 in this structure is unexplored", ["hardness", "tape", "batio3", "x"], "p3", "p4", 3), ("h4", "analogy", "no gap at all here", ["BaTiO3"], "p1", "p2", 4), ("h5", "gap", None, None, None, None, 5)]
    t = [(i, c, s, p, v, q) for i, (c, s, p, v, q) in enumerate([("BaTiO3", "perovskite", "hardness", 5.0, "p9"), ("BaTiO3", "perovskite", "band_gap", None, "p8"), ("SrTiO3", "cubic", "vickers_hardness", 1.0, "p7"), (None, None, None, None, None)])]
    p = [("p1", "BaTiO3 tape", "hardness"), ("p5", "tape of BaTiO3", None), ("p6", "hardness only", ""), ("p9", "x", "y"), ("p2", None, None)]
    return spark.createDataFrame(h, HYP), spark.createDataFrame(t, TRI), spark.createDataFrame(p, "paper_id string, title string, abstract string")


def test_records(spark):
    h, t, p = inputs(spark)
    got = {r.gap_id: r for r in gaps.records(h, t, p).collect()}
    assert set(got) == {"h1"}
    g = got["h1"]
    assert g.gap_type == "structure_unexplored" and [(x.role, x.paper_id) for x in g.supporting] == [("source_a", "p1"), ("source_a", "p3"), ("source_b", "p2"), ("source_b", "p4"), ("word_match", "p1"), ("word_match", "p5")]
    assert ("exact_match", "p9") in [(x.role, x.paper_id) for x in g.counter_evidence]
    assert [x.triple_id for x in g.context] == [0, 1, 2] and g.why_not_known.startswith("a triple") and "hardness of BaTiO3" in g.verification_plan
    assert 0 < g.evidence <= 1 and len(g.evidence_chain) == 3
    assert gaps.records(h.limit(0), t, p).count() == 0 and gaps.records(h, t.limit(0), p.limit(0)).count() == 1


def test_resolve(spark):
    _, t, _ = inputs(spark)
    w = spark.createDataFrame([("k", "batio3"), ("k", "Band Gap"), ("k", "CUBIC"), ("l", "none"), ("m", None)], "key string, word string")
    got = {r.key: (r.composition, r.structure, r.property_name) for r in gaps.resolve(w, "key", t).collect()}
    assert got == {"k": ("BaTiO3", "cubic", "band_gap"), "l": (None, None, None), "m": (None, None, None)}


def test_near_duplicate_gaps(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(9)]
    rows = [(f"g{i:02}", " ".join(rng.sample(words, rng.randrange(3, 9)))) for i in range(60)] + [("z0", None), ("z1", "")]
    kept = []
    for k, d in rows:
        w = set((d or "")[:50].split())
        if not any(w and v and len(w & v) / len(w | v) > 0.7 for _, v in kept):
            kept.append((k, w))
    got = gaps.distinct_gaps(spark.createDataFrame(rows, "gap_id string, description string"))
    assert sorted(r.gap_id for r in got.collect()) == sorted(k for k, _ in kept) and len(kept) < 60


def test_simple_report(spark):
    h, t, _ = inputs(spark)
    entries = spark.createDataFrame([("e1", ["batio3"]), ("e2", ["BaTiO3", "x"]), ("e3", None)], "entry_id string, keywords array<string>")
    d = spark.createDataFrame([("dir_1", "bad", ["a"], 0.1, 0, 3, False), ("dir_2", "good", ["a"], 0.9, 3, 0, True)], directions.SCHEMA)
    got = [(r.gap_id, r.known_entries) for r in gaps.simple_report(h, entries, t, d).collect()]
    assert got == [("gap_h1", 2), ("gap_h2", 0), ("gap_h3", 0), ("gap_h5", 0), ("gap_dir_1", 0)]
    assert {r.directions: r.promising for r in directions.summary(d).collect()} == {2: 1}


def test_greedy_with_hubs(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("hub", f"n{i:04}", 1.0 - i / 10000) for i in range(900)] + [(f"a{rng.randrange(40):02}", f"b{rng.randrange(40):02}", rng.randrange(50) / 100) for _ in range(300)]
    rows = list(dict(((a, b), (a, b, s)) for a, b, s in rows).values())
    used, want = {}, []
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(want) < 20 and used.get(a, 0) < 2 and used.get(b, 0) < 2:
            want.append((a, b))
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
    df = spark.createDataFrame([*rows, (None, "x", 1.0), ("y", "x", None)], "a string, b string, s double")
    assert [(r.a, r.b) for r in pairing.greedy(df, "a", "b", "s", per_node=2, most=20).collect()] == want
    assert pairing.greedy(df.limit(0), "a", "b", "s").count() == 0


def test_replay_streams_each_host_in_order(spark):
    rng = random.Random(8)
    rows = [(f"h{rng.randrange(3)}", i, rng.choice(["support", "failure", "round", "hint"]), [f"k{rng.randrange(6)}" for _ in range(3)], rng.random(), 0.5, f"s{i}", "l") for i in range(200)]
    want = {}
    for host in ("h0", "h1", "h2"):
        d = directions.Directions()
        for r in rows:
            if r[0] == host:
                d.apply(r[2], r[3], r[4], r[5], r[6], r[7])
        want |= {(host, x[0]): (x[2], round(x[3], 9)) for x in d.rows()}
    rng.shuffle(rows)
    df = spark.createDataFrame([*rows, (None, 1, "support", ["a"], 0.1, 0.1, "s", "l")], "host string, turn int, kind string, keywords array<string>, score double, novelty double, source string, label string").repartition(7)
    got = {(r.host, r.direction_id): (list(r.keywords), round(r.confidence, 9)) for r in directions.replay(df, "host", ["turn"]).collect()}
    assert got == want


def test_keywords_of_directions(spark):
    df = spark.createDataFrame([("torque of a ball screw", None, ["gearbox"], "analogy"), (None, "A Perovskite film", None, "gap"), (None, None, None, None)], "s string, t string, keywords array<string>, k string")
    got = directions.technical_keywords(df, "s", "t").select("technical", directions.fallback_keywords(F.col("s"), F.col("k"), F.col("t")).alias("f")).collect()
    assert got[0].technical == ["gearbox", "ball screw", "torque"] and got[1].technical == [] and got[1].f == ["perovskite", "gap", "film"] and got[2].f == ["research"]


def test_nearest_without_a_cross_join(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(99, None)], "id long, v array<double>")
    got = vectors.nearest(df.where("id < 8"), df, "id", "v", 5)
    n = np.linalg.norm(v, axis=1)
    want = set()
    for i in range(8):
        if n[i] > 0:
            s = [(-round(float(v[i] @ v[j] / (n[i] * n[j])), 6), j) for j in range(60) if j != i and n[j] > 0]
            want |= {(i, j) for _, j in sorted(s)[:5]}
    assert {(r.query_id, r.id) for r in got.collect()} == want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()
