import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillon.llm.setjoin import clean_set, classed, least_overlap, overlapping_pairs, set_records, similar_classes


def brute(sets, t):
    out = {}
    items = sorted(sets.items())
    for i, (a, x) in enumerate(items):
        for b, y in items[i + 1 :]:
            o = len(x & y)
            if Fraction(o, len(x | y)) >= Fraction(str(t)):
                out[a, b] = o
    return out


@pytest.mark.parametrize("t, small, top", [(0.7, 12, 9), (0.7, 5, 9), (0.5, 6, 8), (0.8, 12, 25), (0.7, 12, 30)])
def test_against_brute_force(spark, t, small, top):
    rng = random.Random(top)
    sets = {}
    for i in range(160):
        if i % 3 and sets:
            s = set(rng.choice(list(sets.values())))
            for _ in range(rng.randrange(3)):
                s.discard(rng.choice(sorted(s))) if rng.random() < 0.5 and len(s) > 1 else s.add(f"w{rng.randrange(60)}")
        else:
            s = {f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, top))}
        sets[f"k{i:03}"] = frozenset(s)
    distinct = {min(k for k, v in sets.items() if v == s): s for s in set(sets.values())}
    df = spark.createDataFrame([(k, sorted(v)) for k, v in distinct.items()], "id string, set array<string>")
    got = {(r.id_a, r.id_b): r.overlap for r in similar_classes(df, t, small=small).collect()}
    assert got == brute(distinct, t)


def test_least_overlap():
    t = Fraction("0.7")
    for a in range(1, 30):
        for b in range(1, 30):
            o = least_overlap(a, b, t)
            assert Fraction(o, a + b - o) >= t and (o == 0 or Fraction(o - 1, a + b - o + 1) < t) if o <= min(a, b) else True


def test_clean(spark):
    rows = [(1, [" A", "a", None, "", "  ", "B\t", "b"]), (2, None), (3, [])]
    got = spark.createDataFrame(rows, "i int, v array<string>").select("i", clean_set(F.col("v")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [["a", "b"], None, []]


def test_records_pairs_and_classes(spark):
    abcd = ["a", "b", "c", "d"]
    papers = spark.createDataFrame([("p1", abcd), ("p1", abcd), ("p2", abcd[::-1]), ("p3", ["a", "b", "c"]), ("p4", None), (None, abcd), ("p5", [*abcd, "e"])], "id string, v array<string>").selectExpr("*", "'c' as set", "'c' as kind", "'c' as key")
    pairs = spark.createDataFrame([("q1", abcd), ("q2", abcd), ("q3", ["x" * 20000, "y", "z", "w"])], "id string, v array<string>")
    records = set_records(papers, "id", "v", "paper").unionByName(set_records(pairs, "id", "v", "pair"))
    got = {(r.key_a, r.key_b): (r.overlap, round(r.similarity, 3)) for r in overlapping_pairs(records, 0.7, least=4, apart=("pair",)).collect()}
    assert got == {("p1", "p2"): (4, 1.0), ("p1", "q1"): (4, 1.0), ("p1", "q2"): (4, 1.0), ("p2", "q1"): (4, 1.0), ("p2", "q2"): (4, 1.0), ("p1", "p5"): (4, 0.8), ("p2", "p5"): (4, 0.8), ("p5", "q1"): (4, 0.8), ("p5", "q2"): (4, 0.8)}
    classes, members = classed(records, 4)
    assert classes.count() == 3 and members.count() == 6
    assert overlapping_pairs(records.limit(0), 0.7, least=4).count() == 0
