import random
import re

from pyspark.sql import functions as F

from quillon.llm.nearcopies import near_copies, near_pairs
from quillon.operators.components import components


def runs(text, n):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return frozenset(zip(*[w[i:] for i in range(n)]))


def brute(texts, t, n, least):
    sets = {k: runs(v, n) for k, v in texts.items()}
    keys = sorted(k for k in sets if len(sets[k]) >= least)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for g in range(25):
        base = [rng.choice(words) for _ in range(120)]
        for c in range(rng.randrange(1, 6)):
            t = list(base)
            for _ in range(rng.randrange(0, 14)):
                i = rng.randrange(len(t))
                t[i : i + 1] = rng.choice([[], [rng.choice(words)], [t[i], rng.choice(words)]])
            if rng.random() < 0.3:
                i = rng.randrange(len(t))
                t = t[i:] + t[:i]
            texts[f"{g:02}-{c}"] = " ".join(t)
    return texts


def found(spark, texts, **how):
    df = spark.createDataFrame(list(texts.items()), "id string, t string").selectExpr("*", "1 as num", "2 as size", "3 as set", "'c' as digest")
    links, members = near_copies(df, "id", F.coalesce("t", F.lit("")), **how)
    return {(r.id_a, r.id_b) for r in near_pairs(links, members, "id").collect()}, links, members


def test_three_words_half(spark):
    texts = corpus(1) | {"null": None, "empty": "", "short": "a b c", "same": None}
    texts["copy"] = texts["00-0"].upper()
    got, _, _ = found(spark, texts, threshold=0.5, words=3, least=30)
    assert got == brute(texts, 0.5, 3, 30)


def test_five_words_four_fifths(spark):
    texts = corpus(2)
    got, links, members = found(spark, texts)
    assert got == brute(texts, 0.8, 5, 1)
    groups = components(links, "a", "b")
    assert groups.count() <= members.count()


def test_edges(spark):
    long = " ".join(f"x{i}" for i in range(30000))
    got, _, members = found(spark, {"a": long, "b": long + " y", "c": "one two three four five"}, threshold=0.8)
    assert got == {("a", "b")} and members.count() == 3
    df = spark.createDataFrame([], "id string, t string")
    links, members = near_copies(df, "id", F.col("t"))
    assert links.count() == 0 and members.count() == 0


def test_a_third_of_near_copies(spark):
    base = " ".join(f"b{i}" for i in range(60))
    texts = {f"n{i:02}": base + f" e{i} f{i}" for i in range(40)} | {f"u{i:02}": " ".join(f"u{i}x{j}" for j in range(60)) for i in range(80)}
    got, _, _ = found(spark, texts, threshold=0.8, words=3, least=30)
    assert got == brute(texts, 0.8, 3, 30)


def test_families_within_a_group(spark):
    """Rare passages of single families fill the fingerprints; the text that all share still counts."""
    rng = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    texts = {}
    for f in range(30):
        family = [*base[:60], *[f"f{f}x{i}" for i in range(26)], *base[60:]]
        for c in range(3):
            t = list(family)
            t[rng.randrange(len(t))] = f"v{f}x{c}"
            texts[f"{f:02}-{c}"] = " ".join(t)
    want = brute(texts, 0.5, 3, 30)
    got, links, members = found(spark, texts, threshold=0.5, words=3, least=30)
    assert len(want) > 700 and got == want
    groups = components(links, "a", "b")
    assert groups.count() == 90 and groups.select("component").distinct().count() == 1


def test_common_half_and_rare_half(spark):
    """Records of a few share rare text, of all share a template: the template alone makes them alike."""
    rng = random.Random(3)
    template = [f"t{i}" for i in range(70)]
    texts = {}
    for f in range(40):
        rare = [f"f{f}y{i}" for i in range(24)]
        for c in range(3):
            t = [*template, *rare]
            t[rng.randrange(len(t))] = f"w{f}z{c}"
            texts[f"{f:02}-{c}"] = " ".join(t)
    want = brute(texts, 0.5, 3, 30)
    got, _, _ = found(spark, texts, threshold=0.5, words=3, least=30)
    assert len(want) > 1000 and got == want


def test_many_pairs_fetch_their_sets(spark, monkeypatch):
    monkeypatch.setattr("quillon.llm.nearcopies.FEW", 0)
    texts = corpus(4)
    assert found(spark, texts, threshold=0.5, words=3, least=30)[0] == brute(texts, 0.5, 3, 30)
