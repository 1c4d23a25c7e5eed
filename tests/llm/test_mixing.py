import random

import numpy as np
import pytest

from quillon.llm.mixing import fill, mixture, rake, shares

T = "source string, target_share double, max_repeats int"
D = "doc_id long, source string, lang string, section string, tokens long"


def test_fill_reaches_its_goal_under_the_cap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        w, t = rng.random(8), rng.integers(1, 100, 8).astype(float)
        goal = rng.random() * 3 * t.sum()
        r = fill(w, t, 3.0, goal)
        assert r.max() <= 3 + 1e-9 and abs((r * t).sum() - goal) < 1e-6 * max(goal, 1)
    assert (fill(np.ones(2), np.ones(2), 2.0, 99) == 2).all()


def test_rake_keeps_sources_exactly():
    cells = [("a", "en", "x", 100.0), ("a", "de", "y", 50.0), ("b", "en", "y", 10.0), ("c", "en", "x", 5.0)]
    r, size = rake(cells, {"a": 0.5, "b": 0.5, "gone": 0.2}, {"a": 1, "b": 4, "gone": 1})
    assert r[3] == 0 and abs(r[2] * 10 - size / 2) < 1e-6 and abs(r[0] * 100 + r[1] * 50 - size / 2) < 1e-6 and r[2] <= 4 + 1e-9


def test_mixture(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("aaaaaaaabbbc") if i % 50 else None, rng.choice(["en", "de", None]), rng.choice(["r", "s", None]), rng.randrange(0, 400)) for i in range(3000)] + [(None, "a", "en", "r", 5)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.15, 3), ("gone", 0.05, 2), (None, 0.5, 1)], T)
    docs = spark.createDataFrame(rows, D).selectExpr("*", "1 as copies", "'c' as s", "2 as bucket")
    m = mixture(docs, targets)
    got = {r.source: r for r in shares(m, targets).where("source is not null").collect()}
    for s, want in (("a", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95), ("gone", 0.0)):
        assert got[s].actual_share == pytest.approx(want, abs=0.01)
        assert got[s].most_copies <= got[s].max_repeats
    assert sorted(m.collect()) == sorted(mixture(docs, targets).collect())
    assert mixture(docs.limit(0), targets).count() == 0 and mixture(docs, targets.limit(0)).count() == 0
