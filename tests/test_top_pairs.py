import math
import random
import re
from collections import Counter

import pytest

import __spark_entry__
from quillon.functions.lexicons import STOP_WORDS
from quillon.operators import tfidf


def vectors_by_hand(texts):
    """Unit vectors over the tokens within the limits n // 100 and 0.98 n, the 2,000 most frequent of them."""
    counts = {}
    for k, t in texts.items():
        w = [x for x in re.findall("[a-z]{2,}", t.lower()) if len(x) > 2 and x not in STOP_WORDS]
        counts[k] = Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])
    n, df = len(texts), Counter(t for c in counts.values() for t in c)
    kept = sorted((t for t in df if max(1, n // 100) <= df[t] <= (n if n < 20 else 0.98 * n)), key=lambda t: (-df[t], t))[:2000]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for k, c in counts.items():
        v = {t: c[t] * idf[t] for t in c if t in idf}
        norm = math.sqrt(sum(x * x for x in v.values()))
        if norm:
            out[k] = {t: x / norm for t, x in v.items()}
    return out


def best_by_hand(texts, least, most):
    v = vectors_by_hand(texts)
    keys = sorted(v)
    pairs = [(round(sum(x * v[b].get(t, 0.0) for t, x in v[a].items()), 6), a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    return sorted((-s, a, b) for s, a, b in pairs if s >= least)[:most]


def corpus():
    """A third of near copies of one text, exact copies, the rest unlike each other."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    words = [word() for _ in range(150)]
    base = [rng.choice(words) for _ in range(60)]
    texts = {f"n{i:03}": " ".join([*base[: 60 - i % 5], word()]) for i in range(100)}
    texts |= {f"c{i:03}": " ".join(base[:30]) for i in range(6)}
    return texts | {f"u{i:03}": " ".join(rng.choice(words) for _ in range(30)) for i in range(200)}


def same(rows, want):
    assert [(r.paper_id_a, r.paper_id_b) for r in rows] == [(a, b) for _, a, b in want]
    assert [r.similarity for r in rows] == pytest.approx([-s for s, _, _ in want], abs=2e-6)


def test_near_copies_of_common_tokens_are_the_most_similar_pairs(spark, tmp_path):
    texts = corpus()
    rows = [(k, None, t, 1) for k, t in texts.items()] + [("empty", None, None, 1)]
    spark.createDataFrame(rows, "paper_id string, title string, abstract string, ingested_at int").write.parquet(str(tmp_path / "papers.parquet"))
    queries = __spark_entry__.queries()
    same(queries["pair_cosine_topk"](spark, str(tmp_path)).collect(), best_by_hand(texts | {"empty": ""}, 0.3, 200))
    v = vectors_by_hand(texts | {"empty": ""})
    got = {}
    for r in queries["tfidf_topk_per_paper"](spark, str(tmp_path)).collect():
        got.setdefault(r.paper_id, []).append((r.rn, r.token, r.w))
    assert set(got) == set(v)
    for k, rows in got.items():
        want = sorted((-round(w, 9), t) for t, w in v[k].items())[:5]
        assert [t for _, t, _ in sorted(rows)] == [t for _, t in want]


@pytest.mark.parametrize("most", [10, 60, 2000])
def test_neighbours_and_blocks_find_the_same(spark, monkeypatch, most):
    monkeypatch.setattr(tfidf, "BLOCK", 40)
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "paper_id string, t string")
    counts = tfidf.term_counts(docs, "paper_id", "t")
    same(tfidf.top_pairs(counts, tfidf.vocabulary(counts, len(texts)), "paper_id", 0.3, most).collect(), best_by_hand(texts, 0.3, most))
