"""A corpus that grows, vectors before a vocabulary, papers by mode, the checkpoint folder of a cluster."""

import json
import math

import pytest

from quillon import session
from quillon.operators import tfidf
from quillon.sources import papers as sources

DOC = "id string, t string"


def test_growing_frequencies(spark):
    one, two = spark.createDataFrame([("a", "alpha beta"), ("b", "alpha")], DOC), spark.createDataFrame([("c", "beta gamma"), ("d", None)], DOC)
    counts = lambda d: tfidf.term_counts(d, "id", "t", bigrams=False)
    known = counts(one).groupBy("token").count().withColumnRenamed("count", "df")
    df = tfidf.grown_frequencies(known, counts(two))
    assert {r.token: r.df for r in df.collect()} == {"alpha": 2, "beta": 2, "gamma": 1}
    old = tfidf.vocabulary(counts(one), 2)
    grown = {r.token: r.idf for r in tfidf.grown_vocabulary(old, df, 4).collect()}
    assert set(grown) == {"alpha", "beta", "gamma"} and abs(grown["gamma"] - (math.log(5 / 2) + 1)) < 1e-12
    assert {r.token for r in tfidf.grown_vocabulary(old, df, 4, max_features=2).collect()} == {"alpha", "beta"}


def test_hashed_vectors(spark):
    v = tfidf.hashed_vectors(spark.createDataFrame([("a", "alpha beta alpha"), ("b", "alpha beta alpha"), ("c", ""), ("d", None)], DOC), "id", "t").collect()
    by = {k: sorted((r.token, r.w) for r in v if r.id == k) for k in "abcd"}
    assert by["a"] == by["b"] != [] and by["c"] == by["d"] == [] and abs(sum(w * w for _, w in by["a"]) - 1) < 1e-12 and all(0 <= t < 128 for t, _ in by["a"])


def test_papers_by_mode(spark):
    page = json.dumps({"results": [{"id": "https://x/W1", "display_name": "One", "abstract_inverted_index": {"a": [0]}, "publication_year": 2020}]})
    pages = spark.createDataFrame([("openalex", page), ("arxiv", None)], "source string, body string")
    corpus = spark.createDataFrame([(f"paper_{i}", f"T{i}") for i in range(5)], "paper_id string, title string").selectExpr("*", *[f"cast(null as {t}) as {n}" for n, t in (x.split(" ", 1) for x in sources.SCHEMA.split(", ")) if n not in ("paper_id", "title")])
    assert sources.collected(pages, "openalex", corpus).count() == 1
    fallback = sources.collected(pages.where("body is null"), "openalex", corpus, size=3).collect()
    assert len(fallback) == 3 and {r.data_source for r in fallback} == {"offline_fallback"}
    assert {r.data_source for r in sources.collected(pages, "offline", corpus, size=2).collect()} == {"offline"}
    for mode, c in (("nonsense", corpus), ("offline", None)):
        with pytest.raises(ValueError):
            sources.collected(pages, mode, c)


def test_a_cluster_names_its_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())


def test_what_is_cut_is_not_broadcast(spark):
    a = session.cut(spark.range(100).selectExpr("id", "array(id, id) as x"))
    assert a.columns == ["id", "x"] and a.count() == 100
    plan = a.selectExpr("id", "explode(x) as y").join(a.select("id"), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
