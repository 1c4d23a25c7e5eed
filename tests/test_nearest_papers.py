"""The first papers of each key, without all pairs of a key and a paper."""

import random

import pytest

from quillon.operators import gaps
from quillon.plans import graph_queries, statement_queries

PAPER = "paper_id string, title string, abstract string"
DAY = "timestamp'2024-01-01'"


def brute(needles, papers, most):
    """By key the first ``most`` (hits, paper) of two hits or more, or of one and the key's own word."""
    out = {}
    for key, words, own in needles:
        found = []
        for paper, title in papers:
            held = set(title.split())
            hits = len({w.lower().strip() for w in words if w} & held)
            if hits >= 2 or hits == 1 and own and own.lower() in held:
                found.append((-hits, paper))
        out |= {(key, p): -h for h, p in sorted(found)[:most]}
    return out


@pytest.mark.parametrize("few", [gaps.FEW, 0])
def test_as_all_pairs_ranked(spark, monkeypatch, few):
    monkeypatch.setattr(gaps, "FEW", few)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    papers = [(f"p{i:03}", " ".join(rng.sample(words, rng.randrange(0, 9)))) for i in range(150)]
    needles = [(f"h{i:02}", [rng.choice([w, w.upper(), f" {w} "]) for w in rng.sample([*words, "none"], rng.randrange(0, 6))] + [None], rng.choice([None, "W3", "w7", "none"])) for i in range(40)]
    needles += [(f"l{i}", rng.sample(words, 11), rng.choice([None, *words])) for i in range(4)] + [("own", ["w1", "w2"], "W2")]
    df = spark.createDataFrame(needles, "h string, k array<string>, own string")
    p = spark.createDataFrame([(i, t, None) for i, t in papers], PAPER).repartition(5)
    for most in (1, 4):
        got = {(r.h, r.paper_id): r.hits for r in gaps.nearest(df, "h", "k", p, most, own="own").collect()}
        assert got == brute(needles, papers, most)
    got = {(r.h, r.paper_id): r.hits for r in gaps.nearest(df, "h", "k", p, 3).collect()}
    assert got == brute([(h, k, None) for h, k, _ in needles], papers, 3)
    assert gaps.nearest(df.limit(0), "h", "k", p, 3).count() == 0 and gaps.nearest(df, "h", "k", p.limit(0), 3).count() == 0


@pytest.fixture
def tables(spark, tmp_path):
    """Sixty gaps with three words each that all of sixty papers hold."""
    spark.range(60).selectExpr("concat('p', id + 100) as paper_id", "concat('BaTiO3 tape ', id) as title", "'hardness' as abstract", f"{DAY} as ingested_at").write.parquet(f"{tmp_path}/papers.parquet")
    spark.range(60).selectExpr("concat('h', id + 100) as hypothesis_id", "'gap' as hypothesis_type", "concat('The gap of number ', id, ' here') as statement", "array('BaTiO3', 'tape', 'hardness', concat('g', id)) as keywords", "'p100' as paper_a_id", "'p101' as paper_b_id", f"{DAY} as created_at").write.parquet(f"{tmp_path}/hypotheses.parquet")
    spark.range(1).selectExpr("id as triple_id", "'BaTiO3' as composition", "'cubic' as structure", "'hardness' as property_name", "1.0D as property_value", "'p159' as source_paper_id", f"{DAY} as loaded_at").write.parquet(f"{tmp_path}/csp_triples.parquet")
    spark.range(1).selectExpr("'hardness' as property_name", "'hardness' as label").write.parquet(f"{tmp_path}/property_terms.parquet")
    return str(tmp_path)


@pytest.fixture
def kept(monkeypatch):
    """The numbers of rows that are written to the checkpoint folder; fails where all pairs are asked for."""
    rows, cut = [], gaps.cut

    def counted(df):
        done = cut(df)
        rows.append(done.count())
        return done

    for module in (gaps, statement_queries):
        monkeypatch.setattr(module, "cut", counted)
    monkeypatch.setattr(gaps, "mentions", None)
    return rows


def test_counter_evidence_keeps_no_pairs(spark, tables, kept):
    got = {}
    for r in statement_queries.counter_evidence(spark, tables).collect():
        got.setdefault(r.gap_id, set()).add((r.role, r.paper_id))
    assert set(got) == {f"h{i + 100}" for i in range(60)}
    assert all(x == {("exact_match", "p159"), *(("keyword_overlap", f"p{i}") for i in range(105, 112))} for x in got.values())
    assert max(kept) <= 60 * 13


def test_gap_support_keeps_no_pairs(spark, tables, kept):
    got = {r.hypothesis_id: (r.papers, r.n) for r in graph_queries.gap_support(spark, tables).collect()}
    assert got == {f"h{i + 100}": ("p100|p101|p102|p103|p104", 5) for i in range(60)}


def test_gap_records_keep_no_pairs(spark, tables, kept):
    got = {r.gap_id: r for r in graph_queries._gaps(spark, tables).collect()}
    assert set(got) == {"h100"}  # the first three key words of all are equal
    g = got["h100"]
    assert [(x.role, x.paper_id) for x in g.supporting] == [("source_a", "p100"), ("source_b", "p101"), *(("word_match", f"p{i}") for i in (102, 103, 104))]
    assert [(x.role, x.paper_id) for x in g.counter_evidence] == [("exact_match", "p159"), *(("keyword_overlap", f"p{i}") for i in range(105, 112))]
    assert max(kept) <= 60 * 13


def test_equal_descriptions_make_no_pairs(spark, kept):
    rows = [(f"g{i:03}", f"the same gap in {'ab'[i % 2]} words") for i in range(80)] + [("h1", "The words same gap a in"), (None, "")]
    got = gaps.distinct_gaps(spark.createDataFrame(rows, "gap_id string, description string"))
    assert {r.gap_id for r in got.collect()} == {"g000", None}
    assert max(kept[1:]) <= 2  # the table itself is kept first
