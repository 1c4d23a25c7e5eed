import pytest
from pyspark.sql import functions as F

from quillon.operators import gaps, statements


def violations(spark, **row):
    base = {"statement": None, "keywords": None, "hypothesis_type": None, "cross_domain": None, "materials": None} | row
    df = spark.createDataFrame([tuple(base.values())], "statement string, keywords array<string>, hypothesis_type string, cross_domain boolean, materials boolean")
    return statements.content_violations(df).first().violations


@pytest.mark.parametrize(
    "row, reason",
    [
        ({"statement": "Moving the idea from Robotics to robotics, it improves", "hypothesis_type": "analogy"}, "same_source_and_target"),
        ({"statement": "The creep in creep explains why the film is hard", "hypothesis_type": "combination"}, "refers_to_itself"),
        ({"statement": "A long enough statement of something", "hypothesis_type": "analogy", "keywords": ["a", "A", "a", "a", "A"]}, "repeated_keywords"),
        ({"statement": "A numerical investigation of films in general use"}, None),
        ({"statement": "A theoretical study of something else entirely"}, "title_fragment"),
        ({"statement": "The band gap of SiC (unknown) drops below 2 eV", "materials": True}, "unknown_structure"),
        ({"statement": "Both wear and wear explain what is going on"}, "twice_the_same"),
        ({"statement": "A transfer of growth recipes raises the hardness", "hypothesis_type": "analogy", "cross_domain": False}, "not_across_domains"),
        ({"statement": "Too short"}, "too_short"),
        ({}, "too_short"),
    ],
)
def test_content(spark, row, reason):
    got = violations(spark, **row)
    assert reason in got if reason else "twice_the_same" not in got


def test_numbers_and_ranges(spark):
    rows = [("the hardness of SiC2 reaches 900 GPa",), ("the hardness reaches 30 GPa",), ("band gap ≈3.5 eV",), ("hardness 5–7 GPa",), (None,)]
    low, high = statements.stated_range(F.col("s"))
    got = spark.createDataFrame(rows, "s string").select(statements.number_violations(F.col("s")).alias("v"), low.alias("low"), high.alias("high")).collect()
    assert [tuple(r) for r in got] == [(["hardness"], None, None), ([], None, None), ([], 3.5, 3.5), ([], 5.0, 7.0), ([], None, None)]


def test_falsifiability_bounds(spark):
    rows = [("Doping zirconia raises the hardness, expected ≈ 12 GPa above the threshold",), ("x",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(statements.falsifiability(F.col("s"))).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] == 0.0


def test_words_labels_and_queries(spark):
    df = spark.createDataFrame([(["Alpha", None, "b"], ["ALPHA", "c"])], "a array<string>, b array<string>")
    assert df.select(statements.merged_keywords(F.col("a"), F.col("b"))).first()[0] == ["Alpha", "b", "c"]
    assert df.select(statements.direction_label(F.lit("gap"), F.array(F.lit("model"), F.lit("zinc"), F.lit("wear")))).first()[0] == "Gap: zinc + wear"
    assert df.select(statements.search_queries(F.lit("SiC"), F.lit("hardness"))).first()[0] == ["SiC hardness", "SiC indentation hardness", "SiC Vickers hardness"]
    assert df.select(statements.credibility(F.lit(False), F.lit(True), F.lit(True))).first()[0] == "assisted"


def test_branches(spark):
    t, f = True, False
    rows = [(f, f, f, f, f, f, f), (t, t, t, t, t, t, f), (t, t, t, t, t, f, f), (t, t, t, f, t, t, f), (t, t, f, t, t, f, f), (t, f, f, t, f, f, f), (f, t, f, f, t, f, f), (None,) * 7]
    df = spark.createDataFrame(rows, "valid_a boolean, valid_b boolean, shared boolean, value_a boolean, value_b boolean, same_structure boolean, same_composition boolean")
    got = [(r.branch, r.u, r.pending) for r in statements.material_branches(df).collect()]
    assert got == [("fallback", None, f), ("structure_property", 0.1, f), ("hidden_link", 0.15, f), ("fallback", None, f), ("hidden_link", 0.4, t), ("gap_filling", 0.3, t), ("fallback", None, f), ("fallback", None, f)]


def test_templates(spark):
    df = spark.createDataFrame([("analogy", "k", "w", "c", "A", "B"), ("analogy", "k", "w", "c", "A", "a"), ("gap", "k", None, "c", "A", "B"), ("other", "k", "w", "c", "A", "B")], "t string, key string, w string, c string, a string, b string")
    got = [r[0] for r in df.select(statements.template_statement(F.col("t"), F.col("key"), w=F.col("w"), c=F.col("c"), a=F.col("a"), b=F.col("b"))).collect()]
    assert "A" in got[0] and "B" in got[0] and got[1].startswith("Combining w and c") and got[2].startswith("The role of  for c") and got[3] is None


def test_counter_evidence(spark):
    g = spark.createDataFrame([("g1", "SiC", "hardness"), ("g2", None, None)], "gap_id string, composition string, property_name string")
    t = spark.createDataFrame([("sic", "Hardness", 3.0, "p1"), ("SiC", "hardness", None, "p2"), ("SiC", "band_gap", 1.0, "p3"), ("SiC", "hardness", 2.0, "s1")], "composition string, property_name string, property_value double, source_paper_id string")
    m = spark.createDataFrame([("g1", "p1", 2, True), ("g1", "p4", 3, False), ("g1", "p5", 1, True), ("g1", "p6", 1, False), ("g1", "s1", 5, True), ("g2", "p4", 2, False)], "gap_id string, paper_id string, hits long, has_composition boolean")
    s = spark.createDataFrame([("g1", "s1")], "gap_id string, paper_id string")
    got = {(r.gap_id, r.paper_id): r.role for r in gaps.counter_evidence(g, t, m, s).collect()}
    assert got == {("g1", "p1"): "exact_match", ("g1", "p4"): "keyword_overlap", ("g1", "p5"): "composition_covered", ("g2", "p4"): "keyword_overlap"}
    assert gaps.counter_evidence(g, t, m, s, most=2).where("gap_id = 'g1'").count() == 2


def test_policy(spark):
    got = statements.policy(spark.createDataFrame([(0.8, 0.9), (0.2, 0.1)], "score double, consistency double")).collect()
    assert [(r.threshold, r.batch, r.focus) for r in got] == [(0.10, 30, 1.0), (0.05, 20, 1.5)]
