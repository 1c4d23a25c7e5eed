"""Hypotheses from pairs, gates of trials and verification, replies of a model."""

import json

from pyspark.sql import functions as F

from quillon.operators import ensemble as en
from quillon.operators import generation as gen
from quillon.operators import quality
from quillon.operators import statements as st

PAIR = "pair_id string, paper_a_id string, paper_b_id string, paper_a_title string, paper_b_title string, similarity double, cross_domain boolean, pair_type string, bridge_keywords array<string>, connection_reason string, paper_a_keywords array<string>, paper_b_keywords array<string>, paper_a_abstract string, paper_b_abstract string, category_a string, category_b string"


def pair(i, **over):
    row = {"pair_id": f"p{i}", "paper_a_id": f"a{i}", "paper_b_id": f"b{i}", "paper_a_title": "A Novel harmonic drive for tendons", "paper_b_title": "Fatigue of capstan cables", "similarity": 0.4, "cross_domain": True, "pair_type": "cross_domain_bridge", "bridge_keywords": ["harmonic drive", "fatigue"], "connection_reason": "why", "paper_a_keywords": ["harmonic drive"], "paper_b_keywords": ["capstan"], "paper_a_abstract": "x", "paper_b_abstract": "torque", "category_a": "cs.RO", "category_b": "cond-mat.mtrl-sci"}
    return tuple((row | over).values())


def test_general_hypotheses(spark):
    rows = [
        pair(1), pair(2, similarity=None), pair(3, similarity=0.01), pair(4, pair_type=None), pair(5, bridge_keywords=None, paper_a_keywords=None, paper_b_keywords=None), pair(None, pair_id=None),
        pair(6, paper_a_title=None, paper_b_title=None, bridge_keywords=[], paper_a_keywords=[], paper_b_keywords=[]), pair(7, category_b="cs.RO"), pair(1),
    ]
    df = spark.createDataFrame(rows, PAIR).selectExpr("*", "'c' as score", "'c' as statement", "'c' as hypothesis_type", "'c' as method_a")
    got = {r.pair_id: r for r in gen.general(df.dropDuplicates(["pair_id"])).collect()}
    assert set(got) == {"p1", "p4", "p5", "p7"}
    assert got["p1"].hypothesis_type == "analogy" and "harmonic drive" in got["p1"].statement and "robotics" in got["p1"].statement and got["p1"].keywords[:2] == ["harmonic drive", "fatigue"]
    assert got["p1"].novelty == 0.7 and got["p1"].confidence == 0.45 and got["p4"].hypothesis_type == "gap" and got["p7"].statement.count("robotics") == 0
    assert all(r.falsifiability >= 0.3 for r in got.values())
    assert gen.general(spark.createDataFrame([], PAIR)).count() == 0


def test_relevance_and_quality(spark):
    df = spark.createDataFrame([pair(1), pair(2, paper_b_abstract="about hardness")], PAIR)
    assert [r.pair_id for r in gen.relevant(df, ["Hardness"]).collect()] == ["p2"] and gen.relevant(df, []).count() == 2
    poor = quality.QualityRules()
    rich = dict(paper_a_abstract="A harmonic drive with measured torque and backlash. " * 4, paper_b_abstract="A capstan cable under fatigue with measured stiffness. " * 4)
    df = spark.createDataFrame([pair(1, paper_a_title="news", paper_a_keywords=[]), pair(2, **rich)], PAIR)
    assert [r.pair_id for r in gen.of_quality(df, poor).collect()] == ["p2"]
    assert gen.general(df, rules=poor).collect()[0].falsifiability >= 0.45


def test_method_names(spark):
    rows = [("On Sintering of tapes", ["sintering"], [], "sintering"), ("On tapes", ["novel"], ["tapes"], "tapes"), ("Deep neural maps", [], [], "neural"), ("The mapping of a design", [], [], "mapping"), (None, None, None, ""), ("a of", ["of"], [None], "")]
    df = spark.createDataFrame(rows, "t string, b array<string>, k array<string>, want string").withColumn("got", gen.method_name(F.col("t"), F.col("b"), F.col("k")))
    assert [(r.got, r.want) for r in df.collect() if r.got != r.want] == []


FACT = "triple_id long, source_paper_id string, composition string, structure string, property_name string, property_value double, property_unit string"


def test_material_hypotheses(spark):
    facts = [
        (1, "a1", "BaTiO3", "perovskite", "hardness", 10.0, "GPa"), (2, "b1", "SrTiO3", "perovskite", "hardness", None, None), (3, "a2", "BaTiO3", "perovskite", "hardness", 10.0, "GPa"), (4, "b2", "NaCl", "rocksalt", "hardness", 1.0, "GPa"),
        (5, "a3", "BaTiO3", "perovskite", "hardness", 900.0, "GPa"), (6, "b3", "SrTiO3", "perovskite", "hardness", 1.0, "GPa"), (7, "a4", "BaTiO3", "perovskite", "tc", 390.0, "K"), (8, "b4", "PbTiO3", "perovskite", "tc", 760.0, "K"), (9, "a5", "Bi2Te3", "layered", "zt", 1.0, ""), (10, "a1", "ZrO2", "fluorite", "hardness", 5.0, "GPa"),
    ]
    got = {r.pair_id: r for r in gen.material(spark.createDataFrame([pair(i) for i in range(1, 7)], PAIR), spark.createDataFrame(facts, FACT)).collect()}
    one = got["p1"]
    assert (one.hypothesis_type, one.low, one.high, one.unit, one.pending, one.fallback) == ("structure_property", 9.0, 11.0, "GPa", False, False) and "9.000–11.00 GPa" in one.statement and "SrTiO3" in one.statement
    assert got["p2"].hypothesis_type == "hidden_link" and got["p2"].low == 8.5
    assert got["p3"].fallback and got["p6"].fallback and got["p6"].numeric is False
    assert got["p4"].known_principle and got["p4"].novelty == round(0.95 * 0.4, 3) and got["p5"].hypothesis_type == "gap_filling" and got["p5"].pending
    assert len(got) == 6


def test_replies_of_a_model(spark):
    class Echo:
        def __init__(self, fail=False):
            self.fail = fail

        def complete(self, prompts):
            if self.fail:
                raise RuntimeError("no model")
            said = {"statement": "If capstan friction rises, fatigue resistance is expected to improve because slip ends at ≈ 3 N", "hypothesis_type": "analogy", "confidence": 0.8, "predicted_variable": "slip", "rationale": "r"}
            return ["```json\n" + json.dumps([said]) + "\n```" if p == "ask" else "no idea" for p in prompts]

    df = spark.createDataFrame([pair(1), pair(2), pair(3)], PAIR).withColumn("prompt", F.when(F.col("pair_id") == "p1", "ask").when(F.col("pair_id") == "p2", "other"))
    got = gen.accepted_replies(gen.ask(df, "prompt", Echo())).collect()
    assert [(r.pair_id, r.keywords[0], r.confidence, r.novelty, r.rationale, r.generation_method) for r in got] == [("p1", "slip", 0.8, 0.8, "r", "model")]
    assert gen.ask(df, "prompt", None).where("reply is not null").count() == 0 and gen.ask(df, "prompt", Echo(True)).where("reply is not null").count() == 0


HYP = "hypothesis_id string, statement string, hypothesis_type string, keywords array<string>, cross_domain boolean, materials boolean, numeric boolean"


def test_gates_of_trials(spark):
    good = "Predict that the structure of the perovskite alloy raises its hardness to 15 GPa in measured tapes"
    kws = ["perovskite", "alloy", "hardness", "structure", "tapes", "measured", "predict", "raises"]
    rows = [("ok", good, "structure_property", kws, True, True, True), ("off", good.replace("15", "500"), "structure_property", kws, True, True, True), ("short", "hardness ≈ 5", "gap", kws, True, True, True), ("self", good + " and alloy and alloy", "combination", kws, True, True, True), ("none", None, None, None, None, None, None)]
    h = st.content_violations(spark.createDataFrame(rows, HYP)).withColumn("number_violations", st.number_violations(F.col("statement")))
    t = en.trial(en.evaluate(h))
    got = {r.hypothesis_id: r for r in t.collect()}
    assert got["ok"].passed and got["ok"].failure_reason is None
    assert not got["off"].passed and got["off"].failure_reason == "numbers" and abs(got["off"].score * 2 * 1.15 - got["ok"].score) < 2e-4
    assert got["short"].score == got["short"].consistency == 0.0 and got["short"].failure_reason == "content" and not got["self"].passed
    v = {r.hypothesis_id: r.stability for r in en.verify(t).collect()}
    assert v["off"] == v["self"] == 0.0 and v["ok"] > 0.5


def test_caps_of_verification(spark):
    kws = [f"k{i}" for i in range(8)]
    h = en.evaluate(spark.createDataFrame([(str(i), "Predict that the structure of the perovskite alloy raises its hardness", "structure_property", kws, True, True, True) for i in range(5)], HYP))
    t = en.trial(h).withColumns({"known_principle": F.col("hypothesis_id") == "1", "pending": F.col("hypothesis_id") == "2", "range_problem": F.when(F.col("hypothesis_id") == "3", "unit"), "fallback": F.col("hypothesis_id") == "4"})
    free = en.verify(t.withColumn("is_safe", F.lit(True)).withColumn("score", F.lit(0.9)))
    got = {r.hypothesis_id: r.stability for r in free.collect()}
    assert got["1"] <= 0.59 and got["2"] <= 0.79 and got["3"] == 0.0 and got["4"] <= 0.59 and got["0"] >= got["2"]


def test_outside_scores_and_plain_trials(spark):
    h = spark.createDataFrame([("a", "Predict that heat leads to 5 % less creep in alloys", "structure_property", ["x", "y", "z"], True, True, False), ("b", None, None, None, None, None, None)], HYP)
    e = en.evaluate(h).withColumn("model_score", F.when(F.col("hypothesis_id") == "a", 1.0))
    with_, without = {r.hypothesis_id: r.score for r in en.trial(e).collect()}, {r.hypothesis_id: r.score for r in en.trial(e.drop("model_score")).collect()}
    assert with_["a"] > without["a"] and with_["b"] == without["b"]
    assert {r.hypothesis_id: (r.score, r.passed) for r in en.heuristic_trial(h).collect()} == {"a": (0.75, True), "b": (0.25, False)}


def test_number_gate(spark):
    rows = [("hardness of 500 GPa", ["hardness"]), ("hardness of 50 GPa", []), ("a 300 long walk " + "x " * 40 + "hardness", []), ("hardness 5, later " + "y " * 120 + "hardness 500", ["hardness"]), ("hardness of Li500O", []), ("microhardness 500", []), ("band gap 20 eV and zt 99", ["band gap"]), (None, [])]
    df = spark.createDataFrame(rows, "s string, want array<string>").withColumn("got", st.number_violations(F.col("s")))
    assert [(r.s, r.got, r.want) for r in df.collect() if r.got != r.want] == []
