from quillon.operators.extraction import extract, sentence_rows

FORMS = [("hardness", "hardness"), ("hardness", "Vickers hardness"), ("band_gap", "band gap"), ("zt", "ZT")]


def facts(spark, text):
    df = spark.createDataFrame([("p", text), ("q", None), (None, text)], "paper_id string, abstract string").selectExpr("*", "'c' as ord", "'c' as low")
    return sorted((r.ord, r.composition, r.structure, r.property_name, r.property_value, r.property_unit, r.confidence) for r in extract(df, FORMS, ["perovskite", "layered perovskite"]).collect())


def test_facts(spark):
    text = "Films of Li0.5FeO2 were grown. A Vickers hardness of 3.5 GPa is reached at 900 K. The band gap, within an error of 2 %, is stable in the layered perovskite. The wzt 5 is no property."
    assert facts(spark, text) == [(1, "Li0.5FeO2", "unknown", "hardness", 3.5, "GPa", 0.7), (2, "Li0.5FeO2", "layered perovskite", "band_gap", None, None, 0.4)]


def test_two_formulas_and_none(spark):
    assert [f[1] for f in facts(spark, "In Al2O3, TiO2 and Fe2O3 the hardness is 7 GPa.")] == ["Al2O3", "TiO2"]
    assert facts(spark, "The hardness is 7 GPa.") == [] and facts(spark, "") == []


def test_context_is_carried(spark):
    df = spark.createDataFrame([("p", "Fe2O3 is red. It is stable here. TiO2 is white now.")], "paper_id string, abstract string")
    assert [(r.ord, r.compositions, r.has_own) for r in sentence_rows(df).orderBy("ord").collect()] == [(0, ["Fe2O3"], True), (1, ["Fe2O3"], False), (2, ["TiO2"], True)]
