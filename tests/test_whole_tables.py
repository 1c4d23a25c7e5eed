"""Queries that read whole tables through name mapping and conversion, against brute force on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import coverage, physics, titles
from quillon.operators.quantities import resolved


@pytest.mark.parametrize("seed, n_props", [(1, 7), (2, 70)])
def test_coverage_gaps(spark, monkeypatch, seed, n_props):
    monkeypatch.setattr(coverage, "FIRST", 2)
    monkeypatch.setattr(coverage, "GROWTH", 2)
    rng = random.Random(seed)
    props = {f"c{i:02}": {f"p{rng.randrange(n_props)}" for _ in range(rng.randrange(1, 6))} for i in range(40)}
    places = {c: {"s0" if rng.random() < 0.5 else f"s{rng.randrange(4)}"} for c in props}
    facts = [(c, p) for c, ps in props.items() for p in ps] * 2 + [(None, "p1"), ("c00", None)]
    where = [(c, s) for c, ss in places.items() for s in ss] + [("c00", None), ("zz", "s0")]
    want = {}
    for c in props:
        if len(props[c]) >= 2:
            peers = sorted(d for d in props if d != c and places[c] & places[d] and 1 <= len(props[d] - props[c]) <= 3)
            if peers:
                want[c] = (peers[0], "|".join(sorted(props[peers[0]] - props[c])))
    got = coverage.coverage_gaps(spark.createDataFrame(facts, "composition string, property_name string"), spark.createDataFrame(where, "composition string, structure string"))
    assert {r.composition: (r.peer, r.missing) for r in got.collect()} == want and len(want) > 5


def test_coverage_of_nothing(spark):
    got = coverage.coverage_gaps(spark.createDataFrame([], "composition string, property_name string, peer string"), spark.createDataFrame([], "composition string, structure string"))
    assert got.count() == 0


def test_titles_within_titles(spark):
    rng = random.Random(4)
    words = ["effect", "of", "strain", "on", "growth", "oxide", "thermoelectricproperties", "films", "in", "a"]
    ts = {f"t{i:03}": " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for i in range(150)}
    ts |= {"cut": "ffect of strain on gro", "whole": "the effect of strain on growth", "two": "ermoelectricproperties fil", "host": "new thermoelectricproperties films", "one": "thermoelectricpropertie", "null": None}
    df = spark.createDataFrame(list(ts.items()), "id string, k string")
    got = titles.contained(df.where(F.length("k") > 20), "id", "k", 20)
    long = {i: k for i, k in ts.items() if k and len(k) > 20}
    want = {(a, b) for a in long for b in long if long[a] != long[b] and long[a] in long[b]}
    rows = [(r.short_id, r.long_id) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and {("cut", "whole"), ("two", "host"), ("one", "host")} <= want


def test_ranges_with_conversion(spark):
    rows = [(1, "hardness", 15.0, "GPa"), (2, "hardness", 15000.0, "MPa"), (3, "hardness", 150000.0, "MPa"), (4, "hardness", 15.0, "eV"), (5, "hardness", 15.0, None), (6, "hardness", None, "GPa"), (7, "charm", 1e9, "GPa"), (8, "tc", -400.0, "degC"), (9, "tc", 20.0, "°C"), (10, "zt", 11.0, ""), (11, None, 1.0, "K")]
    got = {r.id: r.range_problem for r in physics.check_ranges(spark.createDataFrame(rows, "id int, p string, v double, u string"), "p", "v", "u").collect()}
    assert got == {1: None, 2: None, 3: "range", 4: "unit", 5: None, 6: None, 7: None, 8: "range", 9: None, 10: "range", 11: None}


def test_joint_check_and_severity(spark):
    rows = [("BaTiO3", "perovskite", "hardness", 5.0, "GPa"), ("Si", "perovskite", "hardness", 500.0, "GPa"), ("YBa2Cu3O7", "tetragonal", "tc", 92.0, "K"), ("BaTiO3", "perovskite", "tc", 390.0, "K"), ("YBa2Cu3O7", "cubic", "tc", 92.0, "K"), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "composition string, structure string, property_name string, property_value double, property_unit string")
    assert [sorted(r.csp_violations) for r in physics.joint_check(df).orderBy(F.col("property_value").isNull(), "property_value").collect()][-2] == ["out_of_range", "too_few_elements"]
    v = df.select(F.col("composition").alias("composition_a"), F.lit(None).cast("string").alias("composition_b"), F.col("structure").alias("structure_a"), F.lit(None).cast("string").alias("structure_b"), "property_name", F.col("property_value").alias("predicted_value"), F.col("property_unit").alias("predicted_unit"))
    got = {(r.composition_a, r.structure_a, r.property_name): (r.severity, list(r.physical_violations)) for r in physics.validate(v).collect()}
    assert got[("BaTiO3", "perovskite", "hardness")] == ("pass", []) and got[("BaTiO3", "perovskite", "tc")][0] == "warning"
    assert got[("YBa2Cu3O7", "tetragonal", "tc")] == ("reject", ["property_absent_in_phase"]) and got[("YBa2Cu3O7", "cubic", "tc")] == ("reject", ["loose_structure"]) and got[(None, None, None)][0] == "pass"


def test_profile(spark):
    rows = [("a", "d", 7.0), ("a", "d", 9.0), ("b", "d", 7.0), ("b", "s", 300.0), ("c", None, None)]
    got = {r.k: (r.meets, r.missing) for r in physics.profile(spark.createDataFrame(rows, "k string, property_name string, value double"), "k", [("d", "max", 8.0), ("s", "min", 200.0)]).collect()}
    assert got == {"a": (False, 1), "b": (True, 0), "c": (True, 2)}


def test_resolved_names(spark):
    df = spark.createDataFrame([("band_gap", 1), ("Band-Gap", 2), ("bandgap (eV)", 3), ("unrelated thing", 4), (None, 5), (" ", 6)], "p string, n int")
    got = {r.n: r.p for r in resolved(df, "p", [("band_gap", "band_gap"), ("band_gap", "band gap"), ("hardness", "hardness")]).collect()}
    assert got == {1: "band_gap", 2: "band_gap", 3: "band_gap"}
