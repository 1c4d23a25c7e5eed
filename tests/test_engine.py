"""The engine over whole rounds, its reads, events, look-ups."""

import pytest

from quillon.api import Engine, Settings
from quillon.operators import quality
from quillon.sources import lookups
from quillon.sources.papers import SCHEMA


@pytest.fixture(scope="module")
def engine(spark):
    topics = ["actuator torque", "battery electrolyte", "perovskite doping", "cable friction"]
    papers = [(f"paper_{i:02}", f"On {topics[i % 4]} with annealing step {i}", f"We measured the {topics[i % 4]} and friction of a prototype actuator; the efficiency of annealing is {i} %. " * 2, ["A. B"], [("cs.RO", "cond-mat.mtrl-sci")[i % 2]], [*topics[i % 4].split(), "annealing", f"k{i}"], 2020, "offline", None, {}) for i in range(24)]
    triples = [(i, c, s, p, v, u, q) for i, (c, s, p, v, u, q) in enumerate([("BaTiO3", "perovskite", "hardness", 10.0, "GPa", "paper_00"), ("SrTiO3", "perovskite", "hardness", 11.0, "GPa", "paper_01"), ("Bi2Te3", "layered", "zt", 1.0, "", "paper_02"), ("LiFePO4", "olivine", "voltage", 3.4, "V", "paper_03")])]
    e = Engine(spark, {"papers": spark.createDataFrame(papers, SCHEMA), "triples": spark.createDataFrame(triples, "triple_id long, composition string, structure string, property_name string, property_value double, property_unit string, source_paper_id string")}, Settings(papers=12, pairs=8, hypotheses=6, trials=6, rules=quality.QualityRules(enabled=False)))
    seen = []
    e.subscribe("cycle.*", lambda topic, detail: seen.append(topic))
    e.subscribe("cycle.finished", lambda topic, detail: 1 / 0)
    rounds = e.run_cycles(2)
    return e, rounds, seen


def test_rounds(engine):
    e, rounds, seen = engine
    assert len(rounds) == 2 and seen == ["cycle.started", "cycle.finished"] * 2
    assert all(r["papers"] == 12 and 0 < r["hypotheses"] <= 6 and 0 < r["pairs"] <= 8 for r in rounds)
    assert e.status()["round"] == 2 and e.history("cycle.started").count() == 2 and e.history("hypothesis.*").count() == 2
    assert e.tables["entries"].count() == len({r.entry_id for r in e.tables["entries"].collect()}) <= rounds[0]["hypotheses"] + rounds[1]["hypotheses"]
    assert {r.operator for r in e.tables["weights"].collect()} >= {"causal", "uncertainty"}
    assert e.feedback["focus"] == []


def test_reads(engine, tmp_path):
    e, _, _ = engine
    entry = e.tables["entries"].first()
    assert entry.entry_id in {r.entry_id for r in e.search_knowledge(entry.keywords[0].upper(), 50).collect()} and e.search_knowledge(" ").count() == 0
    assert sum(r.entries for r in e.knowledge().collect()) == e.tables["entries"].count()
    assert e.top_validated().count() + e.failures(50).count() >= 1 and e.top_pairs(3).count() == 3
    assert e.discovery_stats().first().verified == e.tables["verified"].count() and e.overrides().count() == 0
    assert [r.composition for r in e.facts("tio3", "HARD").collect()] == ["BaTiO3", "SrTiO3"]
    assert {r.paper_id for r in e.papers_for_facts(50).collect()}.isdisjoint({"paper_00", "paper_01", "paper_02", "paper_03"})
    assert [r.property_value for r in e.submit_facts([{"composition": "GaN", "property_name": "bandgap", "property_value": "3.4"}, {"composition": "GaN", "property_name": "bandgap", "property_value": "9"}, {"property_name": "x"}, {"composition": "BaTiO3", "structure": "perovskite", "property_name": "hardness"}], "paper_05").collect()] == [3.4]
    assert e.facts("gan").count() == 1
    assert e.gap_report().count() >= 0 and e.gap_records().count() >= 0 and e.directions().count() >= 0
    e.snapshot(str(tmp_path / "s"))


def test_lookups(engine, tmp_path, spark):
    e, _, _ = engine
    e.import_lookup([{"composition": "BaTiO3", "database": "one", "found": True, "value": 3, "unit": "eV"}, {"composition": None, "database": "one"}])
    got = e.import_lookup([{"composition": "BaTiO3", "database": "one", "found": False}, {"composition": "GaN", "database": "two", "found": True}])
    assert sorted((r.composition, r.database, r.found, r.value) for r in got.collect()) == [("BaTiO3", "one", False, None), ("GaN", "two", True, None)]
    c = spark.createDataFrame([("BaTiO3",), ("XX",)], "composition string")
    assert {r.composition: r.found for r in e.validate_external(c).collect()} == {"BaTiO3": False, "XX": None}
    lookups.save(got, str(tmp_path / "l"))
    assert lookups.load(spark, str(tmp_path / "l")).count() == 2 and [(r.database, r.candidates, r.found) for r in lookups.summary(c, got).collect()] == [("one", 1, 0)]


def test_errors_end_a_run(spark):
    e = Engine(spark, {})
    assert e.run_cycles(5, most_errors=2) == [] and e.errors == 2 and e.status()["last"] == "cycle.failed"
