from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.api import Engine, Settings
from quillon.operators import quality, reports
from quillon.session import checkpoint_dir, cut
from quillon.streaming import events


def test_checkpoint_folder_is_used(spark):
    df = cut(spark.range(3))
    assert df.count() == 3 and checkpoint_dir(spark)


def test_stream_drops_repeats(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 7, t0 + timedelta(minutes=i), "abc"[i % 7 % 3]) for i in range(40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").repartition(3).write.parquet(f"{tmp_path}/e.parquet")
    got = {r.event_type: r.events for r in events.deduplicated_counts(spark, f"{tmp_path}/e.parquet").collect()}
    assert got == {"a": 3, "b": 2, "c": 2}


def test_cycle_writes_each_batch_once(spark, tmp_path):
    spark.range(10).write.parquet(f"{tmp_path}/in")
    stream = events.read_stream(spark, f"{tmp_path}/in")
    n = events.cycle(stream, [lambda d: d.where("id > 4"), lambda d: d.withColumn("x", F.lit(1))], f"{tmp_path}/out")()
    assert n == 1 and spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_windows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    spark.createDataFrame([(t0 + timedelta(minutes=10 * i), "k") for i in range(30)], "ts timestamp_ntz, kind string").write.parquet(f"{tmp_path}/in")
    out = []
    events.run_to_end(events.windowed(events.read_stream(spark, f"{tmp_path}/in"), "ts", "1 hour", "10 minutes", "kind"), lambda d, i: out.extend(d.collect()))
    assert {r.n for r in out} <= {6} and len(out) >= 3


@pytest.fixture(scope="module")
def engine(spark):
    text = "We measured torque and friction of a prototype actuator with 5 Nm load in experiment number {} over long time, doping the alloy."
    papers = [(f"paper_{i}", f"Cable actuator study {i % 4}", text.format(i), ["A. B"], [f"cat{i % 2}"], ["actuator", "doping" if i % 3 else "wear", f"k{i}"], 2020, "offline", None, {}) for i in range(12)]
    from quillon.sources.papers import SCHEMA

    hypos = [(f"h{i}", "gap" if i % 2 else "combination", f"Combining actuator and doping drops the hardness above {300 + i} K", ["actuator", "doping", "wear", f"k{i}"], f"paper_{i}", f"paper_{i + 1}", i % 2 == 0, True, True, 0.5) for i in range(6)]
    triples = [("SiC", "wurtzite", "hardness", 3.0, "paper_1"), ("AlN", "wurtzite", "band_gap", None, "paper_2")]
    return Engine(
        spark,
        {
            "papers": spark.createDataFrame(papers, SCHEMA),
            "hypotheses": spark.createDataFrame(hypos, "hypothesis_id string, hypothesis_type string, statement string, keywords array<string>, paper_a_id string, paper_b_id string, cross_domain boolean, materials boolean, numeric boolean, novelty double"),
            "triples": spark.createDataFrame(triples, "composition string, structure string, property_name string, property_value double, source_paper_id string"),
        },
        Settings(papers=10, pairs=6),
    )


def test_stages(engine, tmp_path):
    assert 1 <= engine.crawl().count() <= 10
    engine.give(focus=["paper_3"], force_fail=["h0"], force_pass=["h1"], hints=["zinc"])
    pairs = engine.pair().collect()
    assert 0 < len(pairs) <= 6
    t = {r.hypothesis_id: r for r in engine.trial().collect()}
    assert not t["h0"].passed and t["h1"].passed and t["h1"].forced
    v = {r.hypothesis_id: r for r in engine.verify().collect()}
    assert "h0" not in v and v["h1"].level == "override" and not v["h1"].discovery
    assert "no_papers" not in engine.attention("crawl") and engine.attention("hypothesize") == []
    assert ("cross_domain_pairs" in engine.attention("pair")) == any(r.cross_domain for r in pairs)
    passed = sum(r.passed for r in t.values())
    assert ("all_pass" in engine.attention("trial")) == (passed == len(t))
    with pytest.raises(ValueError):
        engine.attention("nonsense")
    assert engine.graph().count() > 0 and engine.directions().count() >= 1
    assert all(r.papers for r in engine.gaps().collect())
    text = engine.report("Run", ["hardness", "band_gap"])
    assert all(f"## {i}. {s}" in text for i, s in enumerate(reports.SECTIONS[:10], 1))
    engine.snapshot(str(tmp_path / "snap"))
    assert engine.add_papers([{"title": "New one"}]).count() == 1
    with pytest.raises(ValueError):
        engine.give(nonsense=[])


def test_missing_stage(spark):
    with pytest.raises(KeyError):
        Engine(spark, {}).pair()


def test_presets():
    assert Settings.quick().pairs == 20 and Settings.production().trials == 40 and Settings().rules == quality.QualityRules()


def test_nothing_else_imports_llm():
    import pathlib
    import re

    root = pathlib.Path(__file__).resolve().parents[1] / "quillon"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"quillon\.llm|from \.+llm|import llm", path.read_text()), path
