from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import directions, history
from quillon.streaming.directions import direction_stream
from quillon.streaming.events import read_stream

T0 = datetime(2024, 1, 1)


def test_events(spark):
    df = spark.createDataFrame([(T0 + timedelta(i), t) for i, t in enumerate(["crawl.done", "pair.done", "crawl.start", None])], "ts timestamp, topic string")
    assert [r.topic for r in history.recent_events(df, "crawl.*").collect()] == ["crawl.start", "crawl.done"]
    assert history.recent_events(df, most=2).count() == 2


def test_upsert_and_index(spark):
    s = "entry_id string, ts timestamp, score double, keywords array<string>, hypothesis_type string"
    old = spark.createDataFrame([("a", T0, 1.0, ["X"], "gap"), ("b", None, 1.0, None, None)], s)
    new = spark.createDataFrame([("a", T0 + timedelta(1), 2.0, ["X", None], "gap"), ("b", T0, 3.0, None, None), (None, T0, 9.0, None, None)], s)
    got = {r.entry_id: r.score for r in history.upsert(old, new).collect()}
    assert got == {"a": 2.0, "b": 3.0}
    assert {(r.word, r.entry_id) for r in history.keyword_index(history.upsert(old, new)).collect()} == {("x", "a"), ("type:gap", "a"), ("type:other", "b")}


def test_weights_health_retries(spark):
    old, fresh = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "operator string, weight double"), spark.createDataFrame([("a", 1.0), ("c", 0.3)], "operator string, weight double")
    assert {r.operator: r.weight for r in history.blended_weights(old, fresh).collect()} == {"a": 0.8, "b": 0.9, "c": 0.3}
    t = spark.createDataFrame([("h", T0 + timedelta(i), 0.5) for i in range(6)], "hypothesis_id string, ts timestamp, consistency double")
    assert history.health(t).first().health == pytest.approx(0.7) and history.health(t.limit(0)).first().health == 0.5
    assert history.retries(t).count() == 4
    assert history.evict(t, 2, F.desc("ts")).count() == 2


def test_stream_agrees_with_replay(spark, tmp_path):
    kinds = ["support", "support", "failure", "hint", "round", "support", "failure"]
    rows = [("h" if i % 3 else "g", i, kinds[i % 7], [f"k{i % 4}", f"k{(i + 1) % 4}", f"m{i % 5}"], 0.5, 0.3, str(i), "gap") for i in range(40)]
    schema = "host string, ord int, kind string, keywords array<string>, score double, novelty double, source string, label string"
    want = {tuple(map(str, r)) for r in directions.replay(spark.createDataFrame(rows, schema), "host", ["ord"]).collect()}
    latest = {}

    def keep(batch, _):
        for r in batch.collect():
            latest.setdefault((r.host, _), []).append(tuple(map(str, r)))

    for part in (rows[:18], rows[18:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = direction_stream(read_stream(spark, f"{tmp_path}/in"), "host", ["ord"])
        q = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    last = {}
    for (host, epoch), found in sorted(latest.items()):
        last[host] = found
    assert {x for found in last.values() for x in found} == want
