"""Queries over the event stream, embeddings and the star schema (engine coverage beyond the domain is marked so)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.plans.registry import Registry
from quillon.sources.tables import table
from quillon.streaming.events import deduplicated_counts

registry = Registry()


@registry.query("json_props_parse", "SELECT event_type, count(*) AS events, count(try_cast(json_extract_string(props, '$.k') AS INT)) AS with_k, sum(try_cast(json_extract_string(props, '$.k') AS INT))::BIGINT AS sum_k FROM events GROUP BY event_type")
def json_props_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Events by type with their parsed properties."""
    e = table(spark, folder, "events", "event_type", "props").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("with_k"), F.sum("k").cast("bigint").alias("sum_k"))


@registry.query("last_n_ring", "SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5")
def last_n_ring(spark: SparkSession, folder: str) -> DataFrame:
    """The last five events of each user."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, folder, "events", "user_id", "event_id", "ts").withColumn("rn", F.row_number().over(w).cast("bigint")).where("rn <= 5").select("user_id", "event_id", "rn")


@registry.query("median_mean_fusion", "SELECT user_id, round(least(1.0, greatest(0.1, 0.6 * med + 0.2 * mean + 0.2 * (1 - 2 * abs(med - mean)))), 6) AS fused FROM (SELECT user_id, median(s) AS med, avg(s) AS mean FROM (SELECT user_id, least(1.0, value / 100) AS s FROM events WHERE value IS NOT NULL) GROUP BY user_id HAVING count(*) >= 2)")
def median_mean_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Fusion of each user's scores by median, mean and their agreement."""
    s = table(spark, folder, "events", "user_id", "value").where("value is not null").select("user_id", F.least(F.lit(1.0), F.col("value") / 100).alias("s"))
    g = s.groupBy("user_id").agg(F.median("s").alias("med"), F.avg("s").alias("mean"), F.count("*").alias("n")).where("n >= 2")
    fused = 0.6 * F.col("med") + 0.2 * F.col("mean") + 0.2 * (1 - 2 * F.abs(F.col("med") - F.col("mean")))
    return g.select("user_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), fused)), 6).alias("fused"))


@registry.query("tumbling_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Engine coverage: hourly windows of events."""
    e = table(spark, folder, "events", "ts", "event_type", "value")
    return e.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))


@registry.query("direction_decay", "SELECT user_id, round((0.15 + 0.3 * least(1.0, value / 100)) * power(0.995, n), 6) AS confidence FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first FROM events WHERE value IS NOT NULL) WHERE first = 1")
def direction_decay(spark: SparkSession, folder: str) -> DataFrame:
    """The confidence left of a user's first event after one round of decay for each later one."""
    e = table(spark, folder, "events", "user_id", "event_id", "ts", "value").where("value is not null")
    g = e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("value"), (F.count("*") - 1).alias("n"))
    return g.select("user_id", F.round((0.15 + 0.3 * F.least(F.lit(1.0), F.col("value") / 100)) * F.pow(F.lit(0.995), F.col("n")), 6).alias("confidence"))


@registry.query("stream_dedup_counts", "SELECT event_type, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def stream_dedup_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct events by type, through the streaming ingest run to its end."""
    return deduplicated_counts(spark, f"{folder}/events.parquet")


@registry.query("vector_pair_topk", """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v), q AS (SELECT * FROM n WHERE vec_id % 20 = 0)
    SELECT q.vec_id AS query_id, n.vec_id, round(list_dot_product(q.e, n.e) / (q.norm * n.norm), 6) AS similarity FROM q JOIN n ON q.vec_id <> n.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(q.e, n.e) / (q.norm * n.norm), 6) DESC, n.vec_id) <= 5""")
def vector_pair_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors of each query vector (ids divisible by 20) by cosine, queries against all rows in blocks."""
    from quillon.operators.vectors import nearest

    v = table(spark, folder, "embeddings", "vec_id", "embedding")
    return nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5)


@registry.query("coverage_rollup", "SELECT n_name, c_mktsegment, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)")
def coverage_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Engine coverage, not in the domain: a rollup over an equi-join."""
    c = table(spark, folder, "customer", "c_nationkey", "c_mktsegment", "c_acctbal").join(F.broadcast(table(spark, folder, "nation", "n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("n_name", "c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@registry.query("coverage_outer_join", "SELECT c_custkey, count(o_orderkey) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS spent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def coverage_outer_join(spark: SparkSession, folder: str) -> DataFrame:
    """Engine coverage: customers with and without orders; orders are summed before the join."""
    o = table(spark, folder, "orders", "o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").agg(F.count("o_orderkey").alias("orders"), F.sum("o_totalprice").alias("spent"))
    c = table(spark, folder, "customer", "c_custkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"), F.round(F.coalesce("spent", F.lit(0.0)), 2).alias("spent"))


@registry.query("coverage_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS starts FROM events), s AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, count(*) AS events FROM s GROUP BY ALL""")
def coverage_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Engine coverage: sessions of a user's events with gaps of six hours at most."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events", "user_id", "event_id", "ts")
    g = e.withColumn("starts", F.when(F.col("ts") - F.lag("ts").over(w) <= F.expr("interval 6 hours"), 0).otherwise(1))
    return g.withColumn("session", F.sum("starts").over(w)).groupBy("user_id", "session").agg(F.count("*").alias("events"))
