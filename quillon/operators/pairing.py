"""Pairs of papers: thresholds, kinds of connection, bridge words, and a greedy choice with a limit per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.lexicons import GENERIC_WORDS, METHOD_WORDS, PROBLEM_WORDS
from quillon.functions.settle import settle
from quillon.functions.text import literal
from quillon.operators.quality import technical_overlap
from quillon.session import cut

CROSS_THRESHOLD, SAME_THRESHOLD = 0.05, 0.10


def folded(words: Column) -> Column:
    """Distinct lower-cased words without nulls; [] for null."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.lower(w)), lambda w: w.isNotNull()))


def primary(categories: Column) -> Column:
    return F.coalesce(F.get(categories, F.lit(0)), F.lit("unknown"))


def evaluate(pairs: DataFrame, *, need_bridge: bool = False) -> DataFrame:
    """Kind of connection and bridge words of each pair; pairs without a kind are left out.

    ``pairs``: similarity, category_a, category_b, kw_a, kw_b (folded), and with
    ``need_bridge`` mech_a and mech_b. Added: cross_domain, pair_type, bridge, reason.
    Bridge words keep the order of paper a, then b; method and problem words that of
    their lists.
    """
    base = pairs.withColumns({"cross_domain": F.col("category_a") != F.col("category_b"), "_tech": technical_overlap(F.col("mech_a"), F.col("mech_b")) if need_bridge else F.array().cast("array<string>")})
    relaxed = F.lit(max(CROSS_THRESHOLD, SAME_THRESHOLD * 0.75))
    threshold = F.when(F.col("cross_domain"), CROSS_THRESHOLD).when(F.size("_tech") > 0, relaxed).otherwise(SAME_THRESHOLD)
    base = base.where(F.col("similarity") >= threshold)
    m, p = literal(METHOD_WORDS), literal(PROBLEM_WORDS)
    base = settle(base, {"_bridge": F.array_except(F.array_intersect("kw_a", "kw_b"), literal(GENERIC_WORDS)), "_ma": F.array_intersect(m, "kw_a"), "_mb": F.array_intersect(m, "kw_b"), "_pa": F.array_intersect(p, "kw_a"), "_pb": F.array_intersect(p, "kw_b")})
    has = lambda c: F.size(c) > 0
    kind = (
        F.when(F.col("cross_domain"), F.when(has("_bridge"), F.lit("cross_domain_bridge")))
        .when((has("_ma") & has("_pb")) | (has("_mb") & has("_pa")), F.lit("method_transfer"))
        .when(has("_bridge") & (F.col("similarity") < 0.5) & has(F.array_except("kw_a", "kw_b")) & has(F.array_except("kw_b", "kw_a")), F.lit("concept_complement"))
        .when(F.col("similarity") >= SAME_THRESHOLD, F.lit("direct_similarity"))
    )
    moved = F.when(has("_ma") & has("_pb"), F.array_union("_ma", "_pb")).otherwise(F.array_union("_mb", "_pa"))
    base = settle(base, {"pair_type": kind}).where("pair_type is not null")
    bridge = F.when(F.col("pair_type") == "method_transfer", moved).otherwise(F.col("_bridge"))
    if need_bridge:
        base = base.where(F.size("_tech") > 0)
        bridge = F.array_union("_tech", F.slice(bridge, 1, 5))
    methods, problems = F.array_union("_ma", "_mb"), F.array_union("_pa", "_pb")
    rest = F.array_except(F.array_union(F.slice("kw_a", 1, 3), F.slice("kw_b", 1, 3)), literal(GENERIC_WORDS))
    fallback = F.when(has(methods), methods).when(has(problems), problems).otherwise(rest)
    base = settle(base, {"bridge": F.slice(F.when(has(bridge), bridge).otherwise(fallback), 1, 5)}).where(has("bridge"))
    words = F.array_join(F.slice("bridge", 1, 3), ", ")
    reason = (
        F.when(F.col("pair_type") == "cross_domain_bridge", F.concat(F.lit("links ["), "category_a", F.lit("] and ["), "category_b", F.lit("] through '"), words, F.lit("'")))
        .when(F.col("pair_type") == "method_transfer", F.concat(F.lit("method may move across papers: '"), words, F.lit("'")))
        .when(F.col("pair_type") == "concept_complement", F.concat(F.lit("complementary ideas around '"), words, F.lit("'")))
        .otherwise(F.concat(F.lit("similar content, shared: '"), words, F.lit("'")))
    )
    return base.withColumn("reason", reason).drop("_tech", "_bridge", "_ma", "_mb", "_pa", "_pb")


def greedy(pairs: DataFrame, a: str, b: str, score: str, *, per_node: int = 5, most: int = 50) -> DataFrame:
    """The pairs that a pass in descending ``score`` (ties by a, b) takes, with at most ``per_node`` per end and ``most`` in all.

    The choice is global and sequential, but what it reads is bounded: the next best
    4 * ``most`` rows at a time, a top-k that leaves out the ends that are full (at most
    2 * ``most`` / ``per_node`` of them). The first row of every read is taken, so there
    are at most ``most`` reads, however many rows a hub has. Rows with a null score or
    end are left out.
    """
    spark = pairs.sparkSession
    rest = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull() & F.col(score).isNotNull()).select(a, b, score)
    n, used, taken, last = max(4 * most, 64), {}, [], None
    while len(taken) < most:
        now = rest
        if last is not None:
            full = [k for k, c in used.items() if c >= per_node]
            tie = (F.col(score) == last[2]) & ((F.col(a) > last[0]) | ((F.col(a) == last[0]) & (F.col(b) > last[1])))
            now = now.where(((F.col(score) < last[2]) | tie) & ~F.col(a).isin(full) & ~F.col(b).isin(full))
        rows = now.orderBy(F.desc(score), a, b).limit(n).collect()
        for r in rows:
            if len(taken) < most and used.get(r[a], 0) < per_node and used.get(r[b], 0) < per_node:
                taken.append((r[a], r[b], float(r[score])))
                used[r[a]] = used.get(r[a], 0) + 1
                used[r[b]] = used.get(r[b], 0) + 1
        if len(rows) < n:
            break
        if last is None and len(taken) < most:
            rest = cut(rest)
        last = (rows[-1][a], rows[-1][b], rows[-1][score])
    kinds = dict(pairs.dtypes)
    return spark.createDataFrame(taken, f"`{a}` {kinds[a]}, `{b}` {kinds[b]}, `{score}` double")
