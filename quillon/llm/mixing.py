"""Mixing sources to target weights (problem 7).

Iterative proportional fitting: tokens are summed by source, language and topic, a
bounded table; repeats of its cells are raked to the marginals of language and topic
and, last and exactly, of source, under each source's cap. Documents are then sampled
with these calibrated rates, systematically within buckets, so that a source's size
comes out near its target even where it has few documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

MAX_CELLS = 1_000_000  # source x language x topic; more means that a column is no category
FEW_CELLS = 50_000  # cells that are broadcast to the documents
BUCKET = 20_000  # documents in a bucket of the systematic sample, about


def fill(weights: np.ndarray, tokens: np.ndarray, cap: float, goal: float) -> np.ndarray:
    """``min(cap, m * weights)`` with the m that makes the sum over ``tokens`` reach ``goal``; all at the cap if none does."""
    if goal >= cap * tokens.sum() * (1 - 1e-12):
        return np.full(len(tokens), float(cap))
    w = np.maximum(weights, 1e-12)
    order = np.argsort(-w)
    capped = np.concatenate([[0.0], np.cumsum(cap * tokens[order])])
    rest = np.concatenate([np.cumsum((w * tokens)[order][::-1])[::-1], [0.0]])
    for k in range(len(order)):
        m = (goal - capped[k]) / rest[k] if rest[k] > 0 else 0.0
        if m * w[order[k]] <= cap * (1 + 1e-12):
            return np.minimum(cap, m * w)
    return np.full(len(tokens), float(cap))


def rake(cells: list[tuple[str, str, str, float]], shares: dict[str, float], caps: dict[str, int], rounds: int = 100) -> tuple[list[float], float]:
    """Repeats of each cell (source, language, topic, tokens), and the size in tokens of the whole mixture.

    The mixture is as large as the caps allow. Language and topic keep the shares that
    they have in the sources' tokens, as far as caps and sources let them; a source
    that has no tokens leaves its share to the others in proportion.
    """
    tokens = np.array([c[3] for c in cells], dtype=float)
    src = np.array([c[0] for c in cells])
    there = {s: tokens[src == s].sum() for s in shares if shares[s] > 0 and (src == s).any() and tokens[src == s].sum() > 0}
    total_share = sum(shares[s] for s in there)
    if not there or total_share <= 0:
        return [0.0] * len(cells), 0.0
    want = {s: shares[s] / total_share for s in there}
    size = min(caps[s] * there[s] / want[s] for s in there)
    live = np.isin(src, list(there))
    r = np.where(live, 1.0, 0.0)
    margins = []
    for axis in (1, 2):
        names = np.array([c[axis] for c in cells])
        # What the corpus would give if each source had its share.
        start = np.zeros(len(cells))
        for s in there:
            start[src == s] = tokens[src == s] * want[s] * size / there[s]
        margins.append((names, {x: start[names == x].sum() for x in set(names[live])}))
    for _ in range(rounds):
        before = r.copy()
        for names, goals in margins:
            for x, goal in goals.items():
                at = live & (names == x)
                now = (r[at] * tokens[at]).sum()
                if now > 0:
                    r[at] *= goal / now
        for s in there:
            at = src == s
            r[at] = fill(r[at], tokens[at], caps[s], want[s] * size)
        if np.abs(r - before).max() < 1e-9:
            break
    return r.tolist(), float(size)


def mixture(sized: DataFrame, targets: DataFrame, *, key: str = "doc_id", tokens: str = "tokens", source: str = "source", language: str = "lang", topic: str = "section", seed: int = 0) -> DataFrame:
    """(key, source, tokens, copies) of the documents in the mixture, each taken ``copies`` times, at least once.

    ``sized``: one row per key with its size in tokens; rows with a null key, no size or
    a size of 0, and of sources without a target, are left out; null languages and
    topics are categories of their own. ``targets``: source, target_share, max_repeats,
    one row per source (a null or negative share counts as 0, null repeats as 1).
    Empty tables give an empty result. Raises ``ValueError`` beyond MAX_CELLS cells.
    """
    spark = sized.sparkSession
    goal = {r[0]: (max(float(r[1] or 0.0), 0.0), max(int(r[2] if r[2] is not None else 1), 0)) for r in targets.select("source", "target_share", "max_repeats").where("source is not null").collect()}
    none = F.lit("(none)")
    docs = sized.select(F.col(key).alias("_k"), F.col(source).alias("s"), F.coalesce(F.col(language), none).alias("l"), F.coalesce(F.col(topic), none).alias("t"), F.col(tokens).cast("long").alias("n"))
    docs = docs.where(F.col("_k").isNotNull() & (F.col("n") > 0) & F.col("s").isin(sorted(goal)))
    cells = docs.groupBy("s", "l", "t").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).orderBy("s", "l", "t").limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    rates, _ = rake([(c["s"], c["l"], c["t"], float(c["n"])) for c in cells], {s: g[0] for s, g in goal.items()}, {s: g[1] for s, g in goal.items()})
    count: dict[str, int] = {}
    for c in cells:
        count[c["s"]] = count.get(c["s"], 0) + c["docs"]
    rated = spark.createDataFrame([(c["s"], c["l"], c["t"], r, -(-count[c["s"]] // BUCKET)) for c, r in zip(cells, rates)], "s string, l string, t string, rate double, buckets long")
    # A cell has about a hundred bytes: more of them than a broadcast should hold are met by a shuffle.
    at = docs.join(F.broadcast(rated) if len(cells) <= FEW_CELLS else rated.hint("merge"), ["s", "l", "t"]).withColumn("h", F.xxhash64("_k", F.lit(seed)))
    at = at.withColumn("bucket", F.pmod("h", F.col("buckets")))
    # A large source is spread over buckets; within one, size order makes the sample follow the sizes.
    w = Window.partitionBy("s", "bucket").orderBy(F.desc("n"), "h", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = at.withColumn("c", F.sum(F.col("rate").cast("decimal(30,12)")).over(w))
    shift = F.pmod(F.xxhash64("s", "bucket", F.lit(seed)), F.lit(1000)) / F.lit(1000).cast("decimal(30,12)")
    copies = (F.floor(F.col("c") + shift) - F.floor(F.col("c") - F.col("rate").cast("decimal(30,12)") + shift)).cast("int")
    return summed.select(F.col("_k").alias(key), F.col("s").alias("source"), F.col("n").alias("tokens"), copies.alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, tokens, most_copies, actual_share) of every source with a target."""
    by = mixed.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    # One row per source with a target: few rows, so the sum over all of them is cheap.
    out = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").withColumn("all_tokens", F.sum("tokens").over(Window.partitionBy()))
    return out.select("source", "target_share", "max_repeats", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens", "most_copies")], F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("actual_share"))
