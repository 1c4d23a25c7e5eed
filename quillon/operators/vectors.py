"""Nearest vectors of a stated set of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK, PART = 2000, 5000  # queries and rows that meet in one matrix product


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """(query_id, key, similarity): the ``k`` most similar rows of each query by cosine, itself left out; ties by key.

    Queries go in blocks: each block meets each part of the rows once, as a matrix
    product, and only the k best of a part leave it. Null vectors, and vectors of no
    length, match nothing. Queries are a stated subset and their blocks are read again
    for each part, so nothing of unbounded size is held.
    """
    kind = dict(rows.dtypes)[key]
    q = queries.where(F.col(vector).isNotNull()).select(F.col(key).alias("q"), F.col(vector).alias("qv")).withColumn("b", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-queries.count() // BLOCK)))))
    parts = max(4, -(-rows.count() // PART))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("r"), F.col(vector).alias("rv")).withColumn("p", F.pmod(F.xxhash64("r"), F.lit(parts)))
    groups = r.groupBy("p").agg(F.collect_list(F.struct("r", "rv")).alias("rs"))
    # Every block goes to every part by a shuffle on the part: an equi-join, nothing is broadcast.
    blocks = q.groupBy("b").agg(F.collect_list(F.struct("q", "qv")).alias("qs")).select("qs", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p")).withColumn("p", F.col("p").cast("long"))
    met = blocks.join(groups.withColumn("p", F.col("p").cast("long")).hint("merge"), "p").select("qs", "rs")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for qs, rs in zip(batch.qs, batch.rs):
                qi, ri = [x["q"] for x in qs], [x["r"] for x in rs]
                a, b = (np.array([x[c] for x in xs], dtype=np.float64) for xs, c in ((qs, "qv"), (rs, "rv")))
                na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
                s = np.round((a @ b.T) / np.maximum(np.outer(na, nb), 1e-300), 6)
                out = []
                for i, row in enumerate(s):
                    row = np.where(nb > 0, row, -np.inf) if na[i] > 0 else np.full(len(ri), -np.inf)
                    # One more than asked for, as the query itself may be among them, and all that tie with the last.
                    least = np.partition(row, len(row) - k - 1)[len(row) - k - 1] if len(row) > k + 1 else -np.inf
                    order = sorted((j for j in np.flatnonzero((row >= least) & (row > -np.inf)) if ri[j] != qi[i]), key=lambda j: (-row[j], ri[j]))[:k]
                    out += [(qi[i], ri[j], float(row[j])) for j in order]
                yield pd.DataFrame(out, columns=["query_id", key, "similarity"])

    found = met.mapInPandas(best, f"query_id {kind}, `{key}` {kind}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), key)
    return found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).drop("rn")
