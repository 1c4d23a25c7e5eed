"""TF-IDF as sparse rows, and the pairs of documents that share tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.settle import settle
from quillon.functions.text import unigrams, with_bigrams
from quillon.session import cut

BLOCK = 2000  # vectors on either side of one matrix product
PARTS = 8  # groups of tokens whose lengths tell vectors apart
TIE = 5e-7  # half a unit of the sixth decimal, to which similarities are compared
CLOSE = (1.0, 0.999)  # similarities down to which pairs are looked for among neighbours before all pairs are compared


def term_counts(docs: DataFrame, key: str, text: str, bigrams: bool = True) -> DataFrame:
    """(key, token, tf) of each document; null and empty texts give no rows."""
    words = docs.select(F.col(key).alias(key), unigrams(F.col(text)).alias("_w"))
    tokens = with_bigrams(F.col("_w")) if bigrams else F.col("_w")
    return words.select(key, F.explode(tokens).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, n_docs: int, *, max_features: int = 2000, max_df: float = 0.98) -> DataFrame:
    """(token, df, idf): the most frequent tokens within the limits of document frequency, ties by token.

    At most ``max_features`` rows, so the table may be broadcast.
    """
    return vocabulary_of(counts.groupBy("token").agg(F.count("*").alias("df")), n_docs, max_features=max_features, max_df=max_df)


def _idf(n_docs: int):
    return F.log((1 + F.lit(float(n_docs))) / (1 + F.col("df"))) + 1


def vocabulary_of(df: DataFrame, n_docs: int, *, max_features: int = 2000, max_df: float = 0.98) -> DataFrame:
    """As ``vocabulary``, from the document frequencies (token, df)."""
    least = max(1, n_docs // 100)
    most = float(n_docs) if n_docs < 20 else max_df * n_docs
    return df.where((F.col("df") >= least) & (F.col("df") <= most)).orderBy(F.desc("df"), "token").limit(max_features).withColumn("idf", _idf(n_docs))


def grown_frequencies(known: DataFrame, counts: DataFrame) -> DataFrame:
    """(token, df): document frequencies of a corpus to which the documents of ``counts`` (key, token, tf) are added; no token is forgotten."""
    new = counts.groupBy("token").agg(F.count("*").alias("df"))
    return known.select("token", "df").unionByName(new).groupBy("token").agg(F.sum("df").alias("df"))


def grown_vocabulary(known: DataFrame, df: DataFrame, n_docs: int, *, max_features: int = 2000) -> DataFrame:
    """(token, df, idf) after the corpus has grown to ``n_docs``: the tokens of ``known`` with their new frequencies, and new ones within the limits only if all of them still fit under ``max_features``."""
    rest = vocabulary_of(df, n_docs, max_features=2**31 - 1)
    old = df.join(known.select("token"), "token", "left_semi").withColumn("idf", _idf(n_docs))
    new = rest.join(known.select("token"), "token", "left_anti")
    return old.unionByName(new) if old.count() + new.count() <= max_features else old


def hashed_vectors(docs: DataFrame, key: str, text: str, size: int = 128) -> DataFrame:
    """(key, token, w): vectors of unit length over ``size`` buckets of hashed tokens, for texts before any vocabulary is known; texts without tokens have none."""
    at = term_counts(docs, key, text).select(key, F.pmod(F.xxhash64("token"), F.lit(size)).cast("int").alias("token"), "tf").groupBy(key, "token").agg(F.sum("tf").cast("double").alias("w"))
    norm = at.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return at.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("w"))


def vectors(counts: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    """(key, token, w) with unit length for each document."""
    raw = counts.join(F.broadcast(vocab.select("token", "idf")), "token").select(key, "token", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).where("norm >= 1e-10").select(key, "token", (F.col("w") / F.col("norm")).alias("w"))


def cosine_pairs(vecs: DataFrame, key: str, least: float = 0.0) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b, of documents that share a token.

    A join on tokens carries only keys and weights; partial sums are combined before
    the second shuffle. All pairs that share a token are made: for the best of a large
    table take ``top_pairs``.
    """
    a, b = vecs.select(F.col(key).alias(f"{key}_a"), "token", F.col("w").alias("wa")), vecs.select(F.col(key).alias(f"{key}_b"), "token", F.col("w").alias("wb"))
    met = a.join(b, "token").where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    return met.groupBy(f"{key}_a", f"{key}_b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")).where(F.col("similarity") >= least)


def _classes(counts: DataFrame, vocab: DataFrame, key: str, most: int) -> tuple[DataFrame, DataFrame]:
    """Classes (num, v, q) of documents with equal counts, and the first members (key, num, rn) of each.

    ``v`` holds (i, w) in order of the token's number i, ``q`` the lengths of PARTS
    pieces of the vector. No pair of a later member than ``most`` + 1 can be among the
    ``most`` best, as those of the earlier ones are as similar and come first.
    """
    numbered = vocab.withColumn("i", F.row_number().over(Window.orderBy(F.desc("df"), "token")))  # a bounded table
    held = counts.join(F.broadcast(numbered.select("token", "idf", "i")), "token")
    docs = held.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", (F.col("tf") * F.col("idf")).alias("w")))).alias("raw"))
    docs = cut(docs.select(F.col(key).alias("_k"), "raw", F.xxhash64("raw").alias("h"), F.xxhash64(F.lit(1), "raw").alias("g")))
    w = Window.partitionBy("h", "g").orderBy("_k")
    first = cut(docs.select("_k", "h", "g").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most + 1))
    heads = cut(first.where("rn = 1").select("_k", F.monotonically_increasing_id().alias("num"), "h", "g"))
    squares = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x["w"] * x["w"])
    v = settle(docs.join(heads.select("_k", "num"), "_k").select("num", "_k", "raw"), {"norm": F.sqrt(squares(F.col("raw")))})
    v = cut(v.select("num", F.col("_k").alias("head"), F.transform("raw", lambda x: F.struct(x["i"].alias("i"), (x["w"] / F.col("norm")).alias("w"))).alias("v")))
    piece = lambda d: F.sqrt(squares(F.filter("v", lambda x: x["i"] % PARTS == d)))
    classes = cut(v.select("num", "head", "v", F.array(*[piece(d) for d in range(PARTS)]).alias("q")))
    return classes, cut(first.join(heads.select("h", "g", "num"), ["h", "g"]).select("_k", "num", "rn"))


def _dense(vs, width: int) -> np.ndarray:
    out = np.zeros((len(vs), width))
    for r, v in enumerate(vs):
        for x in v:
            out[r, x["i"]] = x["w"]
    return out


def _close(classes: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity), a < b, of all classes with similarity >= ``least``, for a ``least`` near 1.

    Unit vectors with similarity s are sqrt(2 - 2 s) apart, and the lengths of their
    pieces are no farther apart than they are. So both are in one cell of the lengths
    or in cells side by side; all lengths are compared before any vector.
    """
    apart = (2 - 2 * least) ** 0.5 * (1 + 1e-6) + 1e-9
    at = lambda d, by: F.floor((F.col("q")[d] + by) / (2 * apart))
    x = classes.select(F.col("num").alias("a"), F.col("q").alias("qa"), F.struct(*[at(d, 0.0).alias(f"c{d}") for d in range(3)]).alias("cell"))
    near = F.array_distinct(F.array(*[F.struct(*[at(d, s * apart).alias(f"c{d}") for d, s in enumerate(signs)]) for signs in product((-1, 1), repeat=3)]))
    y = classes.select(F.col("num").alias("b"), F.col("q").alias("qb"), F.explode(near).alias("cell"))
    gap = F.aggregate(F.zip_with("qa", "qb", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, z: s + z)
    met = x.join(y, "cell").where((F.col("a") < F.col("b")) & (gap <= apart * apart)).select("a", "b")
    va, vb = (classes.select(F.col("num").alias(s), F.col("v").alias(f"v{s}")) for s in ("a", "b"))

    def dot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            s = []
            for p, q in zip(batch.va, batch.vb):
                have = {z["i"]: z["w"] for z in q}
                s.append(float(sum(z["w"] * have.get(z["i"], 0.0) for z in p)))
            yield pd.DataFrame({"a": batch.a, "b": batch.b, "similarity": s})

    return met.join(va, "a").join(vb, "b").mapInPandas(dot, "a long, b long, similarity double").where(F.col("similarity") >= least)


def _all(classes: DataFrame, least: float, most: int) -> DataFrame:
    """(a, b, similarity) with similarity >= ``least``, by products of blocks; only the ``most`` best of a product leave it."""
    parts = max(1, -(-classes.count() // BLOCK))
    blocks = classes.withColumn("p", F.pmod(F.xxhash64("num"), F.lit(parts)).cast("int")).groupBy("p").agg(F.collect_list(F.struct("num", "head", "v")).alias("rows"))
    # Every block goes to itself and the later ones by a shuffle: an equi-join, nothing is broadcast.
    x, y = blocks.select(F.col("rows").alias("ra"), F.explode(F.sequence("p", F.lit(parts - 1))).alias("pb")), blocks.select(F.col("p").alias("pb"), F.col("rows").alias("rb"))
    met = x.join(y.hint("merge"), "pb").select("ra", "rb")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ra, rb in zip(batch.ra, batch.rb):
                width = 1 + max((z["i"] for r in (*ra, *rb) for z in r["v"]), default=0)
                s = _dense([r["v"] for r in ra], width) @ _dense([r["v"] for r in rb], width).T
                na, nb = (np.array([r["num"] for r in rows]) for rows in (ra, rb))
                met = (s >= least) & (na[:, None] != nb[None, :])
                if ra[0]["num"] == rb[0]["num"]:  # a block with itself
                    met &= na[:, None] < nb[None, :]
                i, j = np.nonzero(met)
                r = np.round(s[i, j], 6)
                if len(r) > most:  # all that tie with the last stay for the moment
                    keep = r >= np.partition(r, len(r) - most)[len(r) - most]
                    i, j, r = i[keep], j[keep], r[keep]
                ends = [sorted((ra[p]["head"], rb[q]["head"])) for p, q in zip(i, j)]
                order = sorted(range(len(r)), key=lambda k: (-r[k], ends[k]))[:most]
                yield pd.DataFrame({"a": na[i[order]], "b": nb[j[order]], "similarity": s[i[order], j[order]]})

    return met.mapInPandas(best, "a long, b long, similarity double")


def top_pairs(counts: DataFrame, vocab: DataFrame, key: str, least: float, most: int) -> DataFrame:
    """(key_a, key_b, similarity), key_a < key_b: the ``most`` most similar pairs, at least ``least`` (over 0), ties by the keys.

    Similarities are rounded to six decimals. Every pair counts, however common its
    tokens. Documents with equal counts are one class. Pairs above a similarity near 1
    are found exactly among neighbours; if they fill the list, no other pair can enter
    it, else all pairs of classes are compared.
    """
    classes, members = _classes(counts, vocab, key, most)
    same = members.where("rn = 2").select(F.col("num").alias("a"), F.col("num").alias("b"), F.lit(1.0).alias("similarity"))
    heads = classes.select("num", "head")

    def spread(links: DataFrame) -> DataFrame:
        """The best pairs of documents in the best links; a link's first pair is that of its heads."""
        x, y = heads.select(F.col("num").alias("a"), F.col("head").alias("x")), heads.select(F.col("num").alias("b"), F.col("head").alias("y"))
        between = links.join(x, "a").join(y, "b").select("a", "b", "similarity", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        second = members.where("rn = 2").select(F.col("num").alias("b"), F.col("_k").alias("y"))
        within = same.join(x, "a").join(second, "b").select("a", "b", "similarity", "x", "y")
        top = between.unionByName(within).withColumn("similarity", F.round("similarity", 6)).orderBy(F.desc("similarity"), "x", "y").limit(most).select("a", "b", "similarity")
        x, y = members.select(F.col("num").alias("a"), F.col("_k").alias("x")), members.select(F.col("num").alias("b"), F.col("_k").alias("y"))
        pairs = top.join(x, "a").join(y, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
        return pairs.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"), "similarity").orderBy(F.desc("similarity"), f"{key}_a", f"{key}_b").limit(most)

    for level in CLOSE if classes.count() > BLOCK else ():
        if level - TIE > least:
            found = cut(spread(_close(classes, level - TIE)))
            if found.where(F.col("similarity") >= level).count() >= most:
                return found
    return spread(_all(classes, least, most))
