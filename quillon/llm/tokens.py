"""Encoding of a corpus with a public tokenizer (problem 6).

Texts are split into pre-tokens with positions; each distinct pre-token is encoded
once; ids come back by a join and are put together by position. Frequent pre-tokens
(a bounded head) meet the rows by broadcast, so a hot word never gathers in one task;
the open tail meets them in a shuffled join.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import cut

DEFAULT_FOLDER = "/opt/tokenizers"
HEAD = 50_000  # pre-tokens that are broadcast with their ids: at most some MB whatever the corpus

# Fixed value: the published splitting pattern of byte-level BPE, with the classes spelled for Java.
_JAVA_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a vocabulary file with one base64 token and its rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks(path), special_tokens={})


def vocabulary(folder: str = DEFAULT_FOLDER, name: str = "byte_bpe_50k") -> str:
    """The path of a vocabulary; every worker must see it."""
    return f"{folder}/{name}.tiktoken"


def pre_tokens(text: Column) -> Column:
    """The array of pre-tokens of ``text``; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(_JAVA_PATTERN), F.lit(0))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """Adds ``ids`` to rows with a distinct ``word``."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = encoding(path)
        for b in batches:
            b["ids"] = [code.encode_ordinary(w) for w in b["word"]]
            yield b

    return words.mapInPandas(run, f"{fields}, ids array<int>")


def _parts(docs: DataFrame, key: str, text: str, path: str | None, head: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts by key (_k, _t) in place, the coded distinct pre-tokens (word, n, ids), and the most frequent ``head`` of them."""
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    # Texts move once, by key: what is put together by key later then stays in place.
    base = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(text).alias("_t")).repartition(n, "_k")
    words = docs.select(F.explode(pre_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    coded = cut(encode_words(words, path or vocabulary()))
    return base, coded, coded.orderBy(F.desc("n"), "word").limit(head)


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, head: int = HEAD) -> DataFrame:
    """(key, tokens): the number of ids of each text, without the ids; 0 for null and empty texts. Else as ``encode_corpus``."""
    base, coded, top = _parts(docs, key, text, path, head)
    at = base.select("_k", F.explode(pre_tokens(F.col("_t"))).alias("word")).join(F.broadcast(top.select("word", F.size("ids").alias("_n"))), "word", "left")
    own = at.groupBy("_k").agg(F.sum("_n").alias("_own"))
    rest = at.where(F.col("_n").isNull()).select("_k", "word").join(coded.select("word", F.size("ids").alias("m")), "word").groupBy("_k").agg(F.sum("m").alias("_rest"))
    zero = F.lit(0).cast("bigint")
    return base.select("_k").join(own, "_k", "left").join(rest, "_k", "left").select(F.col("_k").alias(key), (F.coalesce("_own", zero) + F.coalesce("_rest", zero)).alias("tokens"))


def encode_corpus(docs: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, head: int = HEAD) -> DataFrame:
    """(key, ids) for each row of ``docs``: ids of the whole text, special strings taken as ordinary text.

    A null and an empty text give the empty list. Keys are to be unique and not null
    (rows with a null key are left out; rows repeated under one key count once, with
    the least text). Other columns are not read. An empty table gives an empty result.
    """
    base, coded, top = _parts(docs, key, text, path, head)
    top = top.select("word", F.col("ids").alias("_head"))
    at = base.select("_k", F.posexplode(pre_tokens(F.col("_t"))).alias("pos", "word"))
    near = at.join(F.broadcast(top), "word", "left")
    own = near.groupBy("_k").agg(F.collect_list(F.when(F.col("_head").isNotNull(), F.struct("pos", F.col("_head").alias("ids")))).alias("_own"))
    far = near.where(F.col("_head").isNull()).select("_k", "pos", "word").join(coded.select("word", "ids"), "word")
    rest = far.groupBy("_k").agg(F.collect_list(F.struct("pos", "ids")).alias("_rest"))
    none = F.array().cast("array<struct<pos:int,ids:array<int>>>")
    parts = F.sort_array(F.concat(F.coalesce("_own", none), F.coalesce("_rest", none)))
    # Rows with a null or empty text have no pre-tokens and keep the empty list.
    return base.select("_k").join(own, "_k", "left").join(rest, "_k", "left").select(F.col("_k").alias(key), F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, bytes) of a vocabulary: bounded by its size."""
    rows = [(i, bytearray(b)) for b, i in ranks(path or vocabulary()).items()]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(coded: DataFrame, *, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text) from lists of ids, by a join with the token-byte table; the empty list gives ''.

    Ids that the vocabulary lacks are left out. Null lists count as empty.
    """
    table = token_bytes(coded.sparkSession, path)
    flat = coded.select(F.col(key).alias("_k"), F.posexplode(ids).alias("pos", "id")).join(F.broadcast(table), "id")
    whole = flat.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("bytes").alias("h")))).alias("p"))
    text = whole.select("_k", F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["h"]), "")), "UTF-8").alias("text"))
    return coded.select(F.col(key).alias("_k")).join(text, "_k", "left").select(F.col("_k").alias(key), F.coalesce("text", F.lit("")).alias("text"))
