"""Texts as inverted indexes, one row per text and word, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, row, word, positions) of each row with a text; a text without words has one row with a null word.

    ``row`` tells rows with one key apart. A text's words are grouped, so that the work
    grows with the length of a text and not with its square.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias(key), F.monotonically_increasing_id().alias("row"), F.filter(F.split(text, r"\s+"), lambda w: w != "").alias("_w"))
    return rows.select(key, "row", F.posexplode_outer("_w").alias("_p", "word")).groupBy(key, "row", "word").agg(F.collect_list("_p").alias("positions"))


def texts_of(index: DataFrame, key: str) -> DataFrame:
    """(key, decoded): the words of each row in the order of their positions, joined by blanks."""
    at = index.select(key, "row", "word", F.explode_outer("positions").alias("_p"))
    words = at.groupBy(key, "row").agg(F.sort_array(F.collect_list(F.struct(F.col("_p"), "word"))).alias("_ws"))
    return words.select(key, F.array_join(F.transform("_ws", lambda x: x["word"]), " ").alias("decoded"))
