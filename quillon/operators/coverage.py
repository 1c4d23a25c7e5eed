"""Properties that a peer of a composition has and it lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import cut

WORD = 62  # properties in one long of a set
FIRST, GROWTH = 64, 16  # peers that are tried in the first round, and how many times as many in each later one
SALT = 32


def _named(names: list[str], words: list[Column]) -> Column:
    hits = [F.when(words[i // WORD].bitwiseAND(F.lit(1 << (i % WORD))) != 0, F.lit(n)) for i, n in enumerate(names)]
    return F.array_join(F.filter(F.array(*hits), lambda x: x.isNotNull()), "|")


def coverage_gaps(facts: DataFrame, places: DataFrame, most: int = 3) -> DataFrame:
    """(composition, peer, missing): for each composition with two properties or more the first peer, by name, that has one to ``most`` properties which it lacks.

    ``facts``: composition, property_name. ``places``: composition, structure; peers share
    a structure. Nulls count for nothing, rows that are repeated once; ``missing`` joins the
    names in order. An empty table gives an empty result. Compositions with one set of properties in
    one structure count as one peer, the first. Peers are tried in order, FIRST in the
    first round and GROWTH times as many in each round after it, and only for what no
    earlier round has settled, so few of all pairs are made; rounds go on until nothing
    is open or no peers are left. Property names are held by the driver: a bounded list.
    """
    spark = facts.sparkSession
    facts = facts.where("composition is not null and property_name is not null").select("composition", "property_name")
    names = [r[0] for r in facts.select("property_name").distinct().orderBy("property_name").collect()]
    n = max(1, -(-len(names) // WORD))
    cols = [f"w{i}" for i in range(n)]
    bits = F.broadcast(spark.createDataFrame([(p, i // WORD, 1 << (i % WORD)) for i, p in enumerate(names)], "property_name string, word int, bit long"))
    masks = facts.join(bits, "property_name").groupBy("composition").agg(*[F.coalesce(F.bit_or(F.when(F.col("word") == i, F.col("bit"))), F.lit(0)).alias(c) for i, c in enumerate(cols)])
    k = cut(places.where("composition is not null and structure is not null").select("composition", "structure").distinct().join(masks, "composition"))
    sets = cut(k.groupBy("structure", *cols).agg(F.min("composition").alias("peer")))
    salt = F.pmod(F.xxhash64("peer"), F.lit(SALT))
    mine = [F.col(c) for c in cols]
    open_ = sets.where(sum((F.bit_count(c) for c in mine[1:]), F.bit_count(mine[0])) >= 2).select("structure", *cols)
    lacking = [F.col(f"t{i}").bitwiseAND(F.bitwise_not(F.col(c))) for i, c in enumerate(cols)]
    count = sum((F.bit_count(x) for x in lacking[1:]), F.bit_count(lacking[0]))
    settled, tried, size = None, None, FIRST
    while True:
        # The next peers of each structure: a structure with a third of all peers is ranked in SALT parts, then their heads.
        rest = sets if tried is None else sets.join(F.broadcast(tried), "structure").where("peer > last")
        head = rest.withColumn("rn", F.row_number().over(Window.partitionBy("structure", salt).orderBy("peer"))).where(F.col("rn") <= size)
        head = cut(head.withColumn("rn", F.row_number().over(Window.partitionBy("structure").orderBy("peer"))).where(F.col("rn") <= size).select("structure", "peer", *[F.col(c).alias(f"t{i}") for i, c in enumerate(cols)]))
        met = open_.join(head, "structure").where(count.between(1, most))
        best = cut(met.groupBy("structure", *cols).agg(F.min(F.struct("peer", *[x.alias(f"m{i}") for i, x in enumerate(lacking)])).alias("b")))
        settled = best if settled is None else settled.unionByName(best)
        # One row a structure: of the size of the reference list of structures.
        tried = cut(head.groupBy("structure").agg(F.max("peer").alias("last"), F.count("*").alias("n")))
        going = tried.where(F.col("n") >= size).drop("n")
        open_ = cut(open_.join(best.select("structure", *cols), ["structure", *cols], "left_anti").join(going.select("structure"), "structure", "left_semi"))
        if open_.isEmpty():
            break
        tried, size = going, size * GROWTH
    found = k.join(settled, ["structure", *cols]).groupBy("composition").agg(F.min("b").alias("b"))
    return found.select("composition", "b.peer", _named(names, [F.col(f"b.m{i}") for i in range(n)]).alias("missing"))
