"""All pairs of set-valued records that overlap enough (problem 4).

Size-aware overlap join: a small set emits all its token subsets of the sizes that a
partner must share with it; equal subsets meet. A large set scans inverted lists of
its rarest tokens. The union of both is filtered by the exact similarity. Records with
equal sets form one class, which is joined once.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

SMALL = 12  # sets of up to this many tokens enumerate subsets, larger ones scan lists: a choice of plan, no cap


def clean_set(values: Column) -> Column:
    """Trimmed, lower-cased values without nulls, blanks and repeats, in order; null for null."""
    trimmed = F.transform(values, lambda v: F.lower(F.regexp_replace(v, r"^\s+|\s+$", "")))
    return F.sort_array(F.array_distinct(F.filter(trimmed, lambda v: v.isNotNull() & (v != ""))))


def least_overlap(a: int, b: int, threshold: Fraction) -> int:
    """The least overlap of sets of sizes ``a`` and ``b`` with intersection over union >= ``threshold``."""
    t = threshold * (a + b) / (1 + threshold)
    return -(-t.numerator // t.denominator)


def _partner_sizes(a: int, threshold: Fraction) -> range:
    low, high = threshold * a, a / threshold
    return range(-(-low.numerator // low.denominator), high.numerator // high.denominator + 1)


def _drops(h: Column, r: int) -> Column:
    """Xors of all choices of ``r`` elements of the array ``h`` of hashes."""
    if r == 0:
        return F.array(F.lit(0).cast("long"))
    grown = F.transform(h, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    for _ in range(r - 1):
        grown = F.flatten(F.transform(grown, lambda s: F.transform(F.slice(h, s["i"] + 2, F.size(h)), lambda x, j: F.struct((s["i"] + 1 + j).alias("i"), s["x"].bitwiseXOR(x).alias("x")))))
    return F.transform(grown, lambda s: s["x"])


def _signed(h: Column, dropped: int, c: int) -> Column:
    """Structs (c, sig) of all subsets of ``c`` tokens, by the hashes of the tokens that each one drops."""
    return F.transform(_drops(h, dropped), lambda x: F.struct(F.lit(c).alias("c"), F.col("all").bitwiseXOR(x).alias("sig")))


def _subsets(classes: DataFrame, threshold: Fraction, least: int, small: int) -> DataFrame:
    """(id, size, c, sig): a signature of every subset of ``c`` tokens that a small partner may share."""
    sets = classes.where(F.col("size") <= small).withColumn("h", F.transform("set", lambda v: F.xxhash64(v))).withColumn("all", F.aggregate("h", F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
    per_size = []
    for a in range(least, small + 1):
        wanted = sorted({least_overlap(a, b, threshold) for b in _partner_sizes(a, threshold) if least <= b <= small})
        arrays = [_signed(F.col("h"), a - c, c) for c in wanted if c <= a]
        if arrays:
            per_size.append((a, F.concat(*arrays)))
    if not per_size:
        return sets.select("id", "size", F.lit(0).alias("c"), F.lit(0).cast("long").alias("sig")).where("false")
    chosen = reduce(lambda acc, x: acc.when(F.col("size") == x[0], x[1]), per_size[1:], F.when(F.col("size") == per_size[0][0], per_size[0][1]))
    return sets.select("id", "size", F.explode(chosen).alias("s")).select("id", "size", "s.c", "s.sig")


def similar_classes(classes: DataFrame, threshold: float, *, least: int = 1, small: int = SMALL) -> DataFrame:
    """(id_a, id_b, overlap, similarity), id_a < id_b, of distinct sets with similarity >= ``threshold``.

    ``classes``: (id, set) with distinct, sorted sets without nulls and unique ids.
    Sets of fewer than ``least`` values are left out.
    """
    t = Fraction(str(threshold))
    sized = classes.select("id", "set", F.size("set").alias("size")).where(F.col("size") >= max(least, 1))
    sig = _subsets(sized, t, max(least, 1), small)
    a, b = sig.select(F.col("id").alias("id_a"), F.col("size").alias("size_a"), "c", "sig"), sig.select(F.col("id").alias("id_b"), F.col("size").alias("size_b"), "c", "sig")
    # A pair meets only under the overlap that its two sizes ask for, so each meeting is a match.
    num, den = t.numerator, t.numerator + t.denominator
    need = F.ceil((F.lit(num) * (F.col("size_a") + F.col("size_b")) / den).cast("decimal(20,9)")).cast("int")
    met = a.join(b.hint("merge"), ["c", "sig"]).where((F.col("id_a") < F.col("id_b")) & (need == F.col("c"))).select("id_a", "id_b")

    # Large sets: lists of the tokens in the part of each set that a match must touch, rarest first.
    reach = t * (small + 1)
    floor = -(-reach.numerator // reach.denominator)
    near = sized.where(F.col("size") >= floor)
    tokens = near.select("id", "size", F.explode("set").alias("token"))
    df = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    ranked = tokens.join(df, "token").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    # Tokens that no other set has cannot be shared; they stand first and count as touched.
    kept = F.col("size") - F.ceil((F.lit(t.numerator) * F.col("size") / t.denominator).cast("decimal(20,9)")).cast("int") + 1 - (F.col("size") - F.size("ts"))
    lists = ranked.select("id", "size", F.explode(F.slice("ts", F.lit(1), F.greatest(kept, F.lit(0)))).alias("x")).select("id", "size", F.col("x.token").alias("token"))
    p = lists.where(F.col("size") > small).select(F.col("id").alias("id_x"), F.col("size").alias("size_x"), "token")
    q = lists.select(F.col("id").alias("id_y"), F.col("size").alias("size_y"), "token")
    fit = (F.col("size_y") * t.denominator >= F.col("size_x") * t.numerator) & (F.col("size_x") * t.denominator >= F.col("size_y") * t.numerator)
    scanned = p.join(q.hint("merge"), "token").where((F.col("id_x") != F.col("id_y")) & fit).select(F.least("id_x", "id_y").alias("id_a"), F.greatest("id_x", "id_y").alias("id_b"))
    met = met.unionByName(scanned)
    met = met.distinct()
    sa, sb = sized.select(F.col("id").alias("id_a"), F.col("set").alias("set_a")), sized.select(F.col("id").alias("id_b"), F.col("set").alias("set_b"))
    overlap = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("overlap")
    both = met.join(sa.hint("merge"), "id_a").join(sb.hint("merge"), "id_b").withColumn("overlap", overlap)
    return both.where(F.col("overlap") * t.denominator >= union * t.numerator).select("id_a", "id_b", "overlap", (F.col("overlap") / union).alias("similarity"))


def set_records(df: DataFrame, key: str, values: str, kind: str) -> DataFrame:
    """(kind, key, set) with one row per non-null key; of repeated keys the least set counts; null and empty sets are left out."""
    s = df.select(F.col(key).cast("string").alias("key"), clean_set(F.col(values)).alias("set")).where(F.col("key").isNotNull() & (F.size("set") > 0))
    return s.groupBy("key").agg(F.min("set").alias("set")).select(F.lit(kind).alias("kind"), "key", "set")


def classed(records: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Classes (id, set) of equal sets and their members (id, kind, key); a class has the id of its least member."""
    rows = records.where(F.size("set") >= least)
    classes = cut(rows.groupBy("set").agg(F.min(F.struct("key", "kind")).alias("m")).select(F.concat_ws("/", "m.kind", "m.key").alias("id"), "set"))
    return classes, rows.join(classes, "set").select("id", "kind", "key")


def overlapping_pairs(records: DataFrame, threshold: float, *, least: int = 1, apart: tuple[str, ...] = ()) -> DataFrame:
    """(key_a, key_b, overlap, similarity), key_a < key_b, of all records whose sets overlap enough.

    ``records``: (kind, key, set) as ``set_records`` makes them. Two records of one kind
    in ``apart`` are no case. Copies are expanded here, because the result asks for
    pairs of records; the join itself works on classes. An empty table gives an empty
    result.
    """
    classes, members = classed(records, least)
    members = cut(members)
    links = similar_classes(classes, threshold, least=least)
    same = classes.select(F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.size("set").alias("overlap"), F.lit(1.0).alias("similarity"))
    # Classes of one record have no pair within.
    several = members.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("id_a"))
    links = links.unionByName(same.join(several, "id_a", "left_semi"))
    a, b = members.select(F.col("id").alias("id_a"), F.col("kind").alias("kind_a"), F.col("key").alias("x")), members.select(F.col("id").alias("id_b"), F.col("kind").alias("kind_b"), F.col("key").alias("y"))
    met = links.join(a.hint("merge"), "id_a").join(b.hint("merge"), "id_b").where((F.col("id_a") != F.col("id_b")) | (F.col("x") < F.col("y")))
    for kind in apart:
        met = met.where(~((F.col("kind_a") == kind) & (F.col("kind_b") == kind)))
    return met.where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "overlap", "similarity").distinct()
