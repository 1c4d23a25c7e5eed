"""Records that are nearly the same writing (problem 2).

Meet-in-the-middle ball hashing over sets of word shingles. The fingerprint of a record
is its set of shingles, the distance of two records what has to be dropped from both to
make them equal, and two similar records meet in the middle: in the shingles that they
share. The threshold bounds how many shingles either record may drop, so every record
emits all variants within its half of the radius. The variants of a record are
exponentially many, but they can be named by their rarest shingle left, and these names
are few: with ``r`` drops, one of the first ``r + 1`` shingles in one global order, rarest
first. Variants are shuffled by name; pairs that collide are tested by how much can be
left after the shingle that they met in and by a sketch of their sets, come down to one
row each, and are compared exactly. No pair with the threshold's similarity is lost.

A ball in the Hamming space of fixed-length bit fingerprints cannot serve a
similarity of one half (see the README); the ball here is one of dropped shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import cut

SKETCH = 8  # longs of the parity sketch that goes with a variant
BUCKETS = 1 << 20  # counts of shingles that order the variants: 8 MB, broadcast
SLICE = 2_000_000  # shingles that a worker orders at once
FEW = 500_000  # colliding pairs (two longs each) that are broadcast to the sets; more are shuffled


def word_list(text: Column) -> Column:
    """The words of ``text``: maximal runs of a-z and 0-9, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(tokens: Column, words: int) -> Column:
    """The distinct hashes of all runs of ``words`` words. ``tokens`` is to be a plain column: it is read for every run."""
    at = F.when(F.size(tokens) >= words, F.sequence(F.lit(0), F.size(tokens) - words)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(words)])))


def _classes(records: DataFrame, key: str, text: Column, words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Classes (num, set, size) of records with equal sets, and members (key, num)."""
    sets = records.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), word_list(text).alias("w")).select("_k", F.sort_array(shingles(F.col("w"), words)).alias("set"))
    # No filter on the set before this point: it would be pushed below and work out the set again for every run.
    sets = cut(sets.select("_k", "set", F.xxhash64("set").alias("h"), F.xxhash64("set", F.lit(1)).alias("g")))
    # Copies come down to one row per partition before the shuffle.
    classes = sets.where(F.size("set") >= least).groupBy("h", "g").agg(F.first("set").alias("set"))
    classes = cut(classes.select("h", "g", "set", F.size("set").alias("size"), F.monotonically_increasing_id().alias("num")))
    members = cut(sets.select("_k", "h", "g").join(classes.select("h", "g", "num"), ["h", "g"]).select("_k", "num").distinct())
    return classes.select("num", "set", "size"), members


def _counts(classes: DataFrame) -> np.ndarray:
    """Shingles of all classes in each of BUCKETS buckets: a table of fixed size, whatever the corpus."""
    at = classes.select(F.explode("set").alias("s")).select(F.col("s").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))
    out = np.zeros(BUCKETS, dtype=np.int64)
    for part in at.groupBy("b").agg(F.count("*").alias("n")).toArrow().to_batches():
        out[part["b"].to_numpy()] = part["n"].to_numpy()
    return out


def _named(batch: pa.RecordBatch, counts: np.ndarray, least: float) -> pa.RecordBatch:
    """Classes (num, size, set) with their first names in the global order and their sketches instead of the sets."""
    sizes = batch["size"].to_numpy().astype(np.int64)
    flat = batch["set"].flatten().to_numpy()
    rec = np.repeat(np.arange(len(sizes)), sizes)
    start = np.cumsum(sizes) - sizes
    # The global order: shingles of rare buckets first, then by a mix of the hash.
    order = np.lexsort((flat * np.int64(-7046029254386353131), counts[flat & (BUCKETS - 1)], rec))
    names = sizes - np.ceil(least * sizes).astype(np.int64) + 1
    keep = (np.arange(len(flat)) - start[rec]) < names[rec]
    bits = np.bincount(rec * (64 * SKETCH) + (flat >> 20) % (64 * SKETCH), minlength=len(sizes) * 64 * SKETCH) & 1
    sketch = np.packbits(bits.astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view(np.int64).reshape(-1, SKETCH)
    ends = np.concatenate([[0], np.cumsum(np.minimum(names, sizes))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[order][keep]))
    return pa.RecordBatch.from_arrays([batch["num"], batch["size"], lists, *[pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(SKETCH)]], ["num", "size", "names", *[f"m{j}" for j in range(SKETCH)]])


def variants(classes: DataFrame, threshold: float) -> DataFrame:
    """(num, size, at, s, middle, m0, m1, ...): the names ``s`` of all variants of each class.

    ``at`` counts the shingles before ``s``, ``middle`` says that the class may drop as
    many and still be the smaller of a pair, m0 and so on are its sketch. Rarity only
    orders the names, so counts by bucket serve as well as counts by shingle: texts need
    not be shuffled by shingle to learn them.
    """
    # A little less than the threshold, so that no rounding shortens the names.
    least = threshold - 1e-9
    counts = classes.sparkSession.sparkContext.broadcast(_counts(classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices of bounded memory, however long the texts.
            at, total = 0, np.cumsum(batch["size"].to_numpy().astype(np.int64))
            while at < len(total):
                end = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, "right")), at + 1)
                yield _named(batch.slice(at, end - at), counts.value, least)
                at = end

    sketch = [f"m{j}" for j in range(SKETCH)]
    named = classes.select("num", "size", "set").mapInArrow(run, "num long, size int, names array<long>, " + ", ".join(f"{m} long" for m in sketch))
    half = F.col("size") - F.ceil(2 * least / (1 + least) * F.col("size")).cast("int")
    return named.select("num", "size", *sketch, F.posexplode("names").alias("at", "s")).withColumn("middle", F.col("at") <= half)


def colliding(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), distinct, of classes that meet in a variant, among them all with similarity >= ``threshold``; ``a`` is no larger than ``b``.

    Two sets of sizes m and n with similarity t share t / (1 + t) * (m + n) shingles, so
    the first that they share has at least as many from there on in either set. For the
    smaller set that is 2 t / (1 + t) of its size, which shortens its side. Each shingle
    flips one bit of a sketch, so sketches differ in no more bits than there are
    shingles in one set alone.
    """
    least = threshold - 1e-9
    v = variants(classes, threshold)
    x, y = (side.select(F.col("num").alias(c), F.col("size").alias(f"n{c}"), F.col("at").alias(f"i{c}"), "s", *[F.col(f"m{j}").alias(f"{c}{j}") for j in range(SKETCH)]) for side, c in ((v.where("middle"), "a"), (v, "b")))
    na, nb = F.col("na"), F.col("nb")
    smaller = ((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))) & (na >= least * nb)
    enough = F.least(na - F.col("ia"), nb - F.col("ib")) * (1 + least) >= least * (na + nb)
    differ = sum((F.bit_count(F.col(f"a{j}").bitwiseXOR(F.col(f"b{j}"))) for j in range(1, SKETCH)), F.bit_count(F.col("a0").bitwiseXOR(F.col("b0"))))
    alike = differ * (1 + least) <= (1 - least) * (na + nb)
    # Sides of unknown size: sorted and merged, with skewed names split, never broadcast.
    return x.join(y.hint("merge"), "s").where(smaller & enough & alike).select("a", "b").distinct()


def near_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity), a < b, of classes with similarity >= ``threshold``: colliding variants, compared exactly."""
    met = cut(colliding(classes, threshold))
    # Sets move once they are known to be compared: few pairs go to the sets, many pairs fetch them.
    how = "broadcast" if met.count() <= FEW else "merge"
    side = lambda c: classes.select(F.col("num").alias(c), F.col("set").alias(f"s{c}")).join(met.hint(how), c)
    both = side("a").join(side("b").hint("merge"), ["a", "b"])
    both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("n"), (F.size("sa") + F.size("sb")).alias("total"))
    near = both.where(F.col("n") >= threshold * (F.col("total") - F.col("n")))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("n") / (F.col("total") - F.col("n"))).alias("similarity"))


def near_copies(records: DataFrame, key: str, text: Column, *, threshold: float = 0.8, words: int = 5, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links, members): pairs of classes that are nearly the same, and the class of each key.

    ``records`` holds one row per key; rows with a null key, and rows with fewer than
    ``least`` distinct shingles (null, empty and short texts), belong to no class. Rows
    with equal sets of shingles share a class. An empty table gives two empty results.
    Columns other than the key and those in ``text`` are not read.
    """
    classes, members = _classes(records, key, text, words, least)
    return cut(near_classes(classes, threshold)), members.select(F.col("_k").alias(key), F.col("num").alias("class"))


def near_pairs(links: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b), key_a < key_b: links between classes and equality within them, expanded to records."""
    several = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1")
    all_links = links.select("a", "b").unionByName(several.select(F.col("class").alias("a"), F.col("class").alias("b")))
    x, y = members.select(F.col("class").alias("a"), F.col(key).alias("x")), members.select(F.col("class").alias("b"), F.col(key).alias("y"))
    met = all_links.join(x.hint("merge"), "a").join(y.hint("merge"), "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b"))
