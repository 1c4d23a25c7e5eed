"""Free-entered values to the entries of a reference list (problem 5).

A multi-pattern automaton over canonical names and aliases finds embedded mentions;
the longest non-overlapping ones win. What it leaves open goes to token-set
similarity. Each distinct value is worked on once, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.names import AFTER, BEFORE, UNMATCHED, NameIndex, readings, simplify

MOST_ENTRIES = 100_000  # of a reference list, which the driver and each worker hold

_FRAME = {w for phrase in (*BEFORE, *AFTER) for w in phrase.split(" ")}


class Mentions:
    """The automaton over surface forms, with the similarity index behind it."""

    def __init__(self, forms: list[tuple[str, str]]):
        self.index = NameIndex(forms)
        self.automaton = ahocorasick.Automaton()
        for entry, form in forms:
            text = simplify(form)
            if text and text not in self.automaton:
                self.automaton.add_word(text, (entry, len(text)))
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> tuple[set[str], str]:
        """Entries mentioned in ``text`` as whole words, and what is left around the mentions."""
        if not len(self.automaton):
            return set(), text
        hits = []
        for end, (entry, n) in self.automaton.iter(text):
            start = end + 1 - n
            if (start == 0 or not text[start - 1].isalnum()) and (end + 1 == len(text) or not text[end + 1].isalnum()):
                hits.append((-n, start, entry))
        taken: list[tuple[int, int]] = []
        entries: set[str] = set()
        for n, start, entry in sorted(hits):
            end = start - n
            if all(end <= a or start >= b for a, b in taken):
                taken.append((start, end))
                entries.add(entry)
        left, at = "", 0
        for a, b in sorted(taken):
            left, at = left + " " + text[at:a], b
        return entries, left + " " + text[at:]

    def entry(self, value: str) -> str:
        """The entry meant by ``value``, or UNMATCHED."""
        texts = readings(value)
        for text in texts:
            entries, left = self.found(text)
            if len(entries) == 1 and all(w in _FRAME or w.isdigit() for w in re.findall(r"\w+", left)):
                return entries.pop()
        for text in texts:
            if (hit := self.index.similar(text)) is not None:
                return hit
        for text in texts:
            entries, _ = self.found(text)
            if len(entries) == 1:
                return entries.pop()
        return UNMATCHED


def forms_of(terms: DataFrame, name: str, *others: str) -> list[tuple[str, str]]:
    """(entry, surface form) from the name, single-valued and array columns of a reference table.

    The reference list is held by the driver and by each worker: ``ValueError`` beyond
    MOST_ENTRIES entries. Null names are left out; ties between entries that share a form
    go to the least name.
    """
    out: list[tuple[str, str]] = []
    rows = terms.select(name, *others).where(F.col(name).isNotNull()).orderBy(name).limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a reference list of more than {MOST_ENTRIES} entries")
    for row in rows:
        out.append((row[0], row[0]))
        for v in row[1:]:
            out += [(row[0], x) for x in ([v] if isinstance(v, str) else (v or [])) if x]
    return sorted(out, key=lambda x: (x[0] != x[1],))


def map_values(values: DataFrame, lists: dict[str, list[tuple[str, str]]], *, field: str = "field", value: str = "value") -> DataFrame:
    """(field, value, entry) for each distinct free-entered value of ``values``.

    ``lists``: by field, the surface forms of its reference list. Values that are null,
    blank or already an entry, and fields without a list, are left out; values that
    mean no entry get ``UNMATCHED``. Only ``field`` and ``value`` are read.
    """
    exact = F.lit(False)
    for f, forms in lists.items():
        exact = exact | ((F.col("_f") == f) & F.col("_v").isin(sorted({e for e, _ in forms})))
    fields = sorted(lists)
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Distinct first (combined before the shuffle), then spread: the work is in CPU, not bytes.
    rest = values.select(F.col(field).alias("_f"), F.col(value).alias("_v")).where(F.col("_f").isin(fields) & (F.trim("_v") != "") & ~exact).distinct().repartition(n, "_v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        built = {f: Mentions(forms) for f, forms in lists.items()}
        for b in batches:
            b["entry"] = [UNMATCHED if not v.strip() else built[f].entry(v) for f, v in zip(b["_f"], b["_v"])]
            yield b

    return rest.mapInPandas(run, "_f string, _v string, entry string").select(F.col("_f").alias(field), F.col("_v").alias(value), "entry")


def map_to_canonical(df: DataFrame, key: str, lists: dict[str, list[tuple[str, str]]]) -> DataFrame:
    """(key, field, entry), distinct, for each row of ``df`` and each column named in ``lists`` that holds a free-entered value.

    Rows with a null key, null or blank values and values that are entries already are
    no case. Repeated rows count once; rows that repeat a key with another value give a
    row for each entry. Columns other than the key and the fields are not read. An
    empty table gives an empty result; an empty reference list gives ``UNMATCHED``.
    """
    # Blank in the sense of any white space, as the worker sees it.
    long = df.select(F.col(key).alias("_k"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in lists])).alias("_x")).select("_k", F.col("_x.f").alias("field"), F.col("_x.v").alias("value"))
    exact = F.lit(False)
    for f, forms in lists.items():
        exact = exact | ((F.col("field") == f) & F.col("value").isin(sorted({e for e, _ in forms})))
    long = long.where(F.col("_k").isNotNull() & F.col("value").rlike(r"\S") & ~exact)
    mapped = map_values(long, lists)
    # A value that fills a third of the rows is one row of ``mapped``; AQE splits its side of the join.
    return long.join(mapped, ["field", "value"]).select(F.col("_k").alias(key), "field", "entry").distinct()
