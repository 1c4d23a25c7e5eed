"""Text that looks the same in one form of characters (problem 8).

Look-alike classes are the transitive closure (union-find) of pairs of strings and
code points: letters of other alphabets, width, ligatures and sign codes, kinds of
space, characters that cannot be seen. The most frequent member of a class in the
corpus stands for it. Texts are decomposed, rewritten greedily with a multi-pattern
automaton over all other members, and composed again.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other alphabets that look like Latin ones, as (alphabet, Latin).
LETTERS = [
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳϹͿ", "ABEZHIKMNOPTYXovpcjCJ"),  # Greek
    ("АВЕЅІЈКМНОРСТУХаесорхуіјѕһԁԛԝӏ", "ABESIJKMHOPCTYXaecopxyijshdqwl"),  # Cyrillic
    ("օոսհցզՕՏԼ", "onuhgqOSL"),  # Armenian
    ("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᏔᏃ", "ABCDEHJKLMPRSTVWZ"),  # Cherokee
    ("ꓮꓐꓚꓓꓰꓝꓖꓧꓲꓙꓗꓡꓟꓠꓳꓑꓣꓢꓔꓴꓦꓪꓫꓬꓜ", "ABCDEFGHIJKLMNOPRSTUVWXYZ"),  # Lisu
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ", "BHIKMNOPCTYXopc"),  # Coptic
    ("ɡɑ", "ga"),  # phonetic
]
# Signs with several codes, as strings that look alike.
SIGNS = [
    ("‐", "-"), ("‑", "-"), ("﹣", "-"), ("∆", "Δ"), ("∑", "Σ"), ("∏", "Π"), ("⋅", "·"), ("∙", "·"), ("·", "·"), ("∕", "/"), ("⁄", "/"),
    ("∶", ":"), ("ʼ", "’"), ("∣", "|"), ("∼", "~"), ("′′", "″"), ("º", "˚"), ("‥", ".."), ("․", "."), (";", ";"), ("ˈ", "'"), ("ǀ", "|"),
]
# Characters without a glyph that are not of a format category.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, (*range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))))
# Compatibility mappings that keep the look; raised, lowered, circled, fraction and font forms do not.
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>")


class UnionFind:
    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        root = self.parent.setdefault(x, x)
        while root != self.parent[root]:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def classes(self) -> list[list[str]]:
        out = defaultdict(list)
        for x in self.parent:
            out[self.find(x)].append(x)
        return [sorted(v) for v in out.values()]


def same_look(c: str) -> str | None:
    """The string that the one character ``c`` looks like by the Unicode data; None if there is no other."""
    category = unicodedata.category(c)
    if category == "Cf" or c in UNSEEN:
        return ""
    if category == "Zs":
        return " " if c != " " else None
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return None
    if parts[0].startswith("<"):
        if parts[0] not in SAME_LOOK:
            return None
        text = "".join(chr(int(x, 16)) for x in parts[1:])
        if " " in text or unicodedata.category(c) in ("Po", "Ps", "Pe", "Pd") and parts[0] == "<wide>":
            return None  # a spaced accent; punctuation of full width is punctuation of its own
        return unicodedata.normalize("NFD", "".join(same_look(x) or x for x in text))
    return None  # canonical decompositions are undone by the normal form itself


def pairs(seen: Iterator[str] | None = None) -> list[tuple[str, str]]:
    """Look-alike pairs: the fixed lists, and by rule those of the characters in ``seen`` (all by default)."""
    out = [(a, b) for other, latin in LETTERS for a, b in zip(other, latin)] + list(SIGNS)
    for c in seen if seen is not None else map(chr, range(sys.maxunicode + 1)):
        for x in unicodedata.normalize("NFD", c):
            if (to := same_look(x)) is not None:
                out.append((x, to))
    return out


def representatives(counts: dict[str, int]) -> dict[str, str]:
    """Each member of a look-alike class that another stands for, with that other, in decomposed form.

    ``counts``: characters of the corpus. The class of what cannot be seen is rewritten
    to nothing; a string of several characters never stands for its class unless all
    other members are such. Ties go to the least string.
    """
    decomposed: Counter[str] = Counter()
    for c, n in counts.items():
        for x in unicodedata.normalize("NFD", c):
            decomposed[x] += n
    union = UnionFind()
    for a, b in pairs(iter(sorted(counts))):
        union.join(unicodedata.normalize("NFD", a), unicodedata.normalize("NFD", b))
    chosen: dict[str, str] = {}
    for members in union.classes():
        if "" in members:
            best = ""
        else:
            strings = [m for m in members if len(m) > 1]
            # A ligature or sign that spells out is written as what it spells.
            best = strings[0] if strings else min(members, key=lambda m: (-decomposed[m], m))
        chosen |= {m: best for m in members if m != best}
    # What a string spells is written with the representatives of its characters.
    for m, best in list(chosen.items()):
        chosen[m] = "".join(chosen.get(x, x) if len(best) > 1 else x for x in best)
    return chosen


class Rewriter:
    """Greedy longest-match rewriting of every pattern to the member that stands for it."""

    def __init__(self, chosen: dict[str, str]):
        self.table = {ord(a): b for a, b in chosen.items() if len(a) == 1}
        self.automaton = ahocorasick.Automaton()
        for a, b in chosen.items():
            if a:
                self.automaton.add_word(a, (len(a), b))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.plain = not any(a.isascii() for a in chosen if a)

    def __call__(self, text: str | None) -> str | None:
        if text is None or (self.plain and text.isascii()) or not len(self.automaton):
            return text
        t = unicodedata.normalize("NFD", text)
        out, at = [], 0
        for end, (n, to) in self.automaton.iter_long(t):
            start = end + 1 - n
            out.append(t[at:start])
            out.append(to)
            at = end + 1
        out.append(t[at:])
        return unicodedata.normalize("NFC", "".join(out))


def character_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often each character occurs in all texts: at most one row for each code point of Unicode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for b in batches:
            for t in b["t"]:
                total.update(t)
        if total:
            yield pd.DataFrame({"c": list(total), "n": list(total.values())})

    counted = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t")).mapInPandas(run, "c string, n long")
    return {r["c"]: r["n"] for r in counted.groupBy("c").agg(F.sum("n").alias("n")).collect()}


def normalize_looks(docs: DataFrame, *, text: str = "text", into: str = "looks") -> DataFrame:
    """``docs`` with the column ``into``: ``text`` in one form of characters, null for null.

    An existing column of the name ``into`` is replaced. Case, accents, punctuation,
    line breaks, tabs and raised or lowered digits stay.
    """
    chosen = representatives(character_counts(docs, text))
    rest = docs.drop(into) if into != text else docs

    @F.pandas_udf("string")
    def rewrite(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        rewriter = Rewriter(chosen)
        for b in batches:
            yield b.map(rewriter, na_action="ignore")

    return rest.withColumn(into, rewrite(F.col(text)))


def same_looking_pairs(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key_a, key_b), smaller first, of rows whose texts look the same and are not the same string.

    Null keys and null texts, and texts without any visible character, are no case.
    Rows repeated with the same key and text count once. Exact copies of one text form a
    class; only pairs of differing classes with one look are joined, so a group of
    copies costs no more than the rows it takes part in.
    """
    base = normalize_looks(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(text).alias("_t")), text="_t", into="_n")
    from quillon.session import cut

    keyed = cut(base.where(F.col("_n").rlike(r"[^\p{IsWhite_Space}\p{Cntrl}]")).select("_k", F.md5(F.col("_n").cast("binary")).alias("look"), F.md5(F.col("_t").cast("binary")).alias("own")).distinct())
    variants = keyed.select("look", "own").distinct()
    # Looks with more than one string: what is joined from here on is a case.
    several = variants.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    variants = variants.join(several, "look", "left_semi")
    a, b = variants.withColumnRenamed("own", "own_a"), variants.withColumnRenamed("own", "own_b")
    classes = a.join(b, "look").where("own_a < own_b")
    rows = keyed.join(several, "look", "left_semi")
    left = classes.join(rows.select("look", F.col("own").alias("own_a"), F.col("_k").alias("x")), ["look", "own_a"])
    both = left.join(rows.select("look", F.col("own").alias("own_b"), F.col("_k").alias("y")), ["look", "own_b"])
    return both.where("x <> y").select(F.least("x", "y").alias(f"{key}_a"), F.greatest("x", "y").alias(f"{key}_b")).distinct()
