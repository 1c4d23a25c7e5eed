"""Records of one work across sources that share no identifier (problem 1).

Label-model linkage: records meet in blocks of a subject and a name, or of rare title
words where these lack; heuristic matching functions vote on each candidate; a
generative model learns from the votes alone how accurate they are and which depend on
each other, and gives the posterior. Words that sources put for each other in titles are
learned from the candidates too.
The model sees counts of vote patterns, a table bounded by 3 ** (number of functions).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations
from types import SimpleNamespace
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.names import edits
from quillon.session import cut

VOTES = ["title", "series", "authors", "year", "abstract", "keywords"]
VETO = {0: 0.002, 1: 0.0005, 2: 0.02}  # how often records of one work may differ in title, part or all authors
RARE = 4  # rarest title words by which records without names meet others, two at a time
SWAPS = 10_000  # learned pairs of words that stand for each other, the most frequent ones: what a worker holds
LEAST_SWAPS = 4  # candidates of two sources that must show such a pair, for every one of a single source and one more
# Notes around a title.
_NOTES = re.compile(r"\[(?:preprint|accepted manuscript|in press|corrigendum)\]|\((?:preprint|accepted manuscript|in press)\)|^(?:preprint|title)\s*:|\*+$")
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}


def plain(text: str) -> str:
    """Lower case without accents, markup and raised or lowered digits."""
    t = re.sub(r"\$_\{?([^${}]*)\}?\$|</?su[bp]>", lambda m: m[1] or "", text, flags=re.I).replace("₋", "-")
    t = unicodedata.normalize("NFKD", t)
    return "".join(c for c in t if not unicodedata.combining(c)).lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss")


def title_parts(title: str | None) -> tuple[list[str], int, bool]:
    """Words of a title without notes, the number of its part (0 if none), whether it says that it was cut."""
    t = plain(re.sub(r"(?<=[₀-₉])\.(?=[₀-₉])", ".", title or "")).strip()
    cut_off = bool(re.search(r"(?:\.\.\.|…)\W*$", (title or "").strip()))
    t = _NOTES.sub(" ", _NOTES.sub(" ", t).strip())
    part = 0
    if m := re.search(r"\bpart\s+([ivx]+|\d+)\W*$", t):
        part = _ROMAN.get(m[1], int(m[1]) if m[1].isdigit() else 0)
        t = t[: m.start()]
    words = [w.strip(".") for w in re.split(r"[\s\-‐‑–—:,;()\[\]/\"“”]+", t)]
    return [w for w in words if w], part, cut_off


def surnames(authors: list[str] | None) -> tuple[list[str], bool]:
    """Folded surnames in order, and whether the list says that there are more."""
    out, more = [], False
    for entry in authors if authors is not None else []:
        for a in re.split(r";|\band\b|&", entry or ""):
            if re.search(r"\bet\s+al\b", a, re.I):
                more, a = True, re.sub(r"\bet\s+al\b\.?", "", a, flags=re.I)
            name = plain(a).strip()
            if "," in name:
                name = name.split(",")[0]
            else:
                words = name.split()
                while len(words) > 1 and len(words[-1].strip(".")) <= 2:
                    words.pop()
                name = words[-1] if words else ""
            name = re.sub(r"[^\w\-]", "", name)
            if len(name) > 1:
                out.append(name)
    return list(dict.fromkeys(out)), more


def _subject(words: list[str]) -> str:
    """The first word that names a subject by letters and digits, as formulas and codes do."""
    return next((w for w in words if len(w) >= 6 and len(re.findall(r"\d", w)) >= 2 and re.search(r"[a-z]", w)), "")


def prepare(title, abstract, authors, keywords) -> dict:
    """What the votes and blocks need to know of one record."""
    words, part, cut_off = title_parts(title)
    names, more = surnames(authors)
    text = re.findall(r"[\w.]+", plain(abstract or ""))
    subject = _subject([w for w in words]) if not cut_off or _subject(words[:-1]) else ""
    subject = subject or _subject([w.strip(".") for w in text])
    head = re.sub(r"[\W\d_]", "", "".join(w for w in words if not re.search(r"\d", w)))
    runs = sorted({crc32(" ".join(x).encode()) for x in zip(text, text[1:], text[2:])}) if len(text) >= 12 else []
    blocks = set()
    if subject:
        # Either end of a name, as a misspelling seldom spoils both.
        blocks |= {f"{subject}|{n[:4]}" for n in names} | {f"{subject}|>{n[-4:]}" for n in names}
    # Records without names meet others of their subject by either end of the title.
    ends = sorted({f"{subject}<{head[:8]}", f"{subject}>{head[-8:]}"}) if subject else []
    # Titles cut before or within their subject meet others by a name and a part of the title.
    bare = not subject or not part and (subject not in words or words[-1] == subject)
    loose = sorted({f"{n}<{head[a : a + 8]}" for n in names for a in (0, 8) if len(head) >= a + 8})
    if not names and len(set(words)) < 2:
        ends.append(f"={''.join(words)}")
    if subject == "" and names and head:
        blocks |= {f"{n[:4]}={head[:16]}" for n in names}
    return {"words": words, "part": part, "cut": cut_off, "names": names, "more": more, "runs": runs, "kws": sorted({k.strip().lower() for k in (keywords if keywords is not None else []) if k and k.strip()}), "blocks": sorted(blocks), "ends": ends, "loose": loose, "bare": bare, "nameless": not names, "lost": not subject}


@lru_cache(maxsize=200_000)
def _near_word(a: str, b: str) -> bool:
    if a == b:
        return True
    least = min(len(a), len(b))
    if re.search(r"\d", a + b) or least < 4:
        return False
    most = 1 if least < 6 else 2 if least < 9 else 3
    return edits(a, b, most) <= most


def _near_name(x: str, y: str) -> bool:
    return min(len(x), len(y)) > 5 and abs(len(x) - len(y)) <= 1 and (x[0] == y[0] or x[-1] == y[-1]) and edits(x, y, 1) <= 1


def _spell_out(a: list[str], b: list[str]) -> list[str]:
    """``a`` with an abbreviation written out where words of ``b`` have its letters as initials."""
    for k, w in enumerate(a):
        n = len(w)
        if 2 <= n <= 5 and w.isalpha() and w not in b:
            for j in range(len(b) - n + 1):
                if all(x[:1] == c for x, c in zip(b[j : j + n], w)):
                    return a[:k] + b[j : j + n] + a[k + 1 :]
    return a


def vote_title(a: list[str], b: list[str], cut_a: bool, cut_b: bool) -> tuple[int, int, list[str]]:
    """The vote of two titles, the vote if the words named next stand for each other, and these words.

    2 the same words up to misspellings, 1 the same and one names a subject, 0 one is the
    beginning of the other, -1 different. The words are pairs "x y", x < y, of at most
    three positions that differ, none with a digit; no pairs if the titles differ more.
    """
    if not a or not b:
        return 0, 0, []
    a, b = _spell_out(a, b), _spell_out(b, a)
    if len(a) > len(b):
        a, b, cut_a, cut_b = b, a, cut_b, cut_a
    same = [_near_word(x, y) for x, y in zip(a, b)]

    def verdict(same: list[bool]) -> int:
        if len(a) == len(b) and all(same):
            return 1 if any(re.search(r"\d", w) for w in a) else 2
        last = all(same[:-1]) and (same[-1] or b[len(a) - 1].startswith(a[-1]) or (cut_a and cut_b and a[-1].startswith(b[len(a) - 1])))
        if len(a) >= 4 and last and (len(a) < len(b) or cut_a or cut_b):
            return 0
        x, y = "".join(a), "".join(b)
        if abs(len(a) - len(b)) == 1 and re.sub(r"\D", "", x) == re.sub(r"\D", "", y) and edits(x, y, 2) <= 2:
            return 1
        return -1

    vote = verdict(same)
    apart = [k for k, s in enumerate(same) if not s and not (k == len(a) - 1 and (cut_a or cut_b or len(a) < len(b)))]
    if vote >= 0 or not 0 < len(apart) <= min(3, len(a) // 3) or any(re.search(r"\d", a[k] + b[k]) or a[k].isalpha() and b[k].isalpha() and min(len(a[k]), len(b[k])) < 2 for k in apart):
        return vote, vote, []
    granted = verdict([s or k in apart for k, s in enumerate(same)])
    return vote, granted, [" ".join(sorted((a[k], b[k]))) for k in apart] if granted > vote else []


def votes(a, b) -> tuple[tuple[int, ...], int, list[str]]:
    """The votes of all functions on two prepared records, in the order of VOTES, then the title's other vote and its words (see ``vote_title``)."""
    series = 0 if not (a.part and b.part) else 1 if a.part == b.part else -1
    na, nb = list(a.names), list(b.names)
    authors = 0
    if na and nb:
        hit = sum(x in nb or any(_near_name(x, y) for y in nb) for x in na)
        least = min(len(na), len(nb))
        short = a.more or b.more
        authors = 1 if hit >= least and (short or abs(len(na) - len(nb)) <= 1 or least >= 2) else -1 if hit == 0 or (hit < 0.5 * least and not short) else 0
    year = 0 if pd.isna(a.year) or pd.isna(b.year) else 1 if abs(a.year - b.year) <= 1 else -1
    abstract = 0
    if len(a.runs) and len(b.runs):
        c = len(np.intersect1d(a.runs, b.runs, assume_unique=True)) / min(len(a.runs), len(b.runs))
        abstract = 1 if c >= 0.5 else -1 if c < 0.2 else 0
    keywords = 0
    if len(a.kws) and len(b.kws):
        x, y = set(a.kws), set(b.kws)
        j = len(x & y) / min(len(x), len(y))
        keywords = 1 if j >= 0.6 else -1 if j < 0.3 else 0
    title, granted, words = vote_title(list(a.words), list(b.words), a.cut, b.cut)
    return (title, series, authors, year, abstract, keywords), granted, words


class LabelModel:
    """A generative model of votes given a hidden match, with a tree of dependences among the functions.

    P(votes, y) = P(y) * prod P(vote_j | vote_parent(j), y), fitted by expectation
    maximisation on pattern counts. The tree first has no edges; then the pairs that the
    fitted model explains worst (conditional mutual information) become edges and the
    fit is repeated. A weak prior says that functions are better than chance; ``veto``
    bounds how often a match may get the vote -1 from single functions, without which
    the model would find the larger groups of related works.
    """

    def __init__(self, smoothing: float = 1.0, least_information: float = 0.01, rounds: int = 200, veto: dict[int, float] | None = None):
        self.smoothing, self.least_information, self.rounds, self.veto = smoothing, least_information, rounds, veto or {}
        self.parent: list[int | None] = []

    def _tables(self, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> None:
        self.prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 1 - 1e-4))
        self.tables = []
        for j, parent in enumerate(self.parent):
            t = np.full((2, 3, 3), self.smoothing)  # y, parent's vote, vote
            for y, w in ((0, n * (1 - p)), (1, n * p)):
                at = v[:, parent] + 1 if parent is not None else np.zeros(len(v), int)
                np.add.at(t[y], (at, v[:, j] + 1), w)
                t[y, :, 0 if y == 0 else 2] += self.smoothing
            t /= t.sum(axis=2, keepdims=True)
            if j in self.veto:
                t[1, :, 0] = np.minimum(t[1, :, 0], self.veto[j])
                t[1] /= t[1].sum(axis=1, keepdims=True)
            self.tables.append(t)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        for j, parent in enumerate(self.parent):
            at = v[:, parent] + 1 if parent is not None else np.zeros(len(v), int)
            for y in (0, 1):
                logs[:, y] += np.log(self.tables[j][y, at, v[:, j] + 1])
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def _run(self, v: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
        for _ in range(self.rounds):
            self._tables(v, n, p)
            q = self.posterior(v)
            if np.abs(q - p).max() < 1e-7:
                return q
            p = q
        return p

    def fit(self, v: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Posteriors of the patterns ``v`` (rows of -1, 0, 1) with counts ``n``, from the beliefs ``start``."""
        if len(v) == 0:
            return start
        n = n.astype(float)
        self.parent = [None] * v.shape[1]
        p = self._run(v, n, start)
        ties = []
        for i, j in combinations(range(v.shape[1]), 2):
            info = 0.0
            for w in (n * p, n * (1 - p)):
                joint = np.full((3, 3), 1e-9)
                np.add.at(joint, (v[:, i] + 1, v[:, j] + 1), w)
                share = joint.sum() / n.sum()
                joint /= joint.sum()
                info += share * (joint * np.log(joint / joint.sum(1, keepdims=True) / joint.sum(0, keepdims=True))).sum()
            ties.append((info, i, j))
        group = list(range(v.shape[1]))
        for info, i, j in sorted(ties, reverse=True):
            if info >= self.least_information and group[i] != group[j] and self.parent[j] is None:
                self.parent[j] = i
                group = [group[i] if g == group[j] else g for g in group]
        return self._run(v, n, p)


def belief(v: np.ndarray) -> np.ndarray:
    """A first belief from the votes: no to a different title or part, else the balance of the rest."""
    if len(v) == 0:
        return np.zeros(0)
    balance = v.sum(axis=1)
    return np.where((v[:, 0] < 0) | (v[:, 1] < 0), 0.02, np.where(balance >= 2, 0.95, np.where(balance <= 0, 0.1, 0.5)))


def _meet(at: DataFrame) -> DataFrame:
    """(id_a, id_b, same), id_a < id_b, distinct, of records that share a ``block`` and may meet in it, and whether they are of one source.

    ``at``: (id, src, block, seeks, finds). Of two records in a block one has to seek
    what the other finds: 1 anything, 2 only records without a subject; a seeker of 0
    waits to be found.
    """
    x = at.where("seeks > 0").select(F.col("id").alias("x"), F.col("src").alias("p"), "block", "seeks")
    y = at.select(F.col("id").alias("y"), F.col("src").alias("q"), "block", "finds", (F.col("seeks") == 1).alias("too"))
    met = x.join(y.hint("merge"), "block").where("x <> y and (seeks = 1 or finds = 2) and not (seeks = 1 and too and x > y)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), (F.col("p") == F.col("q")).alias("same")).distinct()


def _rare_words(ready: DataFrame) -> DataFrame:
    """(id, block) for every two of the RARE rarest words of a title."""
    words = ready.select("id", F.explode(F.array_distinct("words")).alias("w"))
    df = words.groupBy("w").agg(F.count("*").alias("df"))
    rare = words.join(df.hint("merge"), "w").groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("df", "w"))), 1, RARE).alias("r"))
    w = F.sort_array(F.transform("r", lambda x: x["w"]))
    two = F.flatten(F.transform("w", lambda x, i: F.transform(F.slice(F.col("w"), i + 2, RARE), lambda y: F.concat_ws(" ", x, y))))
    return rare.select("id", w.alias("w")).select("id", F.explode(two).alias("block"))


def _swaps(voted: DataFrame) -> list[str]:
    """Pairs of words that stand for each other: titles of two sources differ in nothing else, titles of one source, which seldom writes one work in two ways, hardly ever do."""
    alone = voted.where((F.size("swaps") > 0) & (F.col("granted") > 0)).select(F.array_join(F.sort_array("swaps"), "|").alias("s"), "same", F.col("votes")[2].alias("authors"), F.col("votes")[4].alias("abstract"))
    alike = ~F.col("same") & (F.col("authors") == 1) & (F.col("abstract") == 1)
    n = alone.groupBy("s").agg(F.count_if(alike).alias("n"), F.count_if("same").alias("m"))
    return [r["s"] for r in n.where(F.col("n") >= LEAST_SWAPS * (F.col("m") + 1)).orderBy(F.desc("n"), "s").limit(SWAPS).collect()]


def _granted(swaps: list[str]):
    """A function of arrays of pairs of words: whether each is one of ``swaps``, up to misspellings."""

    @F.pandas_udf("boolean")
    def run(words: pd.Series) -> pd.Series:
        known = set(swaps)
        heads: dict[str, list[list[str]]] = {}
        for s in {x for s in swaps for x in s.split("|")}:
            x, y = s.split(" ")
            heads.setdefault(x[0], []).append([x, y])
            heads.setdefault(y[0], []).append([y, x])

        @lru_cache(maxsize=100_000)
        def one(s: str) -> bool:
            x, y = s.split(" ")
            return s in known or any(_near_word(x, u) and _near_word(y, v) for u, v in heads.get(x[0], []))

        return words.map(lambda ws: all(map(one, ws)))

    return run


def link(records: DataFrame, *, key: str = "paper_id", source: str = "source", year: str = "year") -> DataFrame:
    """(key_a, key_b, votes, confidence), key_a < key_b, of all candidates from different sources.

    ``records`` has one row per key, with title, abstract, authors and keywords. Rows
    with a null key or source meet nothing; nulls elsewhere make a function abstain.
    Records without authors meet others by the subject and either end of the title, or,
    where one has no subject, by any two of the title's RARE rarest words. An empty table gives
    an empty result. Other columns are not read.
    """
    spark = records.sparkSession
    base = records.select(F.col(key).cast("string").alias("id"), F.col(source).alias("src"), F.col(year).cast("double").alias("year"), "title", "abstract", "authors", "keywords").where("id is not null and src is not null")

    def prep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = pd.DataFrame([prepare(*x) for x in zip(b.title, b.abstract, b.authors, b.keywords)], index=b.index, columns=["words", "part", "cut", "names", "more", "runs", "kws", "blocks", "ends", "loose", "bare", "nameless", "lost"])
            yield pd.concat([b[["id", "src", "year"]], done], axis=1)

    ready = cut(base.mapInPandas(prep, "id string, src string, year double, words array<string>, part int, cut boolean, names array<string>, more boolean, runs array<long>, kws array<string>, blocks array<string>, ends array<string>, loose array<string>, bare boolean, nameless boolean, lost boolean"))
    # The facts of a record are wide and move once for its candidates; blocks are made from the narrow rest.
    keys = cut(ready.select("id", "src", "bare", "nameless", "lost", "blocks", "ends", "loose", "words"))
    role = lambda seeks, kind: keys.select("id", "src", F.explode(kind).alias("block"), F.when(F.expr(seeks), 1).otherwise(0).alias("seeks"), F.lit(1).alias("finds"))
    # A subject that fills a third of the rows is split by names; the other blocks serve records that lack a name or a subject.
    rare = _rare_words(keys).join(keys.select("id", "src", "nameless", "lost").hint("merge"), "id").select("id", "src", "block", F.expr("case when nameless and lost then 1 when nameless then 2 else 0 end").alias("seeks"), F.expr("if(lost, 2, 1)").alias("finds"))
    met = _meet(reduce(DataFrame.unionByName, [role("true", "blocks"), role("nameless", "ends"), role("bare", "loose"), rare]))
    facts = ["year", "words", "part", "cut", "names", "more", "runs", "kws"]
    side = lambda s: ready.select(F.col("id").alias(f"id_{s}"), F.struct(*facts).alias(s))
    both = met.join(side("a").hint("merge"), "id_a").join(side("b").hint("merge"), "id_b")

    def ballot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            a, c = ([SimpleNamespace(**(x if isinstance(x, dict) else x.asDict())) for x in b[s]] for s in ("a", "b"))
            done = [votes(p, q) for p, q in zip(a, c)]
            yield pd.DataFrame({"id_a": b.id_a, "id_b": b.id_b, "same": b.same, "votes": [list(d[0]) for d in done], "granted": [d[1] for d in done], "swaps": [d[2] for d in done], "title_a": ["".join(p.words) for p in a], "title_b": ["".join(p.words) for p in c]})

    voted = cut(both.mapInPandas(ballot, "id_a string, id_b string, same boolean, votes array<int>, granted int, swaps array<string>, title_a string, title_b string"))
    if swaps := _swaps(voted):
        title = F.when((F.size("swaps") > 0) & _granted(swaps)("swaps"), F.col("granted")).otherwise(F.col("votes")[0])
    else:
        title = F.col("votes")[0]
    # A title without a subject speaks for one work unless a source gives it to several records.
    many = ready.groupBy(F.concat_ws("", "words").alias("t"), "src").agg(F.count("*").alias("n")).where("n > 1").select("t").distinct()
    plain_pairs = voted.withColumn("title", title).join(many.select(F.col("t").alias("title_a"), F.lit(True).alias("_a")).hint("merge"), "title_a", "left").join(many.select(F.col("t").alias("title_b"), F.lit(True).alias("_b")).hint("merge"), "title_b", "left")
    title = F.when(F.col("title") < 2, F.col("title")).when(F.col("_a").isNull() & F.col("_b").isNull(), 1).otherwise(0)
    voted = cut(plain_pairs.where("not same").select("id_a", "id_b", F.concat(F.array(title), F.slice("votes", 2, len(VOTES))).alias("votes")))
    # At most 3 ** 6 patterns, however many candidates.
    patterns = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()
    v = np.array([r["votes"] for r in patterns], dtype=int).reshape(-1, len(VOTES))
    p = LabelModel(veto=VETO).fit(v, np.array([r["n"] for r in patterns], dtype=float), belief(v))
    scored = spark.createDataFrame([(list(map(int, r)), float(q)) for r, q in zip(v, p)], "votes array<int>, confidence double")
    return voted.join(F.broadcast(scored), "votes").select(F.col("id_a").alias(f"{key}_a"), F.col("id_b").alias(f"{key}_b"), "votes", "confidence")
