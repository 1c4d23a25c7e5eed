"""Free-entered names against a reference list: cleaning and string similarity.

Pure Python over one value; ``resolve_names`` runs it once per distinct value that
is not an entry already.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

# Words around a name that say how it was measured or what kind of name it is.
BEFORE = ("the", "a", "an", "max", "min", "avg", "mean", "average", "maximum", "minimum", "measured", "calculated", "estimated", "approx", "approximate", "room temperature", "room temp", "rt", "peak", "total", "reported", "typical")
AFTER = ("measured", "calculated", "estimated", "crystal structure", "structure type", "structure", "str", "struct", "lattice", "phase", "type", "like", "room temp", "room temperature", "rt", "value", "values")
UNMATCHED = "UNMATCHED"

_NOTE = re.compile(r"[(\[]\s*(?:n\s*=\s*\d+|\d[^)\]]*|room temp[^)\]]*|rt)\s*[)\]]|,?\s*see (?:note|table|fig\w*\.?|ref\.?)\s*\d*\s*$", re.I)
_UNIT_TAIL = re.compile(r"^(?P<name>.*?\w\S*?)(?:\s+/\s+(?P<a>\S.*)|\s*\[(?P<b>[^\]]+)\]|\s*\((?P<c>(?:[^()]|\([^()]*\))+)\)|,\s+(?P<d>\S.*)|[_\s]in[_\s](?P<e>\S.*))\s*$")


def simplify(text: str) -> str:
    """Lower case, compatibility forms, one blank for blanks, underscores and dashes; apostrophes go."""
    t = unicodedata.normalize("NFKC", text).lower()
    t = re.sub(r"['’`´]", "", t)
    t = re.sub(r"[_‐‑–—\-]+", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def frames(text: str) -> list[str]:
    """``text`` (simplified) and what is left of it as notes, edge punctuation and framing words go one by one."""
    out = [text]
    t = _NOTE.sub(" ", text)
    while True:
        t = t.strip(" *:;?!,·=")
        out.append(t)
        tail = next((x for w in AFTER for x in (" " + w, "," + w, f" {w}.") if t.endswith(x) and len(t) > len(x) + 1), None)
        lead = next((x for w in BEFORE for x in (w + " ", w + ". ") if t.startswith(x) and len(t) > len(x) + 1), None)
        if tail:
            t = t[: -len(tail)]
        elif lead:
            t = t[len(lead) :]
        if t == out[-1]:
            return list(dict.fromkeys(out))


def compact(text: str) -> str:
    return re.sub(r"[\W_]+", "", text)


def edits(a: str, b: str, most: int) -> int:
    """Damerau's distance from ``a`` to ``b`` (neighbours that change places count once, also with edits between them); ``most + 1`` if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    seen: dict[str, int] = {}
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, last = [far, i], 0
        for j, y in enumerate(b, 1):
            k = seen.get(y, 0)
            swap = rows[k][last] + (i - k - 1) + 1 + (j - last - 1) if k and last else far
            row.append(min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, swap))
            if x == y:
                last = j
        seen[x] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def allowed(length: int) -> int:
    """Edits that a name of ``length`` letters may have."""
    return 0 if length < 4 else 1 if length < 6 else 2 if length < 12 else 3


class NameIndex:
    """Surface forms of reference entries, ready for similarity look-ups.

    ``forms``: (entry, surface form). Two entries that share a form keep the first.
    """

    def __init__(self, forms: Iterable[tuple[str, str]]):
        self.exact: dict[str, str] = {}
        self.forms: list[tuple[str, str, list[str], dict[str, int]]] = []
        for entry, form in forms:
            if not form or not form.strip():
                continue
            c = compact(simplify(form))
            if c and c not in self.exact:
                self.exact[c] = entry
                self.forms.append((entry, c, [compact(w) for w in simplify(form).split(" ") if compact(w)], self._bag(c)))
        self.by_sorted: dict[str, str] = {}
        for entry, c, tokens, _ in self.forms:
            self.by_sorted.setdefault(" ".join(sorted(tokens)), entry)

    @staticmethod
    def _bag(text: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for x in text:
            out[x] = out.get(x, 0) + 1
        return out

    def near(self, c: str) -> tuple[int, str] | None:
        """The entry with the fewest edits from the compact string ``c``; None if none is near or two are equally near."""
        bag, best = self._bag(c), None
        tied = False
        for entry, form, _, other in self.forms:
            limit = allowed(max(len(form), len(c)))
            if limit == 0 or abs(len(form) - len(c)) > limit:
                continue
            if sum(abs(n - other.get(x, 0)) for x, n in bag.items()) + sum(n for x, n in other.items() if x not in bag) > 2 * limit:
                continue
            d = edits(c, form, limit)
            if d <= limit and (best is None or d < best[0]):
                best, tied = (d, entry), False
            elif d <= limit and best and d == best[0] and entry != best[1]:
                tied = True
        return None if tied else best

    def by_tokens(self, words: list[str]) -> str | None:
        """Token-set similarity: each word equals, abbreviates (with a dot) or nearly equals its own token of the form."""
        best: tuple[float, str] | None = None
        tied = False
        for entry, _, tokens, _ in self.forms:
            if len(tokens) != len(words):
                continue
            left, cost = list(tokens), 0.0
            for w in sorted(words, key=len, reverse=True):
                dotted, c = w.endswith("."), compact(w)
                options = []
                for k, t in enumerate(left):
                    if c == t:
                        options.append((0.0, k))
                    elif dotted and len(c) >= 3 and t.startswith(c):
                        options.append((0.3 + 0.01 * (len(t) - len(c)), k))
                    elif (m := min(allowed(len(c)), allowed(len(t)), 2)) and (d := edits(c, t, m)) <= m:
                        options.append((float(d), k))
                if not options:
                    cost = -1
                    break
                x, k = min(options)
                cost += x
                left.pop(k)
            if cost < 0 or cost > allowed(sum(map(len, tokens))):
                continue
            if best is None or cost < best[0] - 1e-9:
                best, tied = (cost, entry), False
            elif abs(cost - best[0]) <= 1e-9 and entry != best[1]:
                tied = True
        return None if best is None or tied else best[1]

    def similar(self, text: str) -> str | None:
        """The entry meant by the cleaned ``text``, by whole-string edits, then by token sets; None if none is."""
        c = compact(text)
        if not c:
            return None
        if c in self.exact:
            return self.exact[c]
        words = [w for w in re.split(r"[\s,;/()\[\]]+", text) if compact(w)]
        if (entry := self.by_sorted.get(" ".join(sorted(compact(w) for w in words)))) is not None:
            return entry
        if text.endswith(".") and len(c) >= 4:
            heads = {e for e, form, _, _ in self.forms if form.startswith(c)}
            if len(heads) == 1:
                return heads.pop()
        if (hit := self.near(c)) is not None:
            return hit[1]
        return self.by_tokens(words)

    def resolve(self, value: str) -> str | None:
        """The entry meant by a value as entered: whole, without its frame, without a unit at its end."""
        for text in readings(value):
            if (entry := self.similar(text)) is not None:
                return entry
        return None


def readings(value: str) -> list[str]:
    """Cleaned readings of ``value``, the fullest first: as it is, ever less framed, without a trailing unit."""
    out = frames(simplify(value))
    raw = re.sub(r"\s+", " ", unicodedata.normalize("NFC", value)).strip()
    if (m := _UNIT_TAIL.match(raw)) and m["name"].strip():
        out += frames(simplify(m["name"]))
    return [x for x in dict.fromkeys(out) if x]
