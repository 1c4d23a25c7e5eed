import unicodedata
from collections import Counter

import pytest

from quillon.llm.lookalike import Rewriter, UnionFind, normalize_looks, representatives, same_looking_pairs

BASE = "A naïve fine test of Ω at 25 °C, H₂O x² Straße; office - end"
SAME = [
    BASE.replace("fine", "ﬁne"), BASE.replace("ï", "ï"), BASE.replace(" ", " "), BASE.replace("°C", "℃"), BASE.replace("A", "А").replace("e", "е"), BASE.replace("test", "te­st"), BASE.replace("25", "２５"), BASE.replace("Ω", "Ω"), BASE.replace("office", "oﬃce"), BASE.replace("a", "​a"), BASE.replace("test", "ｔｅѕｔ"), BASE.replace("- ", "‐ "),
]
OTHER = [BASE.replace("naïve", "naive"), BASE.replace("x²", "x2"), BASE.replace("H₂O", "H2O"), BASE.lower(), BASE.replace(";", ","), BASE.replace(" end", "\nend"), BASE.replace("ß", "ss"), BASE.replace("-", "–")]


def rewriter(texts):
    return Rewriter(representatives(Counter("".join(t for t in texts if t))))


def test_same_and_other():
    r = rewriter([BASE, *SAME, *OTHER])
    assert {r(t) for t in SAME} == {r(BASE)}
    assert len({r(t) for t in [BASE, *OTHER]}) == len(OTHER) + 1


def test_transitive_classes():
    u = UnionFind()
    for a, b in (("A", "Α"), ("Α", "А"), ("x", "х")):
        u.join(a, b)
    assert sorted(map(len, u.classes())) == [2, 3]


def test_most_frequent_represents():
    r = rewriter(["ааааа рора a"])
    assert r("a") == "а"


def test_normal_form_is_stable():
    r = rewriter([BASE, *SAME])
    for t in [BASE, *SAME]:
        assert r(r(t)) == r(t) and unicodedata.is_normalized("NFC", r(t))


def test_pairs(spark):
    texts = [BASE, SAME[0], BASE, OTHER[0], None, "", " ", "​", " ", "z" * 40000, "ｚ" + "z" * 39999]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, BASE), (None, SAME[1])], "doc_id long, text string").selectExpr("*", "'c' as look", "'c' as own", "'c' as _n", "1 as _k")
    got = {(r.doc_id_a, r.doc_id_b) for r in same_looking_pairs(df).collect()}
    assert got == {(0, 1), (1, 2), (9, 10)}
    assert same_looking_pairs(df.limit(0)).count() == 0


def test_column_is_replaced_and_null_stays(spark):
    df = spark.createDataFrame([(1, "ﬁne", "old"), (2, None, "old")], "doc_id long, text string, looks string")
    assert [r.looks for r in normalize_looks(df).orderBy("doc_id").collect()] == ["fine", None]


@pytest.mark.parametrize("text", ["", "plain"])
def test_plain_text_is_kept(text):
    assert rewriter(["plain"])(text) == text
