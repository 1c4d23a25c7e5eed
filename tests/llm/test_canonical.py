import pytest

from quillon.llm.canonical import Mentions, forms_of, map_to_canonical

FORMS = [("perovskite", "perovskite"), ("perovskite", "ABO3 type"), ("layered perovskite", "layered perovskite"), ("half-Heusler", "half-Heusler"), ("glass_transition", "glass_transition"), ("glass_transition", "glass transition temperature"), ("hardness", "hardness"), ("hardness", "Vickers hardness")]
M = Mentions(FORMS)


@pytest.mark.parametrize(
    "value, entry",
    [("the perovskite phase", "perovskite"), ("layered perovskite (room temp.)", "layered perovskite"), ("layyered perovskite", "layered perovskite"), ("ABO3 type crystal structure", "perovskite"), ("Perovskitte", "perovskite"), ("half heusler", "half-Heusler"), ("Glass Transition Temperature [K]", "glass_transition"), ("temperature, glass transition", "glass_transition"), ("hardness, measured", "hardness"), ("powder", "UNMATCHED"), ("#37", "UNMATCHED"), ("...", "UNMATCHED"), ("x" * 30000, "UNMATCHED")],
)
def test_entry(value, entry):
    assert M.entry(value) == entry


def test_longest_mention_wins():
    assert M.found("a layered perovskite film")[0] == {"layered perovskite"}


def test_map(spark):
    rows = [(1, "perovskite", "Hardnes"), (2, "Perovskite", None), (2, "Perovskite", None), (3, "", "  "), (4, "powder", "hardness"), (None, "Perovskite", "x"), (5, None, "Vickers hardness")]
    df = spark.createDataFrame(rows, "id long, structure string, property string").selectExpr("*", "'clash' as field", "'clash' as value", "'clash' as entry", "1 as _k")
    lists = {"structure": FORMS[:4], "property": FORMS[4:]}
    got = {(r.id, r.field, r.entry) for r in map_to_canonical(df, "id", lists).collect()}
    assert got == {(1, "property", "hardness"), (2, "structure", "perovskite"), (4, "structure", "UNMATCHED"), (5, "property", "hardness")}
    assert map_to_canonical(df.limit(0), "id", lists).count() == 0
    assert {r.entry for r in map_to_canonical(df, "id", {"structure": []}).collect()} == {"UNMATCHED"}


def test_forms(spark):
    terms = spark.createDataFrame([("b", "B label", ["x", None]), ("a", None, None), (None, "z", ["q"])], "name string, label string, aliases array<string>")
    assert set(forms_of(terms, "name", "label", "aliases")) == {("a", "a"), ("b", "b"), ("b", "B label"), ("b", "x")}
