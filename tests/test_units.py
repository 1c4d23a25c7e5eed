import math

import pytest

from quillon.functions import units
from quillon.functions.names import NameIndex, edits, frames, readings


def test_cycles_are_consistent():
    assert units.cycle_error() < 1e-12


def test_shortest_compositions():
    f, o = units.conversions("degF")["K"]
    assert math.isclose(212 * f + o, 373.15)
    f, _ = units.conversions("kcal/mol")["eV"]
    assert math.isclose(f, 4.184 / 96.48533212331)
    assert "K" not in units.conversions("eV")


@pytest.mark.parametrize(
    "written, target, factor",
    [("W m⁻¹ K⁻¹", "W/mK", 1), ("W/(cm·K)", "W/mK", 100), ("µC cm-2", "µC/cm²", 1), ("C m-2", "µC/cm²", 100), ("mpa", "GPa", 1e-3), ("MPA", "MPa", 1), ("A", "nm", 0.1), ("1/K", "ppm/K", 1e6), ("mils per year", "mm/year", 0.0254), ("kA/m", "Oe", 4 * math.pi), ("mT", "Oe", 10), ("MA/cm2", "kA/cm²", 1e3), ("ma/cm2", "mA/cm²", 1), ("Ohm-cm", "Ω·cm", 1), ("milli-eV", "eV", 1e-3), ("S cm^{-1}", "S/cm", 1), ("g/cc", "g/cm³", 1), ("C/g", "mAh/g", 1 / 3.6), ("per mille", "%", 0.1)],
)
def test_spellings(written, target, factor):
    rows = {s: f for s, t, f, _ in units.conversion_rows([target])}
    assert math.isclose(rows[units.fold(written)], factor)


def test_unit_of_another_kind_has_no_row():
    rows = {s for s, t, f, _ in units.conversion_rows(["K"])}
    assert units.fold("eV") not in rows and units.fold("a.u.") not in rows


def test_column_and_python_fold_alike(spark):
    from pyspark.sql import functions as F

    words = ["W m⁻¹ K⁻¹", "µC/cm²", "μm", "º C", "℃", "Ω·cm", "Å", "mm per year", "S cm^{-1}", "", "kJ/(kg·K)"]
    got = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", units.unit_key(F.col("w")).alias("k")).orderBy("i").collect()
    assert [r.k for r in got] == [units.fold(w) for w in words]


def test_edits_count_a_swap_once():
    assert edits("abcd", "abdc", 3) == 1
    assert edits("optilcgap", "opticalgap", 3) == 2
    assert edits("abc", "xyz", 2) == 3


NAMES = NameIndex([("band_gap", "band_gap"), ("band_gap", "energy gap"), ("hardness", "hardness"), ("hardness", "Vickers hardness"), ("figure_of_merit", "ZT"), ("thermal_conductivity", "thermal conductivity"), ("half-Heusler", "half-Heusler"), ("energy_density", "energy density")])


@pytest.mark.parametrize(
    "value, entry",
    [("Band Gap", "band_gap"), ("bandgap", "band_gap"), ("the band gap (300 K)", "band_gap"), ("gap, energy", "band_gap"), ("Vickrs hardness", "hardness"), ("hardness / GPa", "hardness"), ("hardness_in_GPa", "hardness"), ("therm. cond.", "thermal_conductivity"), ("zt *", "figure_of_merit"), ("half-H.", "half-Heusler"), ("surface energy", None), ("n/a", None), ("", None), ("X-115", None), ("harndess, see note 3", "hardness")],
)
def test_names(value, entry):
    assert NAMES.resolve(value) == entry


def test_frames_go_one_by_one():
    assert frames("the hardness phase.")[-1] == "hardness"
    assert readings("Hardness [GPa]")[-1] == "hardness"
