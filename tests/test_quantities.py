from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillon.operators.quantities import _plain, common_units, read_number

TERMS = "property_name string, label string, aliases array<string>, common_unit string, decimals int"
ROW = "triple_id long, property_name string, property_value double, property_unit string, value_str string, loaded_at timestamp, _unit string, common string"


@pytest.fixture(scope="module")
def terms(spark):
    return spark.createDataFrame([("band_gap", "band gap", ["energy gap"], "eV", 3), ("melting_point", "melting point", [], "K", 2), ("diffusion", "diffusion coefficient", [], "µm²/s", 2), ("figure_of_merit", "figure of merit", [], "", 3)], TERMS)


def run(spark, terms, rows):
    t0 = datetime(2024, 1, 1)
    full = [(i, *r, t0, "clash", "clash") for i, r in enumerate(rows)]
    return {r.triple_id: r for r in common_units(spark.createDataFrame(full, ROW), terms).collect()}


@pytest.mark.parametrize("text, number", [("1,304.5 K", 1304.5), ("0,304 eV", 304.0), ("12,3", 12.3), ("1,0005", 1.0005), ("10,300,000 cm²/g", 10300000.0), ("≈ −15.2 °C", -15.2), ("2.5 × 10^-3 eV", 0.0025), ("2·10⁻⁶ mm²/s", 2e-6), ("1.5e3 K", 1500.0), ("n.d.", None), ("", None), (None, None), ("21.1 ± 0.4", 21.1)])
def test_read_number(spark, text, number):
    got = spark.createDataFrame([(text,)], "t string").select(read_number(_plain(F.col("t")))).first()[0]
    assert got == number or got == pytest.approx(number, rel=1e-12)


def test_cases(spark, terms):
    r = run(spark, terms, [
        ("band_gap", 500.0, "meV", None), ("Energy gap", 1.2, "K", "1200 meV"), ("band gap [meV]", 700.0, "", "700"), ("band_gap", 3.0, "eV", "3 eV"), ("melting_point", 100.0, "K", "100 °C ± 2"),
        ("melting_point", 100.0, "a.u.", None), ("melting_point", 100.0, "eV", "100 eV"), ("melting_point", None, "K", "n.d."), ("melting_point", 100.0, None, None), ("melting_point", 5.0, "10^2 K", None),
        ("diffusion", 1.0, "cm2/s", "2.83·10^-6 mm2/s"), ("price", 3.0, "eV", None), (None, 3.0, "eV", None), ("figure_of_merit", 1.0, "", None), ("melting_point", 7.0, "?", "7 ?"), ("band_gap", float("nan"), "eV", None),
    ])
    assert {k: v.common_scaled for k, v in r.items()} == {0: 500, 1: 1200, 2: 700, 3: 3000, 4: 37315, 9: 50000, 10: 283}
    assert {k for k, v in r.items() if v.converted} == {0, 1, 2, 4, 9, 10}


def test_repeated_rows_count_once_and_the_first_version_holds(spark, terms):
    rows = [(1, "band_gap", 1.0, "meV", None, datetime(2024, 1, 2), "", ""), (1, "band_gap", 2.0, "meV", None, datetime(2024, 1, 1), "", ""), (1, "band_gap", 3.0, "meV", None, None, "", "")]
    got = common_units(spark.createDataFrame(rows, ROW), terms).collect()
    assert len(got) == 1 and got[0].common == pytest.approx(0.002)


def test_empty_tables(spark, terms):
    none = spark.createDataFrame([], ROW)
    assert common_units(none, terms).count() == 0
    assert common_units(none, spark.createDataFrame([], TERMS)).count() == 0


def test_very_long_values(spark, terms):
    r = run(spark, terms, [("band gap " + "x" * 20000, 1.0, "meV", "1 " + "y" * 50000), ("band_gap", 2.0, "meV", "2 meV " + " " * 50000)])
    assert set(r) == {1}
