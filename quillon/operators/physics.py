"""Plausibility of compositions, structures and properties: bounds in reference units, phases, joint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import units
from quillon.functions.chemistry import known_principle, stoichiometry_violation
from quillon.functions.settle import settle

# Plausible bounds of properties and the unit that they are given in.
BOUNDS = {
    "bandgap": (0.0, 12.0, "eV"), "conductivity": (1e-10, 1e8, "S/cm"), "resistivity": (1e-12, 1e12, "Ω·cm"), "mobility": (0.0, 1e6, "cm²/Vs"), "work_function": (1.0, 8.0, "eV"), "tc": (0.0, 2000.0, "K"), "tn": (0.0, 2000.0, "K"),
    "magnetization": (0.0, 300.0, "emu/g"), "coercivity": (0.0, 1e6, "Oe"), "dielectric_constant": (1.0, 1e5, ""), "dielectric_loss": (0.0, 10.0, ""), "piezoelectric_coeff": (0.0, 2000.0, "pC/N"), "spontaneous_polarization": (0.0, 200.0, "μC/cm²"),
    "remanent_polarization": (0.0, 150.0, "μC/cm²"), "seebeck": (-1000.0, 1000.0, "μV/K"), "zt": (0.0, 10.0, ""), "power_factor": (0.0, 1e5, "μW/mK²"), "superconducting_tc": (0.0, 300.0, "K"), "critical_field": (0.0, 200.0, "T"),
    "youngs_modulus": (0.001, 1500.0, "GPa"), "bulk_modulus": (0.001, 2000.0, "GPa"), "shear_modulus": (0.001, 1000.0, "GPa"), "hardness": (0.001, 120.0, "GPa"), "yield_strength": (1.0, 5000.0, "MPa"), "tensile_strength": (1.0, 8000.0, "MPa"),
    "compressive_strength": (0.1, 5000.0, "MPa"), "flexural_strength": (1.0, 3000.0, "MPa"), "fracture_toughness": (0.1, 200.0, "MPa·m"), "fatigue_strength": (1.0, 2000.0, "MPa"), "elongation": (0.0, 1000.0, "%"), "poisson_ratio": (-1.0, 0.5, ""),
    "density": (0.001, 25.0, "g/cm³"), "thermal_conductivity": (0.0, 5000.0, "W/mK"), "specific_heat": (0.0, 2000.0, "J/molK"), "thermal_expansion": (-50.0, 500.0, "ppm/K"), "debye_temp": (0.0, 2000.0, "K"), "melting_point": (0.0, 5000.0, "K"),
    "glass_transition": (0.0, 1500.0, "K"), "formation_energy": (-10.0, 5.0, "eV/atom"), "cohesive_energy": (-20.0, 0.0, "eV/atom"), "activation_energy": (0.0, 10.0, "eV"), "corrosion_rate": (0.0, 100.0, "mm/year"), "specific_capacity": (0.0, 5000.0, "mAh/g"),
    "voltage": (0.0, 5.0, "V"), "energy_density": (0.0, 10000.0, "Wh/kg"), "power_density": (0.0, 1e6, "W/kg"), "coulombic_efficiency": (0.0, 100.0, "%"), "overpotential": (-3.0, 3.0, "V"), "tafel_slope": (0.0, 1000.0, "mV/dec"),
    "faradaic_efficiency": (0.0, 100.0, "%"), "refractive_index": (1.0, 5.0, ""), "plqy": (0.0, 100.0, "%"), "emission_wavelength": (200.0, 5000.0, "nm"), "pce": (0.0, 50.0, "%"), "jsc": (0.0, 100.0, "mA/cm²"), "voc": (0.0, 5.0, "V"),
    "breakdown_strength": (0.0, 2000.0, "kV/mm"), "contact_angle": (0.0, 180.0, "°"), "friction_coeff": (0.0, 2.0, ""), "hydrogen_capacity": (0.0, 25.0, "wt%"),
}
# Names of the project's reference table for some of these, and bounds of its further properties.
ALSO = {"band_gap": "bandgap", "mass_density": "density", "curie_temperature": "tc", "seebeck_coefficient": "seebeck", "melting_temperature": "melting_point", "glass_transition_temperature": "glass_transition", "carrier_mobility": "mobility", "electrical_conductivity": "conductivity", "electrical_resistivity": "resistivity", "coercive_field": "coercivity", "debye_temperature": "debye_temp", "neel_temperature": "tn", "thermal_expansion_coefficient": "thermal_expansion"}
# Phases of a composition in which a property is absent, and structures that do not describe it.
PHASES = {("YBa2Cu3O7", "tetragonal"): ("tc", "superconducting"), ("YBCO", "tetragonal"): ("tc", "superconducting")}
KNOWN_PHASES = {"YBa2Cu3O7": ("orthorhombic", "tetragonal", "perovskite"), "YBCO": ("orthorhombic", "tetragonal")}
LOOSE = {"YBa2Cu3O7": "layered oxygen-deficient derivative of perovskite"}


def bounds() -> dict[str, tuple[float, float, str]]:
    return BOUNDS | {name: BOUNDS[of] for name, of in ALSO.items()}


def check_ranges(df: DataFrame, prop: str, value: str, unit: str) -> DataFrame:
    """``df`` with low_bound, high_bound, reference_unit, in_range and range_problem.

    The value is converted to the unit of the bounds; a value without a unit counts as
    given in it. range_problem: 'unit' where the unit does not measure the property (or
    is unknown), 'range' where the value is out of bounds, else null. Properties without
    bounds, and null values, have no reference_unit or problem and are in range. Bounds
    and spellings of units are of fixed size and broadcast.
    """
    spark = df.sparkSession
    table = bounds()
    limits = F.broadcast(spark.createDataFrame([(k, *v) for k, v in table.items()], f"`{prop}` string, low_bound double, high_bound double, reference_unit string"))
    known = F.broadcast(spark.createDataFrame(units.conversion_rows(sorted({u for _, _, u in table.values() if u})), "_u string, reference_unit string, _factor double, _offset double"))
    given = F.trim(F.coalesce(F.col(unit), F.lit("")))
    j = df.join(limits, prop, "left").withColumn("_u", units.unit_key(given)).join(known, ["_u", "reference_unit"], "left")
    same = (given == "") | (F.col("reference_unit") == "") | (given == F.col("reference_unit"))
    v = F.when(same, F.col(value)).otherwise(F.col(value) * F.col("_factor") + F.col("_offset"))
    problem = F.when(F.col("reference_unit").isNull() | F.col(value).isNull(), None).when(~same & F.col("_factor").isNull(), "unit").when((v < F.col("low_bound")) | (v > F.col("high_bound")), "range")
    return j.withColumn("range_problem", problem).withColumn("in_range", F.col("range_problem").isNull()).drop("_u", "_factor", "_offset")


def phase_violation(composition: Column, structure: Column, prop: Column) -> Column:
    """'property_absent_in_phase', 'loose_structure' or null, for the compositions whose phases are known."""
    c = F.trim(composition)
    out = F.lit(None).cast("string")
    for (comp, s), absent in PHASES.items():
        out = F.when((c == comp) & (structure == s) & prop.isin(*absent), "property_absent_in_phase").otherwise(out)
    for comp in LOOSE:
        out = F.when((c == comp) & ~F.coalesce(structure, F.lit("")).isin(*KNOWN_PHASES[comp]), "loose_structure").otherwise(out)
    return out


def joint_check(df: DataFrame, *, composition: str = "composition", structure: str = "structure", prop: str = "property_name", value: str = "property_value", unit: str = "property_unit") -> DataFrame:
    """``df`` with in_range, range_problem and csp_violations: elements against structure, then bounds, of each triple."""
    j = check_ranges(df, prop, value, unit)
    found = F.array(stoichiometry_violation(F.col(composition), F.col(structure)), F.when(F.col("range_problem") == "unit", "incompatible_unit").when(F.col("range_problem") == "range", "out_of_range"))
    return settle(j, {"csp_violations": F.filter(found, lambda x: x.isNotNull())})


def validate(df: DataFrame) -> DataFrame:
    """``df`` with physical_violations, known_principle, range_problem and severity ('reject', 'warning', 'pass').

    Read: composition_a, composition_b, structure_a, structure_b, property_name,
    predicted_value, predicted_unit; nulls are passed over.
    """
    j = check_ranges(df, "property_name", "predicted_value", "predicted_unit")
    p = F.col("property_name")
    found = [stoichiometry_violation(F.col(f"composition_{s}"), F.col(f"structure_{s}")) for s in "ab"] + [phase_violation(F.col(f"composition_{s}"), F.col(f"structure_{s}"), p) for s in "ab"]
    found.append(F.when(F.col("range_problem") == "unit", "incompatible_unit").when(F.col("range_problem") == "range", "out_of_range"))
    j = settle(j, {"physical_violations": F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())), "known_principle": known_principle(F.col("structure_a"), p) | known_principle(F.col("structure_b"), p)})
    return j.withColumn("severity", F.when(F.size("physical_violations") > 0, "reject").when(F.col("known_principle"), "warning").otherwise("pass"))


def profile(values: DataFrame, key: str, rules: list[tuple[str, str, float]]) -> DataFrame:
    """(key, meets, missing): whether all values of a key keep to the ``rules`` (property, 'max' or 'min', limit); ``missing`` counts rules without a value.

    ``values``: key, property_name, value. A property without a value breaks no rule.
    """
    of = lambda p: F.when(F.col("property_name") == p, F.col("value"))
    worst = values.groupBy(key).agg(*[(F.max if how == "max" else F.min)(of(p)).alias(f"_{i}") for i, (p, how, _) in enumerate(rules)])
    ok, gone = F.lit(True), F.lit(0)
    for i, (_, how, limit) in enumerate(rules):
        c = F.col(f"_{i}")
        ok = ok & F.coalesce(c <= limit if how == "max" else c >= limit, F.lit(True))
        gone = gone + c.isNull().cast("int")
    return worst.select(key, ok.alias("meets"), gone.alias("missing"))
