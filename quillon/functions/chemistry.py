"""Formulas, structures and properties in text; checks of crystal chemistry. All as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import literal

# Symbols of the elements, by period.
ELEMENTS = tuple("""H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn
Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No
Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og""".split())
# Least and most elements of a structure type.
STOICHIOMETRY = {
    "diamond": (1, 1), "graphite": (1, 1), "rocksalt": (2, 2), "zincblende": (2, 2), "wurtzite": (2, 2), "rutile": (2, 2), "fluorite": (2, 2), "perovskite": (2, 4), "spinel": (2, 3), "garnet": (3, 4), "ilmenite": (3, 3), "scheelite": (2, 3), "pyrochlore": (3, 3),
}
# Structure and property whose relation is common knowledge; any of LAYERED is known of layered structures.
PRINCIPLES = {("layered", "thermal_conductivity"), ("layered", "conductivity"), ("perovskite", "dielectric_constant"), ("perovskite", "tc"), ("amorphous", "thermal_conductivity"), ("hexagonal", "bandgap")}
LAYERED = ("thermal_conductivity", "conductivity", "seebeck", "zt")
# Elements that may stand for each other.
ELEMENT_GROUPS = {
    "alkali": "Li Na K Rb Cs", "alkaline": "Be Mg Ca Sr Ba", "transition_3d": "Sc Ti V Cr Mn Fe Co Ni Cu Zn", "transition_4d": "Y Zr Nb Mo Tc Ru Rh Pd Ag Cd", "transition_5d": "La Hf Ta W Re Os Ir Pt Au Hg",
    "lanthanide": "La Ce Pr Nd Sm Eu Gd Tb Dy Ho Er Yb Lu", "chalcogen": "O S Se Te", "pnictogen": "N P As Sb Bi", "halogen": "F Cl Br I", "post_transition": "Al Ga In Tl Sn Pb Bi", "metalloid": "B Si Ge As Sb Te",
}
FORMULA = r"\b(?:[A-Z][a-z]?(?:\d+(?:\.\d+)?)?){2,}\b"


def plain_formula(text: Column) -> Column:
    """Lowered digits, LaTeX and markup subscripts as plain digits; '' for null."""
    t = F.translate(F.coalesce(text, F.lit("")), "₀₁₂₃₄₅₆₇₈₉", "0123456789")
    return F.regexp_replace(F.regexp_replace(t, r"\$_\{?([0-9.]+)\}?\$", "$1"), r"<sub>([0-9.]+)</sub>", "$1")


def sentences(text: Column) -> Column:
    """Sentences of more than five characters; a dot between digits ends none."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)\.(\d)", "$1<DOT>$2")
    parts = F.transform(F.split(kept, r"[;.\n]+"), lambda s: F.trim(F.replace(s, F.lit("<DOT>"), F.lit("."))))
    return F.filter(parts, lambda s: F.length(s) > 5)


def symbols(formula: Column) -> Column:
    """Element symbols of a formula in order."""
    return F.regexp_extract_all(formula, F.lit(r"([A-Z][a-z]?)(?:\d+(?:\.\d+)?)?"), F.lit(1))


def is_formula(word: Column) -> Column:
    """Two or more known elements, a digit, no plain word, 2 to 40 characters."""
    parts = symbols(word)
    return (F.length(word).between(2, 40)) & (F.size(parts) >= 2) & F.forall(parts, lambda e: e.isin(*ELEMENTS)) & word.rlike(r"\d") & ~word.rlike(r"^[A-Za-z]{5,}$")


def formulas(text: Column) -> Column:
    """Distinct formulas of ``text`` in order. ``text`` is to be plain (``plain_formula``)."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(FORMULA), F.lit(0)), is_formula))


def mentioned(text: Column, names) -> Column:
    """Names found in the lower-cased ``text``, longest first."""
    return F.filter(literal(sorted(names, key=lambda n: (-len(n), n))), lambda n: F.contains(text, n))


def element_count(composition: Column) -> Column:
    """Capital letters of a composition, which count its elements; repeated elements count again."""
    return F.length(F.regexp_replace(composition, "[^A-Z]", ""))


def stoichiometry_violation(composition: Column, structure: Column) -> Column:
    """'too_few_elements', 'too_many_elements' or null; null too for unknown structures and nulls."""
    out = F.lit(None).cast("string")
    n = element_count(composition)
    for s, (low, high) in STOICHIOMETRY.items():
        out = F.when((structure == s) & (n < low), "too_few_elements").when((structure == s) & (n > high), "too_many_elements").otherwise(out)
    return out


def known_principle(structure: Column, prop: Column) -> Column:
    hit = (structure == "layered") & prop.isin(*LAYERED)
    for s, p in sorted(PRINCIPLES):
        hit = hit | ((structure == s) & (prop == p))
    return F.coalesce(hit, F.lit(False))


def prediction_interval(value: Column, u: float | Column, digits: int = 6) -> tuple[Column, Column]:
    """``value`` minus and plus the share ``u`` of it, in order, rounded."""
    a, b = value * (1 - u), value * (1 + u)
    return F.round(F.least(a, b), digits), F.round(F.greatest(a, b), digits)
