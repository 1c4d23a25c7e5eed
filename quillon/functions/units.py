"""Units of measurement: spellings, a graph of affine conversions, shortest compositions.

A unit is a node, written ``a.b/c.d`` from atoms with whole exponents
(``cm2/V.s``); an edge holds ``y = factor * x + offset``. ``conversions`` composes
the edges along shortest paths, ``cycle_error`` compares every edge with the path
around it. Spellings of a node are made by rule from the spellings of its atoms.
All of this is small, fixed and built on the driver; data meet it in an equi-join.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import defaultdict, deque
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversions between units of one kind, as (unit, unit, factor, offset).
EDGES: list[tuple[str, str, float, float]] = [
    ("meV", "eV", 1e-3, 0), ("keV", "eV", 1e3, 0), ("MeV", "keV", 1e3, 0), ("kJ/mol", "eV", 1 / 96.48533212331, 0),
    ("J/mol", "kJ/mol", 1e-3, 0), ("kcal/mol", "kJ/mol", 4.184, 0), ("cal/mol", "kcal/mol", 1e-3, 0), ("hartree", "eV", 27.211386245988, 0),
    ("mS/cm", "S/cm", 1e-3, 0), ("uS/cm", "mS/cm", 1e-3, 0), ("S/m", "S/cm", 1e-2, 0), ("mS/m", "S/m", 1e-3, 0), ("kS/cm", "S/cm", 1e3, 0), ("kS/m", "S/m", 1e3, 0), ("MS/m", "S/m", 1e6, 0), ("1/ohm.cm", "S/cm", 1, 0), ("1/ohm.m", "S/m", 1, 0),
    ("ohm.m", "ohm.cm", 1e2, 0), ("mohm.cm", "ohm.cm", 1e-3, 0), ("uohm.cm", "mohm.cm", 1e-3, 0), ("kohm.cm", "ohm.cm", 1e3, 0), ("Mohm.cm", "ohm.cm", 1e6, 0), ("mohm.m", "ohm.m", 1e-3, 0), ("uohm.m", "ohm.m", 1e-6, 0),
    ("m2/V.s", "cm2/V.s", 1e4, 0), ("mm2/V.s", "cm2/V.s", 1e-2, 0),
    ("degC", "K", 1, 273.15), ("degF", "degC", 5 / 9, -160 / 9), ("degF", "K", 5 / 9, 459.67 * 5 / 9), ("mK", "K", 1e-3, 0), ("degR", "K", 5 / 9, 0),
    ("C/m2", "uC/cm2", 1e2, 0), ("mC/m2", "C/m2", 1e-3, 0), ("uC/m2", "mC/m2", 1e-3, 0), ("mC/cm2", "uC/cm2", 1e3, 0), ("nC/cm2", "uC/cm2", 1e-3, 0), ("C/cm2", "uC/cm2", 1e6, 0),
    ("nC/N", "pC/N", 1e3, 0), ("pm/V", "pC/N", 1, 0), ("nm/V", "pm/V", 1e3, 0), ("C/N", "pC/N", 1e12, 0), ("m/V", "pm/V", 1e12, 0), ("uC/N", "pC/N", 1e6, 0), ("um/V", "nm/V", 1e3, 0),
    ("kOe", "Oe", 1e3, 0), ("A/m", "Oe", 4e-3 * math.pi, 0), ("kA/m", "A/m", 1e3, 0), ("MA/m", "kA/m", 1e3, 0), ("T", "Oe", 1e4, 0), ("mT", "T", 1e-3, 0), ("uT", "mT", 1e-3, 0), ("G", "Oe", 1, 0), ("kG", "G", 1e3, 0), ("mT", "G", 10, 0),
    ("A/cm2", "kA/cm2", 1e-3, 0), ("A/m2", "A/cm2", 1e-4, 0), ("A/m2", "kA/cm2", 1e-7, 0), ("kA/m2", "A/m2", 1e3, 0), ("MA/m2", "kA/m2", 1e3, 0), ("mA/cm2", "A/cm2", 1e-3, 0), ("uA/cm2", "mA/cm2", 1e-3, 0), ("nA/cm2", "uA/cm2", 1e-3, 0), ("MA/cm2", "kA/cm2", 1e3, 0), ("mA/m2", "A/m2", 1e-3, 0), ("A/mm2", "A/cm2", 1e2, 0), ("mA/mm2", "A/mm2", 1e-3, 0),
    ("V/K", "uV/K", 1e6, 0), ("mV/K", "uV/K", 1e3, 0), ("nV/K", "uV/K", 1e-3, 0), ("uV/degC", "uV/K", 1, 0), ("mV/degC", "mV/K", 1, 0),
    ("W/cm.K", "W/m.K", 1e2, 0), ("mW/m.K", "W/m.K", 1e-3, 0), ("mW/cm.K", "W/cm.K", 1e-3, 0), ("kW/m.K", "W/m.K", 1e3, 0), ("W/m.degC", "W/m.K", 1, 0),
    ("1/K", "ppm/K", 1e6, 0), ("ppm/degC", "ppm/K", 1, 0), ("1/degC", "1/K", 1, 0), ("um/m.K", "ppm/K", 1, 0), ("ppb/K", "ppm/K", 1e-3, 0), ("%/K", "1/K", 1e-2, 0),
    ("J/g.K", "J/kg.K", 1e3, 0), ("kJ/kg.K", "J/g.K", 1, 0), ("cal/g.K", "J/g.K", 4.184, 0), ("kcal/kg.K", "cal/g.K", 1, 0), ("mJ/g.K", "J/g.K", 1e-3, 0), ("J/kg.degC", "J/kg.K", 1, 0), ("J/g.degC", "J/g.K", 1, 0),
    ("A.h/kg", "mA.h/g", 1, 0), ("A.h/g", "A.h/kg", 1e3, 0), ("C/g", "A.h/kg", 1 / 3.6, 0), ("mA.h/kg", "A.h/kg", 1e-3, 0), ("kC/g", "C/g", 1e3, 0), ("C/kg", "C/g", 1e-3, 0), ("kC/kg", "C/g", 1, 0),
    ("kW.h/kg", "W.h/kg", 1e3, 0), ("kJ/kg", "W.h/kg", 1 / 3.6, 0), ("MJ/kg", "kJ/kg", 1e3, 0), ("J/g", "kJ/kg", 1, 0), ("kJ/g", "MJ/kg", 1, 0), ("J/kg", "kJ/kg", 1e-3, 0), ("mW.h/g", "W.h/kg", 1, 0), ("W.h/g", "W.h/kg", 1e3, 0), ("MJ/kg", "W.h/kg", 1 / 3.6e-3, 0), ("kcal/kg", "kJ/kg", 4.184, 0),
    ("mV", "V", 1e-3, 0), ("uV", "mV", 1e-3, 0), ("kV", "V", 1e3, 0), ("nV", "uV", 1e-3, 0),
    ("MPa", "GPa", 1e-3, 0), ("kPa", "MPa", 1e-3, 0), ("Pa", "kPa", 1e-3, 0), ("hPa", "Pa", 1e2, 0), ("TPa", "GPa", 1e3, 0), ("N/mm2", "MPa", 1, 0), ("kN/mm2", "GPa", 1, 0), ("N/m2", "Pa", 1, 0), ("kgf/mm2", "MPa", 9.80665, 0), ("kgf/cm2", "kgf/mm2", 1e-2, 0),
    ("psi", "Pa", 6894.757293168361, 0), ("ksi", "psi", 1e3, 0), ("Mpsi", "ksi", 1e3, 0), ("bar", "Pa", 1e5, 0), ("kbar", "bar", 1e3, 0), ("Mbar", "kbar", 1e3, 0), ("mbar", "bar", 1e-3, 0), ("atm", "Pa", 101325, 0), ("torr", "atm", 1 / 760, 0), ("dyn/cm2", "Pa", 0.1, 0),
    ("kg/m3", "g/cm3", 1e-3, 0), ("g/mL", "g/cm3", 1, 0), ("g/L", "kg/m3", 1, 0), ("kg/L", "g/mL", 1, 0), ("mg/cm3", "g/cm3", 1e-3, 0), ("mg/mL", "g/mL", 1e-3, 0), ("kg/dm3", "kg/L", 1, 0), ("g/m3", "kg/m3", 1e-3, 0), ("kg/cm3", "g/cm3", 1e3, 0), ("t/m3", "g/cm3", 1, 0), ("lb/ft3", "kg/m3", 16.01846337396014, 0), ("lb/in3", "g/cm3", 27.679904710203125, 0),
    ("m2/kg", "m2/g", 1e-3, 0), ("cm2/g", "m2/g", 1e-4, 0), ("mm2/g", "cm2/g", 1e-2, 0), ("cm2/kg", "cm2/g", 1e-3, 0), ("km2/kg", "m2/kg", 1e6, 0), ("m2/mg", "m2/g", 1e3, 0), ("cm2/mg", "cm2/g", 1e3, 0), ("ft2/lb", "m2/kg", 0.20481614362252, 0),
    ("angstrom", "nm", 0.1, 0), ("um", "nm", 1e3, 0), ("mm", "um", 1e3, 0), ("cm", "mm", 10, 0), ("m", "mm", 1e3, 0), ("pm", "nm", 1e-3, 0), ("mil", "mm", 0.0254, 0), ("inch", "mm", 25.4, 0),
    ("cm2/s", "um2/s", 1e8, 0), ("mm2/s", "cm2/s", 1e-2, 0), ("m2/s", "cm2/s", 1e4, 0), ("nm2/s", "um2/s", 1e-6, 0), ("cm2/h", "cm2/s", 1 / 3600, 0), ("um2/ms", "um2/s", 1e3, 0),
    ("um/year", "mm/year", 1e-3, 0), ("mil/year", "mm/year", 0.0254, 0), ("inch/year", "mil/year", 1e3, 0), ("nm/year", "um/year", 1e-3, 0), ("cm/year", "mm/year", 10, 0), ("m/year", "mm/year", 1e3, 0), ("um/day", "um/year", 365.25, 0), ("mm/day", "um/day", 1e3, 0), ("nm/day", "um/day", 1e-3, 0),
    ("ms", "s", 1e-3, 0), ("us", "ms", 1e-3, 0), ("ns", "us", 1e-3, 0), ("min", "s", 60, 0), ("h", "min", 60, 0), ("day", "h", 24, 0),
    ("Hz", "kHz", 1e-3, 0), ("MHz", "kHz", 1e3, 0), ("GHz", "MHz", 1e3, 0), ("THz", "GHz", 1e3, 0), ("mHz", "Hz", 1e-3, 0), ("1/s", "Hz", 1, 0), ("1/ms", "kHz", 1, 0), ("1/min", "Hz", 1 / 60, 0), ("rpm", "1/min", 1, 0),
    ("permille", "%", 0.1, 0), ("ppm", "permille", 1e-3, 0),
]

# Further spellings of atoms, in lower case and without blanks, dots, carets and brackets.
ATOMS: dict[str, list[str]] = {
    "V": ["v", "volt", "volts"], "A": ["a", "amp", "amps", "ampere", "amperes"], "Pa": ["pa", "pascal", "pascals"], "eV": ["ev", "electronvolt", "electronvolts", "electron-volt", "electron-volts"],
    "T": ["t", "tesla"], "s": ["s", "sec", "secs", "second", "seconds"], "Hz": ["hz", "hertz"], "K": ["k", "kelvin", "kelvins", "degk"], "m": ["m", "meter", "meters", "metre", "metres"],
    "W": ["w", "watt", "watts"], "C": ["c", "coulomb", "coulombs"], "J": ["j", "joule", "joules"], "G": ["g", "gauss"], "Oe": ["oe", "oersted", "oersteds"], "g": ["g", "gram", "grams"], "h": ["h", "hr", "hrs", "hour", "hours"],
    "S": ["s", "siemens"], "ohm": ["ohm", "ohms", "ω"], "N": ["n", "newton", "newtons"], "L": ["l", "liter", "liters", "litre", "litres"], "psi": ["psi", "lbf/in2", "lb/in2", "lbfin-2"], "cal": ["cal", "calorie", "calories"],
    "degC": ["degc", "c", "celsius", "degcelsius", "degreec", "degreesc", "degreecelsius", "degreescelsius"], "degF": ["degf", "f", "fahrenheit", "degfahrenheit", "degreef", "degreesf"], "degR": ["degr", "rankine"],
    "angstrom": ["å", "a", "angstrom", "angstroms", "ångström", "ångstrom"], "min": ["min", "mins", "minute", "minutes"], "year": ["year", "years", "yr", "yrs", "y", "a", "annum"], "day": ["day", "days", "d"],
    "mil": ["mil", "mils"], "inch": ["inch", "inches", "in"], "kgf": ["kgf", "kp"], "%": ["%", "percent", "pct", "percents"], "permille": ["‰", "permille", "permil"], "mol": ["mol", "mole", "moles"],
    "ppm": ["ppm"], "ppb": ["ppb"], "bar": ["bar", "bars"], "hartree": ["hartree", "ha", "eh"], "um": ["micron", "microns"], "cm3": ["cc", "ccm"], "atm": ["atm"], "torr": ["torr", "mmhg"], "rpm": ["rpm"], "dyn": ["dyn", "dyne"], "lb": ["lb", "lbs"], "t": ["t", "ton"], "ft": ["ft"]
}
# Prefixes, as symbol, words and spellings of the symbol.
PREFIXES = {"T": ("tera", ["t"]), "G": ("giga", ["g"]), "M": ("mega", ["m"]), "k": ("kilo", ["k"]), "h": ("hecto", ["h"]), "d": ("deci", ["d"]), "c": ("centi", ["c"]), "m": ("milli", ["m"]), "u": ("micro", ["u"]), "n": ("nano", ["n"]), "p": ("pico", ["p"])}
# Whole units with names of their own.
NAMES = {"mil/year": ["mpy", "milsperyear"], "degC": ["degc"], "1/s": ["s^-1"], "kG": ["kilogauss"], "ohm.cm": ["ohm-cm", "ohmcm"], "ohm.m": ["ohm-m"], "mohm.cm": ["mohm-cm"], "uohm.cm": ["uohm-cm"], "mA.h/g": ["mahg-1"], "inch/year": ["ipy"]}


_CUBED = ("cc", "ccm")


@lru_cache(maxsize=1)
def graph() -> dict[str, list[tuple[str, float, float]]]:
    """Neighbours of each unit with ``y = factor * x + offset``; every edge in both directions."""
    near: dict[str, list[tuple[str, float, float]]] = defaultdict(list)
    for a, b, factor, offset in EDGES:
        near[a].append((b, factor, offset))
        near[b].append((a, 1 / factor, -offset / factor))
    return dict(near)


def conversions(source: str) -> dict[str, tuple[float, float]]:
    """(factor, offset) from ``source`` to every unit it reaches, over the fewest edges."""
    found = {source: (1.0, 0.0)}
    queue = deque([source])
    while queue:
        at = queue.popleft()
        factor, offset = found[at]
        for to, f, o in graph().get(at, []):
            if to not in found:
                found[to] = (f * factor, f * offset + o)
                queue.append(to)
    return found


@lru_cache(maxsize=1)
def cycle_error() -> float:
    """The largest relative error between an edge and the composition of shortest paths around it."""
    worst = 0.0
    for a, b, factor, offset in EDGES:
        for root in graph():
            paths = conversions(root)
            if a in paths and b in paths:
                (fa, oa), (fb, ob) = paths[a], paths[b]
                worst = max(worst, abs(factor * fa / fb - 1), abs(factor * oa + offset - ob) / max(1.0, abs(ob)))
    return worst


def _atom(symbol: str) -> list[str]:
    """Spellings of one atom, prefixes included."""
    if symbol in ATOMS:
        out = list(ATOMS[symbol])
    else:
        out = []
    if symbol not in ATOMS or symbol == "um":
        head, base = symbol[0], symbol[1:]
        if head in PREFIXES and base in ATOMS:
            word, signs = PREFIXES[head]
            short = ATOMS[base][0]
            out += [p + s for p in signs for s in ATOMS[base]] + [word + s for s in ATOMS[base]] + [f"{word}-{s}" for s in (short, *ATOMS[base][1:2])]
        else:
            out.append(symbol.lower())
    return out


def _power(text: str) -> tuple[list[str], int]:
    m = re.fullmatch(r"([^\d]+?)(\d*)", text)
    assert m, text
    spelled = _atom(m[1])
    if text in ATOMS and m[2]:
        spelled = spelled + ATOMS[text]
    return spelled, int(m[2] or 1)


@lru_cache(maxsize=None)
def spellings(unit: str) -> frozenset[str]:
    """Folded spellings of ``unit``: quotient, negative exponents, words; see ``unit_key`` for the folding."""
    top, _, bottom = unit.partition("/")
    tops = [] if top == "1" else [_power(x) for x in top.split(".")]
    bottoms = [_power(x) for x in bottom.split(".")] if bottom else []
    up = lambda s, e: s + (str(e) if e > 1 else "")
    over = ["".join(p) for p in itertools.product(*[[s if s in _CUBED else up(s, e) for s in names] for names, e in tops])] if tops else ["1"]
    out: set[str] = set()
    if not bottoms:
        out |= set(over) - {"1"}
        if len(tops) > 1:
            out |= {"-".join(p) for p in itertools.product(*[[up(s, e) for s in names] for names, e in tops])}
    else:
        flat = [[s if s in _CUBED else up(s, e) for s in names] for names, e in bottoms]
        negative = [[f"{s}-{e}" for s in names if s not in _CUBED] for names, e in bottoms]
        heads = over + ([""] if not tops else [])
        for head in heads:
            for p in itertools.product(*flat):
                out.add(f"{head}/{''.join(p)}")
                out.add(f"{head}/{'/'.join(p)}")
            for p in itertools.product(*negative):
                if head != "1":
                    out.add(head + "".join(p))
    return frozenset(out | set(NAMES.get(unit, [])))


def conversion_rows(targets: list[str]) -> list[tuple[str, str, float, float]]:
    """(folded spelling, common unit as given, factor, offset) for every spelling that leads to each target.

    Letter case is folded, so ``mPa`` and ``MPa`` are one spelling; of the units it may
    stand for, the one nearest in size to the target is meant.
    """
    by_spelling: dict[str, list[str]] = defaultdict(list)
    for unit in graph():
        for s in spellings(unit):
            by_spelling[s].append(unit)
    rows = []
    for target in dict.fromkeys(targets):
        node = next((u for u in by_spelling.get(fold(target), []) if u in graph()), None)
        if node is None:
            continue
        node = max(by_spelling[fold(target)], key=lambda u: (_exact(u, target), -len(u)))
        to = {u: conversions(u).get(node) for u in conversions(node)}
        best: dict[str, tuple[float, float, float, float]] = {}
        for spelling, units in by_spelling.items():
            for unit in units:
                if to.get(unit):
                    factor, offset = to[unit]
                    rank = (abs(math.log10(abs(factor))), factor)
                    if spelling not in best or rank < best[spelling][:2]:
                        best[spelling] = (*rank, factor, offset)
        rows += [(s, target, f, o) for s, (_, _, f, o) in sorted(best.items())]
    return rows


def _exact(unit: str, written: str) -> bool:
    """Whether ``written`` spells ``unit`` in the very letter case of its symbol."""
    plain = written.translate(str.maketrans(*_RAISED) | str.maketrans(*_SIGNS)).replace("ω", "ohm")
    return re.sub(r"[./]", "", unit) == re.sub(r"[./·\s]", "", plain)


_RAISED = ("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺₀₁₂₃₄₅₆₇₈₉", "0123456789-+0123456789")
_SIGNS = ("µμ−–‐‑ΩωΩ", "uu----ωωω")
_DROPPED = " \t\r\n   .·⋅∙•*^{}()[]"


def fold(text: str) -> str:
    """The Python twin of ``unit_key``."""
    t = text.translate(str.maketrans(*_RAISED) | str.maketrans(*_SIGNS)).lower()
    t = re.sub("℃", "degc", re.sub("℉", "degf", re.sub("[°º˚]", "deg", t)))
    t = re.sub(r"\bper\b", "/", t.replace("per mille", "permille"))
    t = "".join(c for c in t if c not in _DROPPED)
    return t.replace("ω", "ohm").replace("å", "å").replace("Å", "å")


def unit_key(unit: Column) -> Column:
    """Fold a written unit to its spelling key: case, signs, raised digits, blanks, dots and brackets; '' if none."""
    t = F.lower(F.translate(unit, _RAISED[0] + _SIGNS[0] + "Å", _RAISED[1] + _SIGNS[1] + "å"))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[°º˚]", "deg"), "℃", "degc"), "℉", "degf")
    t = F.regexp_replace(F.regexp_replace(t, "per mille", "permille"), r"\bper\b", "/")
    t = F.translate(t, _DROPPED, "")
    return F.coalesce(F.regexp_replace(t, "ω", "ohm"), F.lit(""))
