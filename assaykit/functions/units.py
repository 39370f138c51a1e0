"""Units and the measurement grammar as Spark expressions, with the same grammar in plain Python for UDF bodies."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from assaykit.functions import text as tx

# By dimension and base unit, the spellings of units and their factors.
DIMENSIONS = {
    ("concentration", "M"): {"M": 1.0, "mM": 1e-3, "uM": 1e-6, "μM": 1e-6, "nM": 1e-9, "pM": 1e-12, "mol/L": 1.0, "mmol/L": 1e-3, "μmol/L": 1e-6, "umol/L": 1e-6, "nmol/L": 1e-9},
    ("mass_concentration", "mg/mL"): {"mg/mL": 1.0, "ug/mL": 1e-3, "μg/mL": 1e-3, "ng/mL": 1e-6},
    ("activity_concentration", "U/ml"): {"U/ml": 1.0, "U/mL": 1.0},
    ("length", "m"): {"nm": 1e-9, "um": 1e-6, "μm": 1e-6, "mm": 1e-3, "cm": 1e-2, "m": 1.0},
    ("mass", "g"): {"ng": 1e-6, "μg": 1e-6, "ug": 1e-6, "mg": 1e-3, "g": 1.0, "kg": 1e3},
    ("volume", "mL"): {"uL": 1e-3, "μL": 1e-3, "mL": 1.0, "L": 1e3},
    ("time", "s"): {"ms": 1e-3, "s": 1.0, "min": 60.0, "h": 3600.0, "day": 86400.0, "d": 86400.0},
    ("temperature", "K"): {"K": 1.0},
    ("temperature", "C"): {"C": 1.0, "°C": 1.0},
    ("pressure", "Pa"): {"Pa": 1.0, "kPa": 1e3, "MPa": 1e6, "bar": 1e5},
    ("energy", "J"): {"J": 1.0, "kJ": 1e3},
    ("energy", "eV"): {"eV": 1.0, "keV": 1e3},
    ("power", "W"): {"W": 1.0, "kW": 1e3},
    ("amount", "mol"): {"mol": 1.0, "mmol": 1e-3, "μmol": 1e-6, "umol": 1e-6, "nmol": 1e-9},
    ("ratio", "%"): {"%": 1.0},
}
#: unit: (dimension, factor, base unit)
REGISTRY = {unit: (dimension, factor, base) for (dimension, base), factors in DIMENSIONS.items() for unit, factor in factors.items()}
NEEDS_SPACE = ("C", "K", "g", "M")
TIME_UNITS = ("ms", "s", "min", "h", "day", "d")
MOLAR_UNITS = tuple(u for u, (dimension, _, _) in REGISTRY.items() if dimension == "concentration")
DOSE_UNITS = MOLAR_UNITS + tuple(u for u, (dimension, _, _) in REGISTRY.items() if dimension.endswith("_concentration"))

# The grammar. Java's word class is narrower than Python's, hence two spellings of the boundaries.
NUMBER = r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?"
UNIT = r"%|°?[A-Za-zμµ]+(?:/[A-Za-zμµ]+)?"
_BODY = rf"({NUMBER})(?:\s*[±+]\s*({NUMBER}))?(\s*)({UNIT})"
# The lookahead spares most places the search behind them: a number begins with a sign, a point or a digit.
SPAN_JAVA = rf"(?U)(?=[+\-.\d])(?<![\p{{L}}\p{{N}}_.]){_BODY}(?![\p{{L}}\p{{N}}_])"
_PLAIN_BODY = rf"({NUMBER})\s*(%|°?[A-Za-zμµ]+)"
PLAIN_SPAN_JAVA = rf"(?U)(?=[+\-.\d])(?<![\p{{L}}\p{{N}}_.]){_PLAIN_BODY}(?![\p{{L}}\p{{N}}_])"
WHOLE_JAVA = rf"(?U)^\s*({NUMBER})\s*([^\d\s].*?)?\s*$"
BARE_JAVA = rf"(?U)^\s*({NUMBER})(?:\s*[±+]\s*({NUMBER}))?\s*$"
SPAN = re.compile(rf"(?<![\w.]){_BODY}(?!\w)")
WHOLE = re.compile(rf"^\s*({NUMBER})\s*([^\d\s].*?)?\s*$")
BARE = re.compile(rf"^\s*({NUMBER})(?:\s*[±+]\s*({NUMBER}))?\s*$")


class UnitError(ValueError):
    """A text is no number with a registered unit, or units do not convert."""


fold_micro = tx.fold_micro


def registry() -> Column:
    """map<unit, struct<dimension, factor, base>>, a literal once the optimizer has folded it."""
    entries = {u: {"dimension": d, "factor": f, "base": b} for u, (d, f, b) in REGISTRY.items()}
    return F.from_json(F.lit(json.dumps(entries, ensure_ascii=False)), "map<string,struct<dimension:string,factor:double,base:string>>")


def known(unit: Column) -> Column:
    return unit.isin(*REGISTRY)


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def number_unit(text: Column) -> Column:
    """struct<value, unit> of a whole text that is a number and at most one registered unit; else null."""
    folded = fold_micro(text)
    value = _group(folded, WHOLE_JAVA, 1).try_cast("double")
    unit = F.coalesce(F.trim(_group(folded, WHOLE_JAVA, 2)), F.lit(""))
    ok = text.isNotNull() & folded.rlike(WHOLE_JAVA) & ((unit == "") | known(unit)) & value.isNotNull()
    return F.when(ok, F.struct(value.alias("value"), unit.alias("unit")))


def spans(text: Column, pattern: str = SPAN_JAVA) -> Column:
    """array<struct<start, end, value, unit, uncertainty>> of the measurements in a text, in order; offsets in code points.

    Positions are running sums over the pieces that splitting at the pattern leaves."""
    full = pattern == SPAN_JAVA
    whole = rf"(?U)^{_BODY if full else _PLAIN_BODY}\z"  # on a match alone, its groups are those it has in the text
    none = F.lit(None).cast("string")
    group = lambda x, k: F.regexp_extract(x["m"], whole, k)
    parts = lambda x: F.struct(x["m"], x["gap"], group(x, 1).alias("n"), (group(x, 2) if full else none).alias("e"), (group(x, 3) if full else none).alias("s"), group(x, 4 if full else 2).alias("u"))
    # The folded text and its matches are bound once each, as the only elements of arrays.
    matches = lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"))
    pieces = lambda b: F.transform(F.filter(F.arrays_zip(b["m"].alias("m"), F.split(b["t"], pattern, -1).alias("gap")), lambda x: x["m"].isNotNull()), parts)

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        error = F.nullif(x["e"], F.lit("")) if full else none
        found = F.struct(start.alias("start"), end.alias("end"), x["n"].try_cast("double").alias("value"), x["u"].alias("unit"), error.try_cast("double").alias("uncertainty"))
        keep = known(x["u"]) & (~x["u"].isin(*NEEDS_SPACE) | (x["s"] != "")) if full else known(x["u"])
        return F.struct(end.alias("at"), F.when(keep, F.concat(a["out"], F.array(found))).otherwise(a["out"]).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,value:double,unit:string,uncertainty:double>>")
    found = lambda b: F.when(F.size(b["m"]) > 0, F.aggregate(pieces(b), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])).otherwise(empty)
    return F.get(F.transform(F.transform(F.array(fold_micro(text)), matches), found), 0)


def measurement(text: Column, default_unit: Column) -> Column:
    """struct<value, unit, uncertainty>: the first measurement in the text, else a bare number with the default unit, else a
    whole number and unit. Null where none applies; an unregistered default unit fails a bare number, as it has no meaning."""
    bare = text.rlike(BARE_JAVA)
    unit = fold_micro(default_unit)
    of = lambda v, u, e: F.struct(v.alias("value"), u.alias("unit"), e.alias("uncertainty"))
    own = F.when(known(unit), of(_group(text, BARE_JAVA, 1).try_cast("double"), unit, _group(text, BARE_JAVA, 2).try_cast("double")))
    # The parses are bound once, as the only element of an array, since each is used more than once.
    parsed = F.array(F.struct(F.get(spans(text), 0).alias("span"), number_unit(text).alias("whole")))

    def choose(p: Column) -> Column:
        span, whole = p["span"], p["whole"]
        plain = F.when(whole.isNotNull(), of(whole["value"], whole["unit"], F.lit(None).cast("double")))
        return F.when(span.isNotNull(), of(span["value"], span["unit"], span["uncertainty"])).when(bare & (F.coalesce(default_unit, F.lit("")) != ""), own).otherwise(plain)

    return F.element_at(F.transform(parsed, choose), 1)


def convert(value: Column, unit: Column, target: Column) -> Column:
    """The value in ``target``; null where dimensions differ or a unit is unknown. Energies in J and eV do not mix."""
    a, b = F.element_at(registry(), unit), F.element_at(registry(), target)
    celsius = ("C", "°C")
    warm = F.when(unit.isin(*celsius) & (target == "K"), value + 273.15).when((unit == "K") & target.isin(*celsius), value - 273.15).otherwise(value)
    return F.when(known(unit) & known(target) & (a["dimension"] == b["dimension"]), F.when(a["dimension"] == "temperature", warm).when(a["base"] == b["base"], value * a["factor"] / b["factor"]))


def standardize(value: Column, unit: Column) -> Column:
    """struct<value, unit> in the base unit of the unit's dimension."""
    r = F.element_at(registry(), unit)
    return F.when(known(unit), F.struct((value * r["factor"]).alias("value"), r["base"].alias("unit")))


# The same grammar for UDF bodies.


def parse_number_unit(value: object) -> tuple[float, str]:
    if isinstance(value, bool) or not isinstance(value, (int, float, str)):
        raise UnitError("neither a number nor a text")
    if not isinstance(value, str):
        if not math.isfinite(value):
            raise UnitError("a number must be finite")
        return float(value), ""
    m = WHOLE.match(value.replace("µ", "μ"))
    unit = (m.group(2) or "").strip() if m else ""
    if not m or (unit and unit not in REGISTRY):
        raise UnitError(f"no number with a registered unit: {value!r}")
    return float(m.group(1)), unit


def find_spans(text: str) -> list[tuple[int, int, float, str, float | None]]:
    out = []
    for m in SPAN.finditer(text.replace("µ", "μ")):
        number, error, space, unit = m.groups()
        if unit in REGISTRY and (space or unit not in NEEDS_SPACE):
            out.append((m.start(), m.end(), float(number), unit, None if error is None else float(error)))
    return out


def parse_measurement(value: object, default_unit: str = "") -> tuple[float, str, float | None]:
    if isinstance(value, str):
        if found := find_spans(value):
            return found[0][2:]
        if default_unit and (m := BARE.match(value)):
            number, unit = parse_number_unit(f"{m.group(1)} {default_unit}")
            return number, unit, None if m.group(2) is None else float(m.group(2))
    return (*parse_number_unit(value), None)


def convert_value(value: float, unit: str, target: str) -> float:
    if unit not in REGISTRY or target not in REGISTRY:
        raise UnitError("unknown unit")
    (one, factor, base), (two, target_factor, target_base) = REGISTRY[unit], REGISTRY[target]
    if one != two:
        raise UnitError(f"{unit} does not convert to {target}")
    if one == "temperature":
        return value + {("C", "K"): 273.15, ("K", "C"): -273.15}.get((base, target_base), 0.0)
    if base != target_base:
        raise UnitError(f"{unit} does not convert to {target}")
    return value * factor / target_factor
