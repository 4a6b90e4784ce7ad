"""Units: a comparable key, guards that accept a value in a known unit, and dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units by key, with their dimension and their factor to that dimension's unit.
UNITS: dict[str, tuple[str, float]] = {
    "g/l": ("mass", 1.0), "g/dl": ("mass", 10.0), "mg/dl": ("mass", 0.01), "mg/l": ("mass", 0.001),
    "mcg/ml": ("mass", 0.001), "mcg/dl": ("mass", 1e-5), "mcg/l": ("mass", 1e-6), "ng/ml": ("mass", 1e-6),
    "ng/dl": ("mass", 1e-8), "pg/ml": ("mass", 1e-9),
    "mmol/l": ("substance", 1.0), "meq/l": ("substance", 1.0), "mcmol/l": ("substance", 1e-3),
    "u/l": ("activity", 1.0), "ui/l": ("activity", 1.0), "iu/l": ("activity", 1.0), "ui/l37c": ("activity", 1.0), "u/l37c": ("activity", 1.0),
    "mcui/ml": ("hormone", 1.0), "mciu/ml": ("hormone", 1.0), "mu/l": ("hormone", 1.0), "mui/l": ("hormone", 1.0),
    "iu/ml": ("iu_ml", 1.0), "ui/ml": ("iu_ml", 1.0), "ku/l": ("iu_ml", 1.0), "kua/l": ("iu_ml", 1.0),
    "mmol/mol": ("mmol/mol", 1.0), "%": ("%", 1.0), "fl": ("fl", 1.0), "pg": ("pg", 1.0), "mm/h": ("mm/h", 1.0),
    "s": ("s", 1.0), "seg": ("s", 1.0), "segons": ("s", 1.0),
}


def key(unit: Column) -> Column:
    """Lower case without blanks or underscores; micro as mc, superscripts as digits, powers of ten as x10^n."""
    x = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"[\s_]+", "")
    for a, b in (("µ", "mc"), ("μ", "mc"), ("³", "3"), ("⁶", "6"), ("·", "x")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(x, r"^x10\^?", "x10^")


def is_count_1e9(unit: Column) -> Column:
    return key(unit).startswith("x10^3") | key(unit).startswith("x10^9/l")


def is_count_1e12(unit: Column) -> Column:
    return key(unit).startswith("x10^6") | key(unit).startswith("x10^12/l")


def one_of(unit: Column, *keys: str) -> Column:
    return F.coalesce(key(unit).isin(*keys), F.lit(False))


def is_mg_dl(unit: Column) -> Column:
    return one_of(unit, "mg/dl", "mgdl")


def is_ml_min(unit: Column) -> Column:
    return key(unit).startswith("ml/min")


def is_acr(unit: Column) -> Column:
    x = F.regexp_replace(F.lower(F.coalesce(unit, F.lit(""))), r"[\s]+", "")
    return x.isin("mg/g_creat", "mg/gcreat", "mg/g", "mcg/mg", "µg/mg")


def is_u_l(unit: Column) -> Column:
    return key(unit).rlike("^u/l|^ui/l")


def is_percent(unit: Column) -> Column:
    return F.coalesce(F.trim(unit) == "%", F.lit(False))


def guarded(value: Column, ok: Column) -> Column:
    """The value, or null if its unit is not accepted; nothing is converted unless listed."""
    return F.when(ok, value)


def albumin_g_dl(value: Column, unit: Column) -> Column:
    return F.when(one_of(unit, "g/dl", "gdl"), value).when(one_of(unit, "g/l", "gl"), value / 10)


def crp_mg_dl(value: Column, unit: Column) -> Column:
    """Also for the bounds of the same row."""
    return F.when(is_mg_dl(unit), value).when(one_of(unit, "mg/l", "mgl"), value / 10)


def dimension(unit: Column) -> Column:
    """(dimension, factor), null for an unknown or absent unit."""
    k = key(unit)
    known = F.create_map(*[x for u, (d, f) in UNITS.items() for x in (F.lit(u), F.struct(F.lit(d).alias("dim"), F.lit(f).alias("factor")))])
    special = lambda d: F.struct(F.lit(d).alias("dim"), F.lit(1.0).alias("factor"))
    return F.when(k == "", None).when(is_count_1e9(unit), special("count_1e9")).when(is_count_1e12(unit), special("count_1e12")).when(is_ml_min(unit), special("ml/min")).otherwise(known[k])


def relation(a: Column, b: Column) -> Column:
    """Of two arrays of units: igual, convertible, incompatible or desconocida (some unit is unknown)."""
    some = lambda x: F.filter(x, lambda u: u.isNotNull() & (u != ""))
    dims = lambda x: F.array_sort(F.array_distinct(F.transform(some(x), dimension)))
    names = lambda x: F.array_sort(F.array_distinct(F.transform(some(x), lambda u: dimension(u)["dim"])))
    keys = lambda x: F.array_sort(F.array_distinct(F.transform(x, key)))
    unknown = F.exists(some(a), lambda u: dimension(u).isNull()) | F.exists(some(b), lambda u: dimension(u).isNull()) | (F.size(some(a)) == 0) | (F.size(some(b)) == 0)
    return F.when(unknown, F.when(keys(a) == keys(b), "igual").otherwise("desconocida")).when(dims(a) == dims(b), "igual").when(names(a) == names(b), "convertible").otherwise("incompatible")
