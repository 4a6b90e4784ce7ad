"""Clinical formulas. Every division by zero or missing part gives null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXPECTED, OTHER_LAB, REAL

Z95 = 1.96
#: The analytical share of variation is at least this part of the biological one.
CVA_FLOOR = 0.5
div = F.try_divide


def friedewald(total: Column, hdl: Column, tg: Column) -> Column:
    return F.when(tg < 400, total - hdl - tg / 5)


def castelli_1(total: Column, hdl: Column) -> Column:
    return div(total, hdl)


def castelli_2(ldl: Column, hdl: Column) -> Column:
    return div(ldl, hdl)


def tg_hdl(tg: Column, hdl: Column) -> Column:
    return div(tg, hdl)


def de_ritis(ast: Column, alt: Column) -> Column:
    return div(ast, alt)


def apri(ast: Column, platelets: Column) -> Column:
    return div(ast / 40 * 100, platelets)


def fib4(age: Column, ast: Column, platelets: Column, alt: Column) -> Column:
    return F.when(alt > 0, div(age * ast, platelets * F.sqrt(alt)))


def gfr_category(gfr: Column) -> Column:
    return F.when(gfr >= 90, "G1").when(gfr >= 60, "G2").when(gfr >= 45, "G3a").when(gfr >= 30, "G3b").when(gfr >= 15, "G4").when(gfr.isNotNull(), "G5")


def acr_category(acr: Column) -> Column:
    return F.when(acr < 30, "A1").when(acr < 300, "A2").when(acr.isNotNull(), "A3")


#: KDIGO's risk level by G row and A column: 1 low to 4 very high.
KDIGO = {"G1": (1, 2, 3), "G2": (1, 2, 3), "G3a": (2, 3, 4), "G3b": (3, 4, 4), "G4": (4, 4, 4), "G5": (4, 4, 4)}


def kdigo_risk(g: Column, a: Column) -> Column:
    risk = F.create_map(*[x for k, v in KDIGO.items() for i, n in enumerate(v) for x in (F.lit(f"{k}A{i + 1}"), F.lit(n))])
    return risk[F.concat(g, a)]


def urea_creatinine(urea: Column, creatinine: Column) -> Column:
    return div(urea, creatinine)


UREA_LOW, UREA_HIGH = 10 * 60 / 28, 20 * 60 / 28


def mentzer(mcv: Column, red_cells: Column) -> Column:
    return div(mcv, red_cells)


def mcv_category(mcv: Column) -> Column:
    return F.when(mcv < 80, "microcitico").when(mcv > 100, "macrocitico").when(mcv.isNotNull(), "normocitico")


def tsat(iron: Column, transferrin: Column) -> Column:
    return div(iron, transferrin * 1.42) * 100


def eag(hba1c: Column) -> Column:
    return 28.7 * hba1c - 46.7


def hba1c_category(x: Column) -> Column:
    return F.when(x < 5.7, "normal").when(x < 6.5, "prediabetes").when(x.isNotNull(), "diabetes")


def tyg(tg: Column, glucose: Column) -> Column:
    return F.when((tg > 0) & (glucose > 0), F.ln(tg * glucose / 2))


def corrected_calcium(calcium: Column, albumin: Column) -> Column:
    return calcium + 0.8 * (4.0 - albumin)


def bp_category(systolic: Column, diastolic: Column, place: Column) -> Column:
    """The worse of the two figures, by the limits of the place."""
    high_s, high_d = F.when(place == "casa", 135).otherwise(140), F.when(place == "casa", 85).otherwise(90)
    return F.when((systolic >= high_s) | (diastolic >= high_d), "hipertension").when((systolic >= 120) | (diastolic >= 70), "elevada").when(systolic.isNotNull() & diastolic.isNotNull(), "no elevada")


def effective_cva(cvi: Column, cva: Column) -> Column:
    return F.greatest(F.coalesce(cva, F.lit(0.0)), CVA_FLOOR * cvi)


def cvi_for(sex: Column, cvi: Column, cvi_f: Column, cvi_m: Column) -> Column:
    """The common value, else that of the sex, else the larger known one."""
    return F.coalesce(cvi, F.when(sex == "Mujer", cvi_f).when(sex == "Hombre", cvi_m), F.greatest(cvi_f, cvi_m))


def sigma(cvi: Column, cva: Column) -> Column:
    return F.sqrt(F.ln((effective_cva(cvi, cva) / 100) * (effective_cva(cvi, cva) / 100) + 1) + F.ln((cvi / 100) * (cvi / 100) + 1))


def rcv_down(cvi: Column, cva: Column) -> Column:
    return (F.exp(-(Z95 * math.sqrt(2)) * sigma(cvi, cva)) - 1) * 100


def rcv_up(cvi: Column, cva: Column) -> Column:
    return (F.exp((Z95 * math.sqrt(2)) * sigma(cvi, cva)) - 1) * 100


def percent_change(previous: Column, value: Column) -> Column:
    return div(value - previous, previous) * 100


def personal_bounds(centre: Column, n: Column, cvi: Column, cva: Column) -> tuple[Column, Column]:
    """A patient's own range around the mean of n points."""
    a = effective_cva(cvi, cva)
    half = Z95 * F.sqrt((n + 1) / n) * F.sqrt(cvi * cvi + a * a)
    return F.greatest(F.lit(0.0), centre * (1 - half / 100)), centre * (1 + half / 100)


def rcv_state(previous: Column, value: Column, lab_previous: Column, lab: Column, cvi: Column, cva: Column) -> Column:
    """Null without variation data or for values that a logarithm can't take; a lab '' is no lab."""
    pct = percent_change(previous, value)
    other = F.coalesce(lab_previous, F.lit("")) != F.coalesce(lab, F.lit(""))
    known = cvi.isNotNull() & (previous > 0) & (value > 0)
    return F.when(known, F.when(other, OTHER_LAB).when((pct > rcv_up(cvi, cva)) | (pct < rcv_down(cvi, cva)), REAL).otherwise(EXPECTED))
