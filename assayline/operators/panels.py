"""Clinical index panels: a panel is data. One pivot by (patient, date) serves every index; unit guards come before it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, indices, ranges, units

C = F.col


# Each panel's analytes in the order of its heat map, with the label of the row and the ids that are one
# parameter under different reports, the first one that has a date's point giving it.
ANALYTES: tuple[tuple[str, str, str, tuple[str, ...]], ...] = (
    ("lipid", "total", "Colesterol total", ("colesterol_serum", "colesterol")),
    ("lipid", "hdl", "Colesterol HDL", ("colesterol_hdl_serum", "colesterol_hdl")),
    ("lipid", "ldl", "Colesterol LDL", ("colesterol_ldl",)),
    ("lipid", "nonhdl", "Colesterol no HDL", ("colesterol_no_hdl_serum",)),
    ("lipid", "vldl", "Colesterol VLDL", ("colesterol_vldl",)),
    ("lipid", "tg", "Triglicéridos", ("triglicerids_serum", "triglicerids")),
    ("hepatic", "ast", "AST (GOT)", ("aspartat_aminotranferasa_ast_serum",)),
    ("hepatic", "alt", "ALT (GPT)", ("alanina_aminotransferasa_alt_serum",)),
    ("hepatic", "plt", "Plaquetas", ("plaquetes",)),
    ("renal", "egfr", "Filtrado glomerular", ("filtrat_glomerular_estimat_serum", "filtrat_glomerular_estimat", "filtrat_glomerular_estimat_90_ml_min")),
    ("renal", "creat", "Creatinina", ("creatinina_serum",)),
    ("renal", "urea", "Urea", ("urea_serum",)),
    ("renal", "acr", "Albúmina/creatinina (orina)", ("albumina_creatinina", "albumina_creatinina_orina_esporadica")),
    ("hemogram", "rbc", "Hematíes", ("hematies",)),
    ("hemogram", "mcv", "VCM", ("vcm",)),
    ("hemogram", "rdw", "RDW", ("rdw_cv",)),
    ("hemogram", "neu", "Neutrófilos (absoluto)", ("neutrofils_total",)),
    ("hemogram", "lym", "Linfocitos (absoluto)", ("limfocits_total", "linfocits_total")),
    ("hemogram", "mono", "Monocitos (absoluto)", ("monocits_total",)),
    ("hemogram", "plt", "Plaquetas", ("plaquetes",)),
    ("iron", "iron", "Hierro", ("ferro_serum", "ferro")),
    ("iron", "ferritin", "Ferritina", ("ferritina_serum", "ferritina")),
    ("iron", "transferrin", "Transferrina", ("transferrina_serum", "transferrina")),
    ("iron", "tsat", "Saturación de transferrina", ("saturacio_transferrina_serum", "saturacio")),
    ("inflammation", "crp", "PCR", ("proteina_c_reactiva_serum", "proteina_c_reactiva", "proteina_c_reactiva_en_suero", "srm_proteina_c_reactiva_c_massa")),
    ("inflammation", "esr", "VSG", ("vsg_velocitat_de_sedimentacio_globular", "vsg_velocitat_de_sedimentacio_globular_sang")),
    ("uric", "urate", "Ácido úrico", ("urat_serum",)),
    ("calcium", "ca", "Calcio", ("calci_serum", "calci")),
    ("calcium", "alb", "Albúmina", ("albumina_serum", "albumina_g_dl", "albumina_g_l", "srm_albumina_c_massa", "seroalbumina")),
    ("glycemic", "glucose", "Glucosa", ("glucosa_serum", "glucosa")),
    ("glycemic", "hba1c", "HbA1c", ("hb_glicosilada_hba1c_sang",)),
    ("thyroid", "tsh", "TSH", ("tirotropina_tsh_serum", "tirotropina_tsh")),
    ("thyroid", "ft4", "T4 libre", ("tiroxina_lliure_t4l", "tiroxina_lliure_t4_lliure_serum")),
)


def panel_ids() -> list[str]:
    """Every id that a panel uses."""
    return sorted({i for *_, ids in ANALYTES for i in ids})


def analyte_table(spark: SparkSession) -> DataFrame:
    """(panel, analyte, label, place, canonical_id, priority): the panels' analytes as a dimension."""
    rows = [(p, a, label, place, i, k) for place, (p, a, label, ids) in enumerate(ANALYTES) for k, i in enumerate(ids)]
    return spark.createDataFrame(rows, "panel string, analyte string, label string, place int, canonical_id string, priority int")


def heatmap_rows(s: DataFrame, table: DataFrame) -> DataFrame:
    """Points of series (patient_id, canonical_id, fecha, result_id) as rows of the panels' heat maps: one for each analyte
    and date, of the first id that has one. An id of several panels gives a point to each."""
    first = F.row_number().over(Window.partitionBy("patient_id", "panel", "analyte", "fecha").orderBy("priority", "result_id"))
    return s.join(table, "canonical_id").withColumn("__n", first).where("__n = 1").drop("__n", "priority")


@dataclass(frozen=True)
class Index:
    """A derived series: its formula over the pivoted analytes, and the bounds that flag it (numbers or columns)."""

    formula: Callable[[], Column]
    low: float | Callable[[], Column] | None = None
    high: float | Callable[[], Column] | None = None


@dataclass(frozen=True)
class Panel:
    #: analyte: the guard that turns (value, unit) into an accepted value.
    analytes: dict[str, Callable[[Column, Column], Column]]
    indices: dict[str, Index]
    #: Analytes that the latest summary needs on one date, by presence or by accepted unit.
    latest: tuple[str, ...] = ()
    by_unit: bool = False
    birth: bool = field(default=False)


def accept(test: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda v, u: units.guarded(v, test(u))


MG = accept(units.is_mg_dl)
UL = accept(units.is_u_l)
COUNT = accept(units.is_count_1e9)


def _is(*keys: str) -> Callable[[Column, Column], Column]:
    return accept(lambda u: units.one_of(u, *keys))


def _ldl() -> Column:
    return F.coalesce(C("ldl"), indices.friedewald(C("total"), C("hdl"), C("tg")))


PANELS: dict[str, Panel] = {
    "lipid": Panel(
        {"total": MG, "hdl": MG, "ldl": MG, "tg": MG},
        {
            "castelli_1": Index(lambda: indices.castelli_1(C("total"), C("hdl")), high=5.0),
            "castelli_2": Index(lambda: indices.castelli_2(_ldl(), C("hdl")), high=3.0),
            "tg_hdl": Index(lambda: indices.tg_hdl(C("tg"), C("hdl")), high=3.0),
            "ldl_estimated": Index(lambda: F.when(C("ldl").isNull(), indices.friedewald(C("total"), C("hdl"), C("tg"))), high=130.0),
        },
        ("total", "hdl"),
    ),
    "hepatic": Panel(
        {"ast": UL, "alt": UL, "platelets": COUNT},
        {
            "de_ritis": Index(lambda: indices.de_ritis(C("ast"), C("alt")), high=2.0),
            "apri": Index(lambda: indices.apri(C("ast"), C("platelets")), high=1.5),
            "fib4": Index(lambda: indices.fib4(C("age"), C("ast"), C("platelets"), C("alt")), high=2.67),
        },
        ("ast", "alt"),
        birth=True,
    ),
    "renal": Panel(
        {"gfr": accept(units.is_ml_min), "acr": accept(units.is_acr), "urea": MG, "creatinine": MG},
        {"urea_creatinine": Index(lambda: indices.urea_creatinine(C("urea"), C("creatinine")), indices.UREA_LOW, indices.UREA_HIGH)},
        ("gfr",),
        by_unit=True,
    ),
    "hemogram": Panel(
        {"neutrophils": COUNT, "lymphocytes": COUNT, "monocytes": COUNT, "platelets": COUNT, "mcv": _is("fl"), "red_cells": accept(units.is_count_1e12)},
        {
            "nlr": Index(lambda: indices.div(C("neutrophils"), C("lymphocytes")), high=3.83),
            "plr": Index(lambda: indices.div(C("platelets"), C("lymphocytes")), high=185.52),
            "lmr": Index(lambda: indices.div(C("lymphocytes"), C("monocytes"))),
            "mentzer": Index(lambda: F.when(C("mcv") < 80, indices.mentzer(C("mcv"), C("red_cells"))), low=13.0),
        },
        ("mcv",),
        by_unit=True,
    ),
    "iron": Panel(
        {"iron": _is("mcg/dl"), "ferritin": _is("ng/ml", "mcg/l"), "transferrin": MG, "tsat": accept(units.is_percent)},
        {"ferritin": Index(lambda: C("ferritin"), low=15.0), "tsat": Index(lambda: F.coalesce(C("tsat"), indices.tsat(C("iron"), C("transferrin"))), 20.0, 50.0)},
        ("iron", "ferritin", "transferrin", "tsat"),
        by_unit=True,
    ),
    "glycemic": Panel({"hba1c": accept(units.is_percent), "glucose": MG}, {"eag": Index(lambda: indices.eag(C("hba1c")), high=28.7 * 6.5 - 46.7)}, ("hba1c",), by_unit=True),
    "tyg": Panel({"tg": MG, "glucose": MG}, {"tyg": Index(lambda: F.bround(indices.tyg(C("tg"), C("glucose")), 2))}, ("tg", "glucose")),
    "calcium": Panel({"calcium": MG, "albumin": units.albumin_g_dl}, {"corrected_calcium": Index(lambda: indices.corrected_calcium(C("calcium"), C("albumin")), lambda: C("calcium_low"), lambda: C("calcium_high"))}, ("calcium", "albumin")),
    "uric": Panel({"uric": MG}, {"uric": Index(lambda: C("uric"), high=6.8)}, ("uric",), by_unit=True),
    "inflammation": Panel({"crp": units.crp_mg_dl, "esr": _is("mm/h", "mm")}, {"crp": Index(lambda: C("crp"), lambda: C("crp_low"), lambda: C("crp_high")), "esr": Index(lambda: C("esr"), lambda: C("esr_low"), lambda: C("esr_high"))}, ("crp", "esr"), by_unit=True),
    "thyroid": Panel({"tsh": _is("mcui/ml", "mciu/ml", "mu/l", "mui/l"), "ft4": _is("ng/dl")}, {"tsh": Index(lambda: C("tsh"), lambda: C("tsh_low"), lambda: C("tsh_high")), "ft4": Index(lambda: C("ft4"), lambda: C("ft4_low"), lambda: C("ft4_high"))}, ("tsh", "ft4"), by_unit=True),
}


def wide(points: DataFrame, panel: Panel, births: DataFrame | None = None) -> DataFrame:
    """One row per patient and date: each analyte's accepted value, its bounds, and whether it is there at all.

    ``points`` is a merged series (one point per analyte and date), so the maxima below each see one row.
    """
    low, high = C("ref_low"), C("ref_high")
    aggs = []
    for a, guard in panel.analytes.items():
        mine = C("analyte") == a
        aggs += [F.max(F.when(mine, guard(C("value_num"), C("unit")))).alias(a), F.max(F.when(mine, guard(low, C("unit")))).alias(f"{a}_low"), F.max(F.when(mine, guard(high, C("unit")))).alias(f"{a}_high"), F.max(mine.cast("int")).alias(f"{a}_there")]
    out = points.where(C("analyte").isin(*panel.analytes)).groupBy("patient_id", "fecha").agg(*aggs)
    if panel.birth:
        age = dates.age_at(C("birth_date"), C("fecha"))
        out = out.join(births.select("patient_id", "birth_date"), "patient_id", "left").withColumn("age", age) if births is not None else out.withColumn("age", F.lit(None).cast("int"))
    return out


def index_series(points: DataFrame, panel: Panel, births: DataFrame | None = None) -> DataFrame:
    """Long form: (patient_id, fecha, index_key, value_num, ref_low, ref_high, flag), points without a value left out."""
    w = wide(points, panel, births)
    bound = lambda b: (b() if callable(b) else F.lit(b)).cast("double")
    each = [F.struct(F.lit(k).alias("index_key"), i.formula().cast("double").alias("value_num"), bound(i.low).alias("ref_low"), bound(i.high).alias("ref_high")) for k, i in panel.indices.items()]
    out = w.select("patient_id", "fecha", F.explode(F.array(*each)).alias("x")).select("patient_id", "fecha", "x.*").where("value_num IS NOT NULL")
    return out.withColumn("flag", ranges.flag(C("value_num"), C("ref_low"), C("ref_high")))


def latest(points: DataFrame, panel: Panel, births: DataFrame | None = None) -> DataFrame:
    """The pivoted row of each patient's last date that has the panel's needed analytes.

    By presence all of them must be there, whatever their units; by unit one accepted value is enough.
    """
    w = wide(points, panel, births)
    ok = F.coalesce(*[C(a) for a in panel.latest]).isNotNull() if panel.by_unit else F.least(*[F.coalesce(C(f"{a}_there"), F.lit(0)) for a in panel.latest], F.lit(1)) == 1
    n = F.row_number().over(Window.partitionBy("patient_id").orderBy(F.desc("fecha")))
    return w.where(ok).withColumn("__n", n).where("__n = 1").drop("__n")


def discordant(points: DataFrame) -> DataFrame:
    """Patients whose last CRP and ESR disagree: exactly one of them out of its range."""
    s = index_series(points, PANELS["inflammation"])
    last = s.groupBy("patient_id", "index_key").agg(F.max_by(F.struct("flag"), "fecha")["flag"].alias("flag"))
    both = last.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_if(ranges.out_of_range(C("flag"))).alias("out"))
    return both.withColumn("discordant", (C("n") == 2) & (C("out") == 1))
