"""Queries of the rows behind charts and of the panels' latest summaries, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evolution as E
from ..operators import panels
from ..operators import series as S
from ..sources.adapters import BY_PRIORITY, EVENTS_SQL, TOTAL, VARIATION_SQL, orders_series, variation
from .series_queries import _TREND, K, r6
from .store_queries import _panel, _unit

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


_DISTANCE = "CASE WHEN value_num < ref_low THEN (value_num - ref_low) / width WHEN value_num > ref_high THEN (value_num - ref_high) / width ELSE 0 END"
_STATE = "CASE WHEN cvi IS NOT NULL AND previous > 0 AND value_num > 0 THEN CASE WHEN coalesce(previous_lab, '') <> coalesce(lab, '') THEN 'otro_lab' WHEN pct > rcv_up OR pct < rcv_down THEN 'real' ELSE 'esperable' END END"
_MILD = f"coalesce(({_DISTANCE}) <> 0 AND abs({_DISTANCE}) < 0.25, false)"
_CHANGE = "CASE WHEN previous <> 0 THEN (value_num - previous) / previous * 100 END AS pct, (exp(-1.96 * sqrt(2) * sigma) - 1) * 100 AS rcv_down, (exp(1.96 * sqrt(2) * sigma) - 1) * 100 AS rcv_up"


def _evolution(adapter: str) -> str:
    return f"""WITH {adapter}, {VARIATION_SQL},
own AS (SELECT patient_id, canonical_id, count(*) AS n, avg(value_num) AS centre, count(DISTINCT coalesce(lab, '')) > 1 AS mixed FROM s JOIN bv USING (canonical_id) WHERE back > 1 AND cvi IS NOT NULL AND coalesce(flag, 'normal') = 'normal' AND (ref_low IS NOT NULL OR ref_high IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3),
edge AS (SELECT patient_id, canonical_id, min(ref_low) AS lo, max(ref_high) AS hi FROM s GROUP BY ALL),
c AS (SELECT s.*, cvi, cva, {_CHANGE} FROM s LEFT JOIN bv USING (canonical_id)),
v AS (SELECT *, CASE WHEN back = 1 THEN {_STATE} END AS state FROM c),
frame AS (SELECT v.patient_id, v.canonical_id, result_id, fecha, value_num, flag, {_MILD} AS mild, coalesce(ref_low, lo) AS band_low, coalesce(ref_high, hi) AS band_high, coalesce(mixed, false) AS mixed_labs,
  round(CASE WHEN centre IS NOT NULL THEN greatest(0, centre * (1 - 1.96 * sqrt((n + 1) / n) * sqrt(cvi * cvi + cva * cva) / 100)) END, 4) AS personal_low, round(centre * (1 + 1.96 * sqrt((n + 1) / n) * sqrt(cvi * cvi + cva * cva) / 100), 4) AS personal_high,
  state, round(CASE WHEN state <> 'otro_lab' THEN previous * (1 + rcv_down / 100) END, 4) AS expected_low, round(CASE WHEN state <> 'otro_lab' THEN previous * (1 + rcv_up / 100) END, 4) AS expected_high
  FROM v JOIN edge e ON e.patient_id = v.patient_id AND e.canonical_id = v.canonical_id LEFT JOIN own o ON o.patient_id = v.patient_id AND o.canonical_id = v.canonical_id)"""


def _points(spark: SparkSession, sf: str, by_priority: bool) -> DataFrame:
    r4 = [F.round(c, 4).alias(c) for c in ("personal_low", "personal_high", "expected_low", "expected_high")]
    return E.evolution(orders_series(spark, sf, by_priority), variation(spark)).select(*K, "result_id", "fecha", "value_num", "flag", "mild", "band_low", "band_high", "mixed_labs", "state", *r4)


@query(_evolution(TOTAL) + " SELECT * FROM frame")
def evolution_frame(spark: SparkSession, sf: str) -> DataFrame:
    """O1, O7-O9, G25."""
    return _points(spark, sf, False)


@query(_evolution(BY_PRIORITY) + " SELECT *, (canonical_id = '5-LOW')::INT AS panel FROM frame WHERE canonical_id IN ('2-HIGH', '5-LOW')")
def comparison_frame(spark: SparkSession, sf: str) -> DataFrame:
    """O2: of three tests the first two."""
    return E.comparison(_points(spark, sf, True), ["2-HIGH", "5-LOW", "1-URGENT"])


@query(f"""WITH {BY_PRIORITY}, {VARIATION_SQL}, c AS (SELECT s.*, cvi, {_CHANGE} FROM s LEFT JOIN bv USING (canonical_id) WHERE back = 1 AND previous IS NOT NULL AND width > 0 AND value_num <> previous)
SELECT patient_id, canonical_id, round((value_num - previous) / width, 6) AS size, {_STATE} AS state FROM c""")
def changes_rows(spark: SparkSession, sf: str) -> DataFrame:
    """O4."""
    return E.changes_rows(orders_series(spark, sf), variation(spark)).select(*K, *r6("size"), "state")


@query(f"""WITH {BY_PRIORITY}, d AS (SELECT *, coalesce(ref_low, 0) AS base FROM s WHERE back = 1), p AS (SELECT *, (value_num - base) / (ref_high - base) AS x, (previous - base) / (ref_high - base) AS y FROM d WHERE ref_high > base)
SELECT patient_id, canonical_id, round(least(greatest(x, -0.8), 1.8), 6) AS place, CASE WHEN y IS NOT NULL THEN round(least(greatest(y, -0.8), 1.8), 6) END AS previous_place, CASE WHEN x > 1.8 THEN '>' WHEN x < -0.8 THEN '<' ELSE 'o' END AS marker, {_MILD} AS mild FROM p""")
def position_chart(spark: SparkSession, sf: str) -> DataFrame:
    """O5, O8."""
    return E.position_rows(orders_series(spark, sf)).select(*K, *r6("place", "previous_place"), "marker", "mild")


@query(_TREND + ", z AS (SELECT patient_id, min(x) AS x0 FROM x GROUP BY 1) SELECT e.patient_id, canonical_id, k::INT AS corner, d::INT AS day, round(intercept + slope * d, 4) AS value FROM e JOIN z USING (patient_id), LATERAL (VALUES (0, x0), (1, x1), (2, x1 + 90)) AS v(k, d)")
def trend_lines(spark: SparkSession, sf: str) -> DataFrame:
    """O10."""
    return E.trend_lines(S.trend(orders_series(spark, sf, False))).select(*K, "corner", "day", F.round("value", 4).alias("value"))


def _latest(there: str, columns: str, by_unit: bool) -> str:
    """The last date of each patient: one with all the events ``there``, or with any accepted value of them."""
    names = there.split()
    if by_unit:
        dates = f"SELECT patient_id, max(fecha) AS fecha FROM wide WHERE coalesce({', '.join(names)}, NULL) IS NOT NULL GROUP BY 1"
    else:
        have = " AND ".join(f"count(*) FILTER (canonical_id = '{x}') > 0" for x in names)
        dates = f"SELECT patient_id, max(fecha) AS fecha FROM (SELECT patient_id, fecha FROM point GROUP BY ALL HAVING {have}) GROUP BY 1"
    return f"WITH {EVENTS_SQL}, last AS ({dates}) SELECT patient_id, fecha, {columns} FROM wide JOIN last USING (patient_id, fecha)"


def _flag(x: str, low: str, high: str) -> str:
    return f"CASE WHEN ({x}) IS NULL THEN NULL WHEN ({x}) < {low} THEN 'bajo' WHEN ({x}) > {high} THEN 'alto' ELSE 'normal' END"


_LDL = "coalesce(purchase, CASE WHEN signup < 400 THEN view - click - signup / 5 END)"


@query(_latest("view click", f"""view AS total, click AS hdl, round({_LDL}, 6) AS ldl, signup AS tg, purchase IS NULL AND ({_LDL}) IS NOT NULL AS ldl_estimated, {_flag('view', 'NULL', '200')} AS total_flag, {_flag('click', '40', 'NULL')} AS hdl_flag, {_flag(_LDL, 'NULL', '130')} AS ldl_flag, {_flag('signup', 'NULL', '150')} AS tg_flag,
round(view / nullif(click, 0), 6) AS castelli_1, round({_LDL} / nullif(click, 0), 6) AS castelli_2, round(signup / nullif(click, 0), 6) AS tg_hdl""", False))
def lipid_latest(spark: SparkSession, sf: str) -> DataFrame:
    """H4."""
    p = E.lipid_summary(_panel(spark, sf, {"view": "total", "click": "hdl", "purchase": "ldl", "signup": "tg"}))
    return p.select("patient_id", "fecha", "total", "hdl", *r6("ldl"), "tg", "ldl_estimated", "total_flag", "hdl_flag", "ldl_flag", "tg_flag", *r6("castelli_1", "castelli_2", "tg_hdl"))


@query(_latest("view click", "view AS ast, click AS alt, purchase AS platelets", False))
def hepatic_latest(spark: SparkSession, sf: str) -> DataFrame:
    """H7."""
    p = _unit(_panel(spark, sf, {"view": "ast", "click": "alt", "purchase": "platelets"}), ast="U/L", alt="UI/L 37C", platelets="x10^9/L")
    births = p.select("patient_id").distinct().withColumn("birth_date", F.lit("1960-01-15"))
    return panels.latest(p, panels.PANELS["hepatic"], births).select("patient_id", "fecha", "ast", "alt", "platelets")


@query(_latest("signup", "view AS neutrophils, click AS lymphocytes, signup AS mcv, error AS red_cells", True))
def hemogram_latest(spark: SparkSession, sf: str) -> DataFrame:
    """H14."""
    p = _unit(_panel(spark, sf, {"view": "neutrophils", "click": "lymphocytes", "signup": "mcv", "error": "red_cells"}), neutrophils="x10^9/L", lymphocytes="x10^9/L", mcv="fL", red_cells="x10^12/L")
    return panels.latest(p, panels.PANELS["hemogram"]).select("patient_id", "fecha", "neutrophils", "lymphocytes", "mcv", "red_cells")


_TSAT = "coalesce(signup, view / nullif(purchase * 1.42, 0) * 100)"


@query(_latest("view click purchase signup", f"view AS iron, click AS ferritin, purchase AS transferrin, round({_TSAT}, 6) AS tsat, signup IS NULL AND ({_TSAT}) IS NOT NULL AS tsat_estimated, {_flag('click', '15', 'NULL')} AS ferritin_flag, {_flag(_TSAT, '20', '50')} AS tsat_flag", True))
def iron_latest(spark: SparkSession, sf: str) -> DataFrame:
    """H17."""
    p = _unit(_panel(spark, sf, {"view": "iron", "click": "ferritin", "purchase": "transferrin", "signup": "tsat"}), iron="µg/dL", ferritin="ng/mL", tsat="%")
    return E.iron_summary(p).select("patient_id", "fecha", "iron", "ferritin", "transferrin", *r6("tsat"), "tsat_estimated", "ferritin_flag", "tsat_flag")


@query(_latest("view", "view AS hba1c, click AS glucose, round(28.7 * view - 46.7, 6) AS eag", True))
def glycemic_latest(spark: SparkSession, sf: str) -> DataFrame:
    """H19."""
    from ..functions import indices

    p = _unit(_panel(spark, sf, {"view": "hba1c", "click": "glucose"}), hba1c="%")
    return panels.latest(p, panels.PANELS["glycemic"]).select("patient_id", "fecha", "hba1c", "glucose", F.round(indices.eag(F.col("hba1c")), 6).alias("eag"))
