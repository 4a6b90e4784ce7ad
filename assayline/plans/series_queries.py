"""Series queries over the order and event adapters, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, indices, ranges
from ..operators import series as S
from ..sources.adapters import BY_PRIORITY, ONE_LAB, TOTAL, VARIATION_SQL, events_panel, orders_series, read, variation

QUERIES, SQL = {}, {}
K = ["patient_id", "canonical_id"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def rsql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


@query(f"WITH {BY_PRIORITY} SELECT patient_id, canonical_id, result_id, fecha, flag FROM s")
def flag_basic(spark: SparkSession, sf: str) -> DataFrame:
    """C5."""
    return S.flagged(orders_series(spark, sf)).select(*K, "result_id", "fecha", "flag")


@query("""SELECT l_orderkey AS report_id, l_linenumber AS line, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') END, strftime(l_shipdate, '%Y-%m-%d') || ' 08:00:00') AS fecha FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def effective_date_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """C1, D1j: the sample's date first, then the request's, then the validation's."""
    li, o = read(spark, sf, "lineitem"), read(spark, sf, "orders")
    d = lambda c: F.date_format(c, "yyyy-MM-dd")
    fecha = dates.effective(F.when(F.col("l_linenumber") % 3 == 0, d("l_shipdate")), F.when(F.col("o_orderstatus") != "P", d("o_orderdate")), F.concat(d("l_shipdate"), F.lit(" 08:00:00")))
    return li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("line"), fecha.alias("fecha"))


def _tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = orders_series(spark, sf).drop("report_id")
    results = o.select(F.col("result_id").alias("id"), F.col("result_id").alias("report_id"), "canonical_id", "raw_name", F.when(F.col("result_id") % 11 != 0, F.col("value_num")).alias("value_num"), "unit", "ref_low", "ref_high", F.lit(None).cast("string").alias("flag_calc"), F.lit(None).cast("string").alias("sample_date"))
    reports = o.select(F.col("result_id").alias("id"), "patient_id", F.when(F.col("result_id") % 13 != 0, F.col("fecha")).alias("request_date"), F.when(F.col("result_id") % 26 != 0, F.col("fecha")).alias("validation_date"), "lab")
    return results, reports


@query(f"WITH {BY_PRIORITY} SELECT patient_id, canonical_id, result_id, fecha, value_num, lab FROM s WHERE coalesce(lab, '') NOT IN ('B', '') AND result_id % 11 <> 0 AND (result_id % 13 <> 0 OR result_id % 26 <> 0)")
def lab_filter_anti(spark: SparkSession, sf: str) -> DataFrame:
    """C2, C4, D7j: series without two labs, one of them the unknown one."""
    out = spark.createDataFrame([("B",), (None,)], "lab string")
    return S.series(*_tables(spark, sf), out).select(*K, "result_id", "fecha", "value_num", "lab")


@query(f"WITH {BY_PRIORITY} SELECT patient_id, canonical_id, result_id, ord, value_num FROM s")
def series_ordered(spark: SparkSession, sf: str) -> DataFrame:
    """Total order by date, then id."""
    return S.with_previous(orders_series(spark, sf)).select(*K, "result_id", F.col("ord").cast("long").alias("ord"), "value_num")


@query(f"""WITH {BY_PRIORITY}, ids(analyte, canonical_id, priority) AS (VALUES ('fast', '1-URGENT', 1), ('fast', '2-HIGH', 2), ('slow', '3-MEDIUM', 1), ('slow', '5-LOW', 2), ('slow', '4-NOT SPECIFIED', 3)),
m AS (SELECT s.*, analyte, row_number() OVER (PARTITION BY patient_id, analyte, fecha ORDER BY priority, result_id) AS n FROM s JOIN ids USING (canonical_id))
SELECT patient_id, analyte, fecha, canonical_id, value_num FROM m WHERE n = 1""")
def merged_series_priority(spark: SparkSession, sf: str) -> DataFrame:
    """One point per date, the first id wins."""
    ids = spark.createDataFrame([("fast", "1-URGENT", 1), ("fast", "2-HIGH", 2), ("slow", "3-MEDIUM", 1), ("slow", "5-LOW", 2), ("slow", "4-NOT SPECIFIED", 3)], "analyte string, canonical_id string, priority int")
    return S.merged(orders_series(spark, sf), ids).select("patient_id", "analyte", "fecha", "canonical_id", "value_num")


@query(f"WITH {BY_PRIORITY}, l AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY fecha DESC, report_id DESC) AS n FROM s) SELECT patient_id, report_id, fecha FROM l WHERE n = 1")
def latest_report(spark: SparkSession, sf: str) -> DataFrame:
    """G2."""
    return S.latest_report(orders_series(spark, sf))


_LATEST = f"""WITH {BY_PRIORITY}, p AS (SELECT *, CASE WHEN previous <> 0 THEN (value_num - previous) / previous * 100 END AS pct_change FROM s WHERE back = 1)
SELECT patient_id, canonical_id, fecha, value_num, flag, previous, round(pct_change, 6) AS pct_change, coalesce(abs(pct_change) >= 30, false) AS abrupt,
CASE WHEN coalesce(flag IN ('alto', 'bajo'), false) THEN 0 WHEN coalesce(abs(pct_change) >= 30, false) THEN 1 ELSE 2 END AS priority FROM p"""


@query(_LATEST)
def latest_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship."""
    return S.latest(orders_series(spark, sf)).select(*K, "fecha", "value_num", "flag", "previous", *r6("pct_change"), "abrupt", "priority")


@query(f"""WITH {BY_PRIORITY}, l AS (SELECT patient_id, report_id, row_number() OVER (PARTITION BY patient_id ORDER BY fecha DESC, report_id DESC) AS n FROM s),
b AS (SELECT patient_id, canonical_id, value_num AS previous FROM s WHERE back = 2)
SELECT s.patient_id, s.report_id, s.canonical_id, s.value_num, s.flag, b.previous FROM s JOIN l ON l.report_id = s.report_id AND l.patient_id = s.patient_id AND n = 1 LEFT JOIN b ON b.patient_id = s.patient_id AND b.canonical_id = s.canonical_id""")
def latest_summary_with_previous(spark: SparkSession, sf: str) -> DataFrame:
    """All results of the last report, each with its series' second-last value."""
    return S.latest_report_summary(orders_series(spark, sf)).select("patient_id", "report_id", "canonical_id", "value_num", "flag", "previous")


@query(f"""WITH {BY_PRIORITY}, {VARIATION_SQL}, p AS (SELECT s.*, cvi, sigma, CASE WHEN previous <> 0 THEN (value_num - previous) / previous * 100 END AS pct, (exp(-1.96 * sqrt(2) * sigma) - 1) * 100 AS rcv_down, (exp(1.96 * sqrt(2) * sigma) - 1) * 100 AS rcv_up FROM s LEFT JOIN bv USING (canonical_id) WHERE back = 1)
SELECT patient_id, canonical_id, {rsql('pct', 'rcv_down', 'rcv_up')}, CASE WHEN cvi IS NOT NULL AND previous > 0 AND value_num > 0 THEN CASE WHEN coalesce(previous_lab, '') <> coalesce(lab, '') THEN 'otro_lab' WHEN pct > rcv_up OR pct < rcv_down THEN 'real' ELSE 'esperable' END END AS state FROM p""")
def rcv_classify(spark: SparkSession, sf: str) -> DataFrame:
    """G8, H26, H27."""
    return S.changes(orders_series(spark, sf), variation(spark)).select(*K, *r6("pct", "rcv_down", "rcv_up"), "state")


@query(f"WITH {VARIATION_SQL} SELECT canonical_id, round((exp(-1.96 * sqrt(2) * sigma) - 1) * 100, 6) AS rcv_down, round((exp(1.96 * sqrt(2) * sigma) - 1) * 100, 6) AS rcv_up FROM bv")
def rcv_limits_table(spark: SparkSession, sf: str) -> DataFrame:
    """H26."""
    v = variation(spark).withColumn("c", indices.cvi_for(F.lit(None).cast("string"), F.col("cvi"), F.col("cvi_f"), F.col("cvi_m")))
    return v.select("canonical_id", F.round(indices.rcv_down(F.col("c"), F.col("cva")), 6).alias("rcv_down"), F.round(indices.rcv_up(F.col("c"), F.col("cva")), 6).alias("rcv_up"))


@query(f"""WITH {TOTAL}, {VARIATION_SQL}, g AS (SELECT patient_id, canonical_id, count(*) AS n, count(DISTINCT coalesce(lab, '')) AS labs, avg(value_num) AS centre FROM s WHERE back > 1 AND coalesce(flag, 'normal') = 'normal' AND (ref_low IS NOT NULL OR ref_high IS NOT NULL) GROUP BY ALL HAVING count(*) >= 3),
h AS (SELECT g.*, 1.96 * sqrt((n + 1) / n) * sqrt(cvi * cvi + cva * cva) AS half FROM g JOIN bv USING (canonical_id))
SELECT patient_id, canonical_id, n, labs, round(centre, 6) AS centre, round(greatest(0, centre * (1 - half / 100)), 4) AS low, round(centre * (1 + half / 100), 4) AS high FROM h""")
def personal_range(spark: SparkSession, sf: str) -> DataFrame:
    """G10."""
    return S.personal_range(orders_series(spark, sf, False), variation(spark)).select(*K, "n", "labs", *r6("centre"), *[F.round(c, 4).alias(c) for c in ("low", "high")])


@query(f"""WITH {ONE_LAB}, {VARIATION_SQL}, o AS (SELECT s.*, sigma, row_number() OVER (PARTITION BY patient_id ORDER BY fecha, result_id) AS i, (flag = 'normal') AS steady FROM s JOIN bv USING (canonical_id) WHERE value_num > 0),
k AS (SELECT *, sum(steady::INT) OVER (PARTITION BY patient_id ORDER BY i) AS k FROM o),
c AS (SELECT *, avg(value_num) FILTER (steady AND k <= 4) OVER (PARTITION BY patient_id) AS centre, count(*) FILTER (steady AND k <= 4) OVER (PARTITION BY patient_id) AS nb, max(i) FILTER (steady AND k <= 4) OVER (PARTITION BY patient_id) AS fin FROM k),
z AS (SELECT *, (ln(value_num) - ln(centre)) / sigma AS z, count(*) OVER (PARTITION BY patient_id) AS nm FROM c WHERE nb = 4 AND i > fin),
a AS (SELECT *, sum(z - 0.5) OVER (PARTITION BY patient_id ORDER BY i) AS cu, sum(-z - 0.5) OVER (PARTITION BY patient_id ORDER BY i) AS cd FROM z WHERE nm >= 3),
b AS (SELECT *, cu - least(0, min(cu) OVER (PARTITION BY patient_id ORDER BY i)) AS su, cd - least(0, min(cd) OVER (PARTITION BY patient_id ORDER BY i)) AS sd FROM a),
q AS (SELECT *, coalesce(max(i) FILTER (su <= 0) OVER (PARTITION BY patient_id), 0) AS zu, coalesce(max(i) FILTER (sd <= 0) OVER (PARTITION BY patient_id), 0) AS zd FROM b),
f AS (SELECT patient_id, canonical_id, count(*) AS n, max(centre) AS centre, arg_max(su, i) AS s_up, arg_max(sd, i) AS s_down, min(fecha) FILTER (i > zu) AS fu, min(fecha) FILTER (i > zd) AS fd FROM q GROUP BY ALL)
SELECT patient_id, canonical_id, n, {rsql('centre', 's_up', 's_down')}, CASE WHEN s_up > 5 THEN 'sube' WHEN s_down > 5 THEN 'baja' END AS direction, CASE WHEN s_up > 5 THEN fu WHEN s_down > 5 THEN fd END AS since FROM f""")
def cusum_drift(spark: SparkSession, sf: str) -> DataFrame:
    """G11, G12."""
    return S.drift(orders_series(spark, sf, False, True), variation(spark)).select(*K, "n", *r6("centre", "s_up", "s_down"), "direction", "since")


@query(f"WITH {TOTAL}, l AS (SELECT patient_id, arg_max(lab, ord) AS x, arg_max(CASE WHEN lab IS NULL THEN 1 ELSE 0 END, ord) AS u FROM s GROUP BY 1), o AS (SELECT s.patient_id, coalesce(max(ord) FILTER (coalesce(lab, '') <> CASE WHEN u = 1 THEN '' ELSE x END), 0) AS cut FROM s JOIN l USING (patient_id) GROUP BY 1) SELECT s.patient_id, count(*) AS n, min(fecha) AS since FROM s JOIN o USING (patient_id) WHERE ord > cut GROUP BY 1")
def same_lab_run(spark: SparkSession, sf: str) -> DataFrame:
    """G12."""
    return S.same_lab_run(orders_series(spark, sf, False)).groupBy("patient_id").agg(F.count("*").alias("n"), F.min("fecha").alias("since"))


_TREND = f"""WITH {TOTAL}, x AS (SELECT patient_id, canonical_id, date_diff('day', DATE '1970-01-01', fecha::DATE) AS x, value_num AS y, ord, back, ref_low, ref_high FROM s),
p AS (SELECT a.patient_id, list_sort(list((b.y - a.y) / (b.x - a.x))) AS sl FROM x a JOIN x b ON a.patient_id = b.patient_id AND a.x < b.x GROUP BY 1),
w AS (SELECT patient_id, canonical_id, count(*) AS n, median(x) AS mx, median(y) AS my, max(x) - min(x) AS days, max(x) AS x1, max(y) - min(y) AS spread, arg_max(y, ord) AS last, max(ref_low) FILTER (back = 1) AS ref_low, max(ref_high) FILTER (back = 1) AS ref_high FROM x GROUP BY ALL HAVING count(*) >= 3),
t AS (SELECT w.*, len(sl) AS m, sl, list_aggregate(sl, 'median') AS slope, 1.959964 * sqrt(n * (n - 1) * (2 * n + 5) / 18.0) AS c FROM w JOIN p USING (patient_id)),
e AS (SELECT *, sl[greatest(round_even((m - c) / 2, 0)::INT - 1, 0) + 1] AS slope_low, sl[least(round_even((m + c) / 2, 0)::INT, m - 1) + 1] AS slope_high, my - slope * mx AS intercept FROM t)"""


@query(_TREND + f" SELECT patient_id, canonical_id, n, {rsql('slope', 'slope_low', 'slope_high', 'intercept')} FROM e")
def theil_sen_trend(spark: SparkSession, sf: str) -> DataFrame:
    """G13."""
    return S.trend(orders_series(spark, sf, False)).select(*K, "n", *r6("slope", "slope_low", "slope_high", "intercept"))


@query(_TREND + """, d AS (SELECT *, CASE WHEN ref_high > ref_low THEN ref_high - ref_low WHEN spread <> 0 THEN spread WHEN last <> 0 THEN abs(last) ELSE 1 END AS span FROM e),
g AS (SELECT *, CASE WHEN n < 5 OR days < 730 THEN 'pocos_datos' WHEN slope_low <= 0 AND slope_high >= 0 THEN 'sin_tendencia' WHEN abs(slope * days) < 0.05 * span THEN 'estable' WHEN slope * days > 0 THEN 'subiendo' ELSE 'bajando' END AS direction FROM d)
SELECT patient_id, direction, round(slope * 365.25 / span, 6) AS yearly_spans, round(intercept + slope * (x1 + 90), 4) AS projected_90, (slope * 365.25 < -5 AND slope_high < 0 AND direction = 'bajando') AS rapid_decline FROM g""")
def trend_direction(spark: SparkSession, sf: str) -> DataFrame:
    """G14, G15."""
    return S.trend_direction(S.trend(orders_series(spark, sf, False))).select("patient_id", "direction", *r6("yearly_spans"), F.round("projected_90", 4).alias("projected_90"), "rapid_decline")


_NORM = """CASE WHEN {v}ref_high > {v}ref_low THEN 'both' WHEN {v}ref_high <> 0 THEN 'upper' WHEN {v}ref_low <> 0 THEN 'lower' END"""


@query(f"""WITH {TOTAL}, n AS (SELECT *, {_NORM.format(v='')} AS kind, CASE WHEN ref_high > ref_low THEN (value_num - ref_low) / (ref_high - ref_low) WHEN ref_high <> 0 THEN value_num / ref_high WHEN ref_low <> 0 THEN value_num / ref_low END AS v FROM s),
q AS (SELECT patient_id, canonical_id, kind, v AS p0, lead(v) OVER w AS p1, lead(kind) OVER w AS k1, date_diff('day', fecha::DATE, lead(fecha) OVER w::DATE) AS d, CASE kind WHEN 'both' THEN 0 WHEN 'upper' THEN -1e12 ELSE 1 END AS a, CASE kind WHEN 'lower' THEN 1e12 ELSE 1 END AS b FROM n WINDOW w AS (PARTITION BY patient_id, canonical_id ORDER BY fecha, result_id)),
f AS (SELECT *, CASE WHEN p0 = p1 THEN CASE WHEN p0 >= a AND p0 <= b THEN 1.0 ELSE 0.0 END ELSE greatest(0.0, least(1.0, greatest((a - p0) / nullif(p1 - p0, 0), (b - p0) / nullif(p1 - p0, 0))) - greatest(0.0, least((a - p0) / nullif(p1 - p0, 0), (b - p0) / nullif(p1 - p0, 0)))) END AS fr, (d > 0 AND d <= 365 AND kind = k1) AS used FROM q),
g AS (SELECT patient_id, canonical_id, sum(d * fr) FILTER (used) AS i, sum(d) FILTER (used) AS days, count(*) FILTER (d > 365) AS gaps FROM f GROUP BY ALL)
SELECT patient_id, canonical_id, days::BIGINT AS days, gaps, round(i / days * 100, 6) AS percent_in_range FROM g WHERE days >= 365""")
def time_in_range(spark: SparkSession, sf: str) -> DataFrame:
    """G16, G17."""
    return S.time_in_range(orders_series(spark, sf, False)).select(*K, "days", "gaps", *r6("percent_in_range"))


_DIST = "CASE WHEN width IS NULL THEN NULL WHEN {v} < ref_low THEN -(ref_low - {v}) / width WHEN {v} > ref_high THEN ({v} - ref_high) / width ELSE 0 END"


@query(f"""WITH {BY_PRIORITY}, d AS (SELECT *, {_DIST.format(v='value_num')} AS distance FROM s)
SELECT patient_id, result_id, {rsql('width', 'distance')}, round(CASE WHEN distance = 0 THEN 0 WHEN distance < 0 THEN -(0.3 + 0.7 * least(abs(distance) / 0.5, 1)) ELSE 0.3 + 0.7 * least(abs(distance) / 0.5, 1) END, 6) AS position FROM d""")
def range_distance(spark: SparkSession, sf: str) -> DataFrame:
    """G18."""
    v, lo, hi = F.col("value_num"), F.col("ref_low"), F.col("ref_high")
    return orders_series(spark, sf).select("patient_id", "result_id", F.round(ranges.width(lo, hi), 6).alias("width"), F.round(ranges.distance(v, lo, hi), 6).alias("distance"), F.round(ranges.position(v, lo, hi), 6).alias("position"))


@query(f"""WITH {BY_PRIORITY}, d AS (SELECT *, {_DIST.format(v='value_num')} AS distance FROM s)
SELECT patient_id, result_id, CASE WHEN distance = 0 THEN 'dentro del rango' WHEN abs(distance) < 0.25 THEN 'ligeramente ' || CASE WHEN distance > 0 THEN 'alto' ELSE 'bajo' END WHEN abs(distance) >= 1 THEN 'muy ' || CASE WHEN distance > 0 THEN 'alto' ELSE 'bajo' END WHEN distance > 0 THEN 'alto' WHEN distance < 0 THEN 'bajo' END AS label FROM d""")
def deviation_label(spark: SparkSession, sf: str) -> DataFrame:
    """G18."""
    return orders_series(spark, sf).select("patient_id", "result_id", ranges.deviation_label(ranges.distance(F.col("value_num"), F.col("ref_low"), F.col("ref_high"))).alias("label"))


@query(f"""WITH {BY_PRIORITY}, d AS (SELECT *, abs({_DIST.format(v='value_num')}) AS da, abs({_DIST.format(v='previous')}) AS db, (value_num - previous) / width AS size FROM s WHERE back = 1 AND previous IS NOT NULL)
SELECT patient_id, canonical_id, {rsql('size')}, CASE WHEN da > db + 0.01 THEN 'empeora' WHEN da < db - 0.01 THEN 'mejora' ELSE 'igual' END AS status FROM d WHERE size <> 0""")
def change_status(spark: SparkSession, sf: str) -> DataFrame:
    """G19, G20."""
    return S.ranked_changes(orders_series(spark, sf)).select(*K, *r6("size"), "status")


@query(f"""WITH {TOTAL}, t AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 100000.0 END AS lo, CASE WHEN c_custkey % 3 = 0 THEN 300000.0 END AS hi FROM customer WHERE c_custkey % 5 = 0),
x AS (SELECT s.*, CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN lo ELSE ref_low END AS l2, CASE WHEN lo IS NOT NULL OR hi IS NOT NULL THEN hi ELSE ref_high END AS h2 FROM s LEFT JOIN t ON c_custkey = patient_id)
SELECT patient_id, result_id, l2 AS ref_low, h2 AS ref_high, CASE WHEN l2 IS NULL AND h2 IS NULL THEN NULL WHEN value_num < l2 THEN 'bajo' WHEN value_num > h2 THEN 'alto' ELSE 'normal' END AS flag FROM x""")
def target_override(spark: SparkSession, sf: str) -> DataFrame:
    """C6."""
    c = F.col("c_custkey")
    t = read(spark, sf, "customer").where(c % 5 == 0).select(c.alias("patient_id"), F.lit("order_total").alias("canonical_id"), F.when(c % 2 == 0, 100000.0).alias("target_low"), F.when(c % 3 == 0, 300000.0).alias("target_high"))
    return S.with_targets(orders_series(spark, sf, False), t).select("patient_id", "result_id", "ref_low", "ref_high", "flag")


@query(f"WITH {TOTAL}, l AS (SELECT *, max(fecha) OVER (PARTITION BY patient_id) AS m FROM s) SELECT patient_id, result_id, fecha FROM l WHERE fecha >= (left(m, 4)::INT - 5)::VARCHAR || substr(m, 5)")
def five_year_window(spark: SparkSession, sf: str) -> DataFrame:
    """C7."""
    return S.last_five_years(orders_series(spark, sf, False)).select("patient_id", "result_id", "fecha")


@query(f"WITH {BY_PRIORITY} SELECT patient_id, canonical_id, count(*) AS n, CASE count(*) WHEN 1 THEN 'un_punto' WHEN 2 THEN 'pocos' WHEN 3 THEN 'pocos' ELSE 'suficiente' END AS state FROM s GROUP BY ALL")
def data_sufficiency(spark: SparkSession, sf: str) -> DataFrame:
    """C8, C10."""
    return S.sufficiency(orders_series(spark, sf))


@query(f"WITH {BY_PRIORITY} SELECT patient_id, canonical_id, count(*) AS n, count(*) FILTER (flag = 'normal') AS n_normal, count(*) FILTER (flag = 'alto') AS n_high, count(*) FILTER (flag = 'bajo') AS n_low, arg_max(value_num, ord) AS last, max(fecha) AS last_fecha FROM s GROUP BY ALL")
def series_summary_counts(spark: SparkSession, sf: str) -> DataFrame:
    """F15."""
    return S.summary(orders_series(spark, sf)).drop("last_flag")


@query(f"WITH {BY_PRIORITY}, f AS (SELECT *, first_value(value_num) OVER (PARTITION BY patient_id, canonical_id ORDER BY ord) AS v0 FROM s) SELECT patient_id, canonical_id, round((value_num - previous) / nullif(previous, 0) * 100, 6) AS pct_last, round((value_num - v0) / nullif(v0, 0) * 100, 6) AS pct_whole FROM f WHERE back = 1 AND ord > 1")
def pct_change_whole(spark: SparkSession, sf: str) -> DataFrame:
    """G6."""
    return S.whole_period_change(orders_series(spark, sf)).select(*K, *r6("pct_last", "pct_whole"))


@query(f"""WITH {BY_PRIORITY}, d AS (SELECT *, coalesce(ref_low, 0) AS base, {_DIST.format(v='value_num')} AS distance FROM s WHERE back = 1)
SELECT patient_id, canonical_id, {rsql('distance')}, round((value_num - base) / (ref_high - base), 6) AS place FROM d WHERE ref_high > base""")
def position_rows(spark: SparkSession, sf: str) -> DataFrame:
    """G21."""
    return S.bullet_rows(orders_series(spark, sf)).select(*K, *r6("distance", "place"))


_HEAT = """WITH h AS (SELECT user_id AS patient_id, event_type AS canonical_id, strftime(ts, '%Y-%m-%d') AS day, arg_max(value, event_id) AS value_num FROM events GROUP BY ALL),
p AS (SELECT *, CASE WHEN value_num < 5 THEN -(5 - value_num) / 85 WHEN value_num > 90 THEN (value_num - 90) / 85 ELSE 0 END AS d FROM h),
q AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN d < 0 THEN -(0.3 + 0.7 * least(abs(d) / 0.5, 1)) ELSE 0.3 + 0.7 * least(abs(d) / 0.5, 1) END AS position FROM p)"""


@query(_HEAT + " SELECT patient_id, canonical_id, day, value_num, round(position, 6) AS position FROM q")
def heatmap_cells(spark: SparkSession, sf: str) -> DataFrame:
    """G22."""
    return S.heatmap(events_panel(spark, sf)).select(*K, "day", "value_num", *r6("position"))


@query(_HEAT + """, n AS (SELECT patient_id, count(DISTINCT day) AS days FROM q GROUP BY 1),
hi AS (SELECT patient_id, canonical_id, day, row_number() OVER (PARTITION BY patient_id, canonical_id ORDER BY value_num DESC, day) AS k FROM q WHERE position > 0),
lo AS (SELECT patient_id, canonical_id, day, row_number() OVER (PARTITION BY patient_id, canonical_id ORDER BY value_num, day) AS k FROM q WHERE position < 0),
best AS (SELECT patient_id, canonical_id, day FROM hi WHERE k = 1 UNION SELECT patient_id, canonical_id, day FROM lo WHERE k = 1)
SELECT q.patient_id, q.canonical_id, q.day, coalesce(position <> 0 AND (days <= 8 OR best.day IS NOT NULL), false) AS written
FROM q JOIN n ON n.patient_id = q.patient_id LEFT JOIN best ON best.patient_id = q.patient_id AND best.canonical_id = q.canonical_id AND best.day = q.day""")
def heatmap_labels(spark: SparkSession, sf: str) -> DataFrame:
    """G23, with eight columns."""
    return S.heatmap_labels(S.heatmap(events_panel(spark, sf)), 8).select(*K, "day", "written")


@query(f"WITH {TOTAL}, f AS (SELECT patient_id, coalesce(lab, '') AS lab, min(ord) AS o FROM s GROUP BY ALL) SELECT patient_id, lab, row_number() OVER (PARTITION BY patient_id ORDER BY o) AS place FROM f")
def labs_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    """G24."""
    return S.labs_in_order(orders_series(spark, sf, False)).select("patient_id", "lab", F.col("place").cast("long").alias("place"))


@query(f"WITH {TOTAL} SELECT patient_id, count(DISTINCT fecha) AS n_dates, min(fecha) AS first, arg_max(value_num, ord) AS last FROM s WHERE value_num > 300000 GROUP BY 1 HAVING count(DISTINCT fecha) >= 2")
def sustained_high_alert(spark: SparkSession, sf: str) -> DataFrame:
    """F17, H15."""
    return S.sustained(orders_series(spark, sf, False), 300000).select("patient_id", F.size("dates").cast("long").alias("n_dates"), F.get("dates", F.lit(0)).alias("first"), "last")


@query(f"""WITH {TOTAL}, d AS (SELECT *, date_diff('day', DATE '1970-01-01', fecha::DATE) AS x FROM s), m AS (SELECT patient_id, result_id, value_num, median(value_num) OVER (PARTITION BY patient_id ORDER BY x RANGE BETWEEN 365 PRECEDING AND 8 PRECEDING) AS base FROM d)
SELECT patient_id, result_id, {rsql('base')}, round(value_num / nullif(base, 0), 6) AS ratio FROM m""")
def aki_rolling_median(spark: SparkSession, sf: str) -> DataFrame:
    """G9, H10, D10j."""
    return S.rolling_ratio(orders_series(spark, sf, False)).select("patient_id", "result_id", *r6("base", "ratio"))


@query(f"WITH {TOTAL} SELECT patient_id, result_id, coalesce(ref_low, min(ref_low) OVER w) AS band_low, coalesce(ref_high, max(ref_high) OVER w) AS band_high FROM s WINDOW w AS (PARTITION BY patient_id)")
def filled_band(spark: SparkSession, sf: str) -> DataFrame:
    """G26."""
    return S.filled_band(orders_series(spark, sf, False)).select("patient_id", "result_id", "band_low", "band_high")
