"""The panels' analytes as a dimension, and rules by sex and by span, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, panels, pressure
from ..operators import series as S
from ..sources.adapters import read

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


_IDS = [i for _, _, _, ids in panels.ANALYTES for i in ids]
_KEYS = sorted(set(_IDS)) + ["altra_a", "altra_b", "altra_c"]
_ROWS = ", ".join(f"('{p}', '{a}', '{label}', {place}, '{i}', {k})" for place, (p, a, label, ids) in enumerate(panels.ANALYTES) for k, i in enumerate(ids))
_NO = "l_orderkey * 100000000 + l_partkey * 1000 + l_quantity::BIGINT * 10 + l_linenumber"


@query(f"""WITH k AS (SELECT {_KEYS!r} AS keys), d(panel, analyte, label, place, canonical_id, priority) AS (VALUES {_ROWS}), s AS (SELECT l_suppkey % 40 AS patient_id, keys[(l_partkey % {len(_KEYS)} + 1)::INT] AS canonical_id, strftime(l_shipdate, '%Y-%m') AS fecha, {_NO} AS result_id, l_quantity AS value_num FROM lineitem, k),
r AS (SELECT *, row_number() OVER (PARTITION BY patient_id, panel, analyte, fecha ORDER BY priority, result_id) AS n FROM s JOIN d USING (canonical_id))
SELECT patient_id, panel, label, place, fecha, canonical_id, value_num FROM r WHERE n = 1""")
def panel_heatmap_rows(spark: SparkSession, sf: str) -> DataFrame:
    """§2.P, C18: rows of a panel's heat map; of an analyte's ids the first in the panel's order gives a date's point."""
    no = F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_quantity").cast("long") * 10 + F.col("l_linenumber")
    key = F.element_at(F.array(*map(F.lit, _KEYS)), (F.col("l_partkey") % len(_KEYS) + 1).cast("int"))
    s = read(spark, sf, "lineitem").select((F.col("l_suppkey") % 40).alias("patient_id"), key.alias("canonical_id"), F.date_format("l_shipdate", "yyyy-MM").alias("fecha"), no.alias("result_id"), F.col("l_quantity").alias("value_num"))
    return panels.heatmap_rows(s, panels.analyte_table(spark)).select("patient_id", "panel", "label", "place", "fecha", "canonical_id", "value_num")


@query(f"""WITH k AS (SELECT {sorted(set(_IDS))!r} AS ids), r AS (SELECT l_partkey % 20 AS i, CASE WHEN l_returnflag = 'A' THEN ids[(l_partkey % 20 + 1)::INT] ELSE 'variant_' || l_partkey % 20 END AS canonical_id, l_returnflag FROM lineitem, k),
g AS (SELECT i, min(canonical_id) AS root, min(canonical_id) FILTER (l_returnflag = 'A') AS target, count(DISTINCT canonical_id) AS n FROM r GROUP BY 1) SELECT root, target FROM g WHERE n = 2""")
def panel_merge_targets(spark: SparkSession, sf: str) -> DataFrame:
    """M4: of ids that look alike the one that a panel uses is the target, though it has fewer results."""
    i = F.col("l_partkey") % 20
    key = F.when(F.col("l_returnflag") == "A", F.element_at(F.array(*map(F.lit, sorted(set(_IDS)))), (i + 1).cast("int"))).otherwise(F.concat(F.lit("variant_"), i))
    r = read(spark, sf, "lineitem").select(F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag").alias("report_id"), key.alias("canonical_id"), F.concat(F.lit("Prova "), i).alias("raw_name"), F.lit("mg/dL").alias("unit"), F.lit("A").alias("lab"), F.concat(F.lit("code"), i).alias("loinc_code"))
    return audit.proposals(audit.groups(r), r, preferred=tuple(panels.panel_ids())).select("root", "target")


@query("""SELECT o_orderkey AS result_id, CASE o_orderkey % 3 WHEN 0 THEN 4.0 WHEN 1 THEN CASE o_custkey % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 6.0 ELSE 6.0 END ELSE CASE o_custkey % 3 WHEN 0 THEN 7.5 ELSE 7.5 END END::DOUBLE AS cvi FROM orders""")
def variation_by_sex(spark: SparkSession, sf: str) -> DataFrame:
    """The common variation, else that of the patient's sex, else the larger known one."""
    o, k = read(spark, sf, "orders"), F.col("o_orderkey")
    s = o.select(F.col("o_custkey").alias("patient_id"), F.concat(F.lit("t"), k % 3).alias("canonical_id"), k.alias("result_id"))
    variation = o.select(k.alias("k")).where("k < 3").select(F.concat(F.lit("t"), "k").alias("canonical_id"), F.when(F.col("k") == 0, 4.0).alias("cvi"), F.when(F.col("k") == 1, 5.0).when(F.col("k") == 2, 7.5).alias("cvi_f"), F.when(F.col("k") == 1, 6.0).alias("cvi_m"), F.lit(1.0).alias("cva"))
    c = read(spark, sf, "customer")
    patients = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "Mujer").when(F.col("c_custkey") % 3 == 1, "Hombre").alias("sex"))
    return S.with_variation(s, variation, patients).select("result_id", "cvi")


@query("""WITH b AS (SELECT user_id AS patient_id, DATE '2024-01-01' + (event_id % CASE user_id % 3 WHEN 0 THEN 20 WHEN 1 THEN 150 ELSE 700 END)::INT AS day, (100 + event_id % 60)::INT AS systolic FROM events),
s AS (SELECT *, max(day) OVER (PARTITION BY patient_id) - min(day) OVER (PARTITION BY patient_id) AS span FROM b), m AS (SELECT *, CASE WHEN span <= 31 THEN 'day' WHEN span <= 183 THEN 'week' ELSE 'month' END AS mode FROM s)
SELECT patient_id, mode, strftime(CASE mode WHEN 'day' THEN day WHEN 'week' THEN date_trunc('week', day)::DATE + 3 ELSE date_trunc('month', day)::DATE + 14 END, '%Y-%m-%d') AS bucket, count(*) AS n, min(systolic) AS systolic_min, round(avg(systolic), 6) AS systolic_mean FROM m GROUP BY ALL""")
def bp_bucket_modes(spark: SparkSession, sf: str) -> DataFrame:
    """days, weeks or months, by the span of a patient's readings."""
    e, k = read(spark, sf, "events"), F.col("user_id") % 3
    days = F.col("event_id") % F.when(k == 0, 20).when(k == 1, 150).otherwise(700)
    r = e.select(F.col("user_id").alias("patient_id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd 08:00").alias("measured_at"), (100 + F.col("event_id") % 60).cast("int").alias("systolic"), F.lit(80).alias("diastolic"))
    return pressure.buckets(r).select("patient_id", "mode", F.col("bucket").cast("string").alias("bucket"), "n", "systolic_min", F.round("systolic_mean", 6).alias("systolic_mean"))
