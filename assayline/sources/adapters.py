"""Projections of order, event and line tables into the long measurement model (deterministic integer arithmetic only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows over as many tasks as a shuffle has, by number: scans and adaptive execution count bytes, of which such tables have
    few for the work that their rows make."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def orders_series(spark: SparkSession, sf_dir: str, by_priority: bool = True, one_lab: bool = False) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    test = F.col("o_orderpriority") if by_priority else F.lit("order_total")
    lab = F.lit("A") if one_lab else F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "B")
    return o.select(
        F.col("o_custkey").alias("patient_id"), test.alias("canonical_id"), F.col("o_orderkey").alias("result_id"), F.col("o_orderkey").alias("report_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"), F.col("o_totalprice").alias("value_num"), F.lit("mg/dL").alias("unit"),
        F.when(F.col("o_orderpriority") != "5-LOW", 125000.0).alias("ref_low"), F.when(F.col("o_orderpriority") != "1-URGENT", 375000.0).alias("ref_high"),
        lab.alias("lab"), F.concat(F.lit("T "), F.col("o_orderpriority")).alias("raw_name"),
    )


ORDERS_SQL = """
orders_series AS (
  SELECT o_custkey AS patient_id, {test} AS canonical_id, o_orderkey AS result_id, o_orderkey AS report_id, strftime(o_orderdate, '%Y-%m-%d') AS fecha,
         o_totalprice AS value_num, 'mg/dL' AS unit, CASE WHEN o_orderpriority <> '5-LOW' THEN 125000.0::DOUBLE END AS ref_low,
         CASE WHEN o_orderpriority <> '1-URGENT' THEN 375000.0::DOUBLE END AS ref_high, {lab} AS lab, 'T ' || o_orderpriority AS raw_name
  FROM orders
), flagged AS (
  SELECT *, CASE WHEN ref_low IS NULL AND ref_high IS NULL THEN NULL WHEN value_num < ref_low THEN 'bajo' WHEN value_num > ref_high THEN 'alto' ELSE 'normal' END AS flag FROM orders_series
), s AS (
  SELECT *, row_number() OVER w AS ord, lag(value_num) OVER w AS previous, lag(lab) OVER w AS previous_lab,
         row_number() OVER (PARTITION BY patient_id, canonical_id ORDER BY fecha DESC, result_id DESC) AS back,
         CASE WHEN ref_high > ref_low THEN ref_high - ref_low ELSE abs(coalesce(ref_high, ref_low)) END AS width
  FROM flagged WINDOW w AS (PARTITION BY patient_id, canonical_id ORDER BY fecha, result_id)
)"""
BY_PRIORITY = ORDERS_SQL.format(test="o_orderpriority", lab="CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END")
TOTAL = ORDERS_SQL.format(test="'order_total'", lab="CASE o_orderstatus WHEN 'F' THEN 'A' WHEN 'O' THEN 'B' END")
ONE_LAB = ORDERS_SQL.format(test="'order_total'", lab="'A'")


def variation(spark: SparkSession, tests: tuple[str, ...] = ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "order_total")) -> DataFrame:
    """An invented dimension: CVI 10 + position, CVA 5, one test by sex only."""
    from ..schemas import VARIATION

    rows = [(t, t, None if i == 1 else 10.0 + i, 12.0 if i == 1 else None, 9.0 if i == 1 else None, 5.0 if i != 2 else None, "", "", "") for i, t in enumerate(tests)]
    return spark.createDataFrame(rows, VARIATION)


VARIATION_SQL = """variation(canonical_id, cvi, cva) AS (VALUES ('1-URGENT', 10.0::DOUBLE, 5.0::DOUBLE), ('2-HIGH', 12.0, 5.0), ('3-MEDIUM', 12.0, NULL), ('5-LOW', 13.0, 5.0), ('order_total', 14.0, 5.0)
), bv AS (SELECT canonical_id, cvi, greatest(coalesce(cva, 0), 0.5 * cvi) AS cva, sqrt(ln((greatest(coalesce(cva, 0), 0.5 * cvi) / 100) ** 2 + 1) + ln((cvi / 100) ** 2 + 1)) AS sigma FROM variation)"""

#: Analytes of the panels: event type, unit, scale and shift of its values.
ANALYTES = ("view", "click", "purchase", "signup", "error")


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: user as patient, type as test, day as date; one unit in ten is not accepted."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("patient_id"), F.col("event_type").alias("canonical_id"), F.col("event_id").alias("result_id"), F.col("event_id").alias("report_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("fecha"), F.col("value").alias("value_num"), F.when(F.col("event_id") % 10 == 0, "mmol/L").otherwise("mg/dL").alias("unit"),
        F.lit(5.0).alias("ref_low"), F.lit(90.0).alias("ref_high"), F.lit("A").alias("lab"), F.col("event_type").alias("raw_name"),
    )


EVENTS_SQL = """
events_panel AS (
  SELECT user_id AS patient_id, event_type AS canonical_id, event_id AS result_id, strftime(ts, '%Y-%m-%d') AS fecha, value AS value_num,
         CASE WHEN event_id % 10 = 0 THEN 'mmol/L' ELSE 'mg/dL' END AS unit, 5.0::DOUBLE AS ref_low, 90.0::DOUBLE AS ref_high FROM events
), point AS (
  SELECT patient_id, canonical_id, fecha, arg_min(value_num, result_id) AS value_num, arg_min(unit, result_id) AS unit FROM events_panel GROUP BY ALL
), ok AS (SELECT patient_id, fecha, canonical_id, CASE WHEN unit = 'mg/dL' THEN value_num END AS v FROM point
), wide AS (
  SELECT patient_id, fecha, max(v) FILTER (canonical_id = 'view') AS view, max(v) FILTER (canonical_id = 'click') AS click, max(v) FILTER (canonical_id = 'purchase') AS purchase,
         max(v) FILTER (canonical_id = 'signup') AS signup, max(v) FILTER (canonical_id = 'error') AS error FROM ok GROUP BY ALL
)"""
