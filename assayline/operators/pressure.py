"""Home and office blood-pressure readings: validation, the one-week protocol, period statistics and chart buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, indices, text
from ..schemas import HOME, OFFICE

#: Absolute bounds of each figure; a user's limits must lie within.
BOUNDS = {"systolic": (40, 300), "diastolic": (20, 200), "pulse": (20, 250)}


def check_limits(limits: dict[str, tuple[int, int]], bounds: dict[str, tuple[int, int]] = BOUNDS) -> dict[str, tuple[int, int]]:
    """The limits, if each minimum is below its maximum and both are inside the absolute bounds."""
    out = {}
    for k, (lo, hi) in bounds.items():
        a, b = limits.get(k, (lo, hi))
        if not lo <= a < b <= hi:
            raise ValueError(f"{k}: {a}-{b} is not inside {lo}-{hi}")
        out[k] = (a, b)
    return out


def integer(x: Column) -> Column:
    t = F.trim(x.cast("string"))
    return F.when(t.rlike(r"^\d{1,3}([.,]0+)?$"), F.regexp_extract(t, r"^(\d+)", 1).cast("int"))


def validated(raw: DataFrame, now: Column, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Adds ``error``, the first rule that fails, and parsed figures; the pulse may be missing."""
    lim = check_limits(limits or {})
    p = raw.withColumn("at", dates.parse_datetime(F.col("measured_at"), now))
    for k in BOUNDS:
        p = p.withColumn(f"{k}_n", integer(F.col(k)))
    bad = lambda k: ~F.col(f"{k}_n").between(*lim[k])
    blank = F.trim(F.coalesce(F.col("pulse").cast("string"), F.lit(""))) == ""
    place = F.lower(F.trim(F.coalesce("place", F.lit(HOME))))
    error = (
        F.when(F.col("at").isNull(), "measured_at")
        .when(F.col("systolic_n").isNull() | bad("systolic"), "systolic")
        .when(F.col("diastolic_n").isNull() | bad("diastolic"), "diastolic")
        .when(F.col("systolic_n") <= F.col("diastolic_n"), "order")
        .when(~blank & (F.col("pulse_n").isNull() | bad("pulse")), "pulse")
        .when(~place.isin(HOME, OFFICE), "place")
    )
    return p.withColumn("place", place).withColumn("error", error).withColumn("note", text.clean_note(F.col("note")))


LEAST_DAYS, LEAST_READINGS = 3, 12


def week_protocol(readings: DataFrame) -> DataFrame:
    """The seven days up to the last home reading, without their first day: means, validity, and a category if valid.

    A pulse of 0 or none is left out.
    """
    w = Window.partitionBy("patient_id")
    home = readings.where(F.col("place") == HOME).withColumn("day", F.to_date(F.substring("measured_at", 1, 10)))
    week = home.withColumn("__last", F.max("day").over(w)).where(F.datediff("__last", "day") < 7).withColumn("__first", F.min("day").over(w)).where("day > __first")
    out = week.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"), F.avg("systolic").alias("systolic"), F.avg("diastolic").alias("diastolic"), F.avg(F.when(F.col("pulse") > 0, F.col("pulse"))).alias("pulse"))
    valid = (F.col("days") >= LEAST_DAYS) & (F.col("n") >= LEAST_READINGS)
    return out.withColumn("valid", valid).withColumn("category", F.when(valid, indices.bp_category(F.col("systolic"), F.col("diastolic"), F.lit(HOME))))


def check_period(start: str | None, end: str | None) -> tuple[str | None, str | None]:
    """Both blank, or two dates in order; the ends count."""
    from datetime import date

    if not start and not end:
        return None, None
    a, b = date.fromisoformat(start or "0001-01-01"), date.fromisoformat(end or "9999-12-31")
    if a > b:
        raise ValueError(f"{start} is after {end}")
    return a.isoformat(), b.isoformat()


def period_stats(readings: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    a, b = check_period(start, end)
    day = F.substring("measured_at", 1, 10)
    home = readings.where(F.col("place") == HOME)
    home = home if a is None else home.where(day.between(a, b))
    return home.groupBy("patient_id").agg(F.count("*").alias("n"), F.count_distinct(day).alias("days"), F.avg("systolic").alias("systolic"), F.avg("diastolic").alias("diastolic"), F.avg(F.when(F.col("pulse") > 0, F.col("pulse"))).alias("pulse"))


def buckets(readings: DataFrame) -> DataFrame:
    """Days, ISO weeks (by their Thursday) or months (by their 15th), by the span of a patient's readings."""
    w = Window.partitionBy("patient_id")
    r = readings.withColumn("day", F.to_date(F.substring("measured_at", 1, 10)))
    r = r.withColumn("__span", F.datediff(F.max("day").over(w), F.min("day").over(w)))
    mode = F.when(F.col("__span") <= 31, "day").when(F.col("__span") <= 183, "week").otherwise("month")
    at = F.when(mode == "day", F.col("day")).when(mode == "week", F.date_add(F.date_trunc("week", "day").cast("date"), 3)).otherwise(F.date_add(F.trunc("day", "month"), 14))
    agg = [f(c).alias(f"{c}_{n}") for c in ("systolic", "diastolic") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return r.groupBy("patient_id", mode.alias("mode"), at.alias("bucket")).agg(F.count("*").alias("n"), *agg)
