"""Operators on measurement series: all patients and all tests in one plan, partitioned by (patient_id, canonical_id).

Every order is total: effective date, then result_id. Nothing is collected; a series is the rows of a window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import dates, indices, ranges
from ..schemas import DOWN, NORMAL, UP

KEY = ["patient_id", "canonical_id"]


def in_order() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy("fecha", "result_id")


def backwards() -> WindowSpec:
    return Window.partitionBy(*KEY).orderBy(F.desc("fecha"), F.desc("result_id"))


def whole_series() -> WindowSpec:
    return Window.partitionBy(*KEY)


def up_to() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def series(results: DataFrame, reports: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """Rows with a value and an effective date; ``excluded`` (lab) names labs to leave out, '' the unknown one."""
    rep = reports.select(F.col("id").alias("report_id"), "patient_id", "request_date", "validation_date", "lab")
    if excluded is not None:
        rep = rep.join(excluded.select(F.coalesce("lab", F.lit("")).alias("__lab")).distinct(), F.coalesce(rep.lab, F.lit("")) == F.col("__lab"), "left_anti")
    out = results.join(rep, "report_id").withColumn("fecha", dates.effective(F.col("sample_date"), F.col("request_date"), F.col("validation_date")))
    return out.where("value_num IS NOT NULL AND fecha IS NOT NULL").select("patient_id", "canonical_id", F.col("id").alias("result_id"), "report_id", "fecha", "value_num", "unit", "ref_low", "ref_high", "lab", "raw_name", F.col("flag_calc").alias("flag"))


def flagged(s: DataFrame) -> DataFrame:
    return s.withColumn("flag", ranges.flag(F.col("value_num"), F.col("ref_low"), F.col("ref_high")))


def merged(s: DataFrame, ids: DataFrame) -> DataFrame:
    """One point per full date of an analyte: ``ids`` (analyte, canonical_id, priority) says which id comes first."""
    first = F.row_number().over(Window.partitionBy("patient_id", "analyte", "fecha").orderBy("priority", "result_id"))
    return s.join(ids, "canonical_id").withColumn("__n", first).where("__n = 1").drop("__n", "priority")


def with_targets(s: DataFrame, targets: DataFrame) -> DataFrame:
    """A target, where there is one, replaces the range of every point, both bounds, and the flag follows."""
    t = targets.select(*KEY, "target_low", "target_high")
    has = F.col("target_low").isNotNull() | F.col("target_high").isNotNull()
    out = s.join(t, KEY, "left").withColumn("has_target", F.coalesce(has, F.lit(False)))
    out = out.withColumn("ref_low", F.when(F.col("has_target"), F.col("target_low")).otherwise(F.col("ref_low"))).withColumn("ref_high", F.when(F.col("has_target"), F.col("target_high")).otherwise(F.col("ref_high")))
    return flagged(out.drop("target_low", "target_high"))


def last_five_years(s: DataFrame) -> DataFrame:
    """Points of the five years before the series' own last date."""
    return s.withColumn("__last", F.max("fecha").over(whole_series())).where(F.col("fecha") >= dates.five_years_before(F.col("__last"))).drop("__last")


def with_previous(s: DataFrame) -> DataFrame:
    return s.withColumn("ord", F.row_number().over(in_order())).withColumn("previous", F.lag("value_num").over(in_order())).withColumn("previous_lab", F.lag("lab").over(in_order())).withColumn("back", F.row_number().over(backwards()))


def latest_report(s: DataFrame) -> DataFrame:
    """(patient_id, report_id, fecha) of each patient's last report; ties to the larger id."""
    by = s.groupBy("patient_id", "report_id").agg(F.max("fecha").alias("fecha"))
    n = F.row_number().over(Window.partitionBy("patient_id").orderBy(F.desc("fecha"), F.desc("report_id")))
    return by.withColumn("__n", n).where("__n = 1").drop("__n")


ABRUPT = 30.0


def latest(s: DataFrame) -> DataFrame:
    """Each series' last point, its change, and a priority: 0 out of range, 1 an abrupt change, 2 the rest."""
    last = with_previous(flagged(s)).where("back = 1")
    pct = F.when(F.col("previous") != 0, indices.percent_change(F.col("previous"), F.col("value_num")))
    abrupt = F.coalesce(F.abs(pct) >= ABRUPT, F.lit(False))
    out = last.withColumn("pct_change", pct).withColumn("abrupt", abrupt)
    return out.withColumn("priority", F.when(ranges.out_of_range(F.col("flag")), 0).when(F.col("abrupt"), 1).otherwise(2))


def latest_report_summary(s: DataFrame) -> DataFrame:
    """All results of each patient's last report, with the second-last value of each test's own series."""
    points = with_previous(flagged(s))
    before_last = points.where("back <= 2").groupBy(*KEY).agg(F.max(F.when(F.col("back") == 2, F.col("value_num"))).alias("previous"))
    return points.drop("previous").join(latest_report(s).select("patient_id", "report_id"), ["patient_id", "report_id"]).join(before_last, KEY, "left")


def with_variation(s: DataFrame, variation: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """Adds cvi and cva of each test; the dimension is small, and Spark sees to that."""
    v = variation.select("canonical_id", F.col("cvi").alias("__c"), "cvi_f", "cvi_m", "cva")
    out = s.join(v, "canonical_id", "left")
    out = out.join(patients.select(F.col("id").alias("patient_id"), "sex"), "patient_id", "left") if patients is not None else out.withColumn("sex", F.lit(None).cast("string"))
    return out.withColumn("cvi", indices.cvi_for(F.col("sex"), F.col("__c"), F.col("cvi_f"), F.col("cvi_m"))).drop("__c", "cvi_f", "cvi_m", "sex")


def changes(s: DataFrame, variation: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """Each series' last change against its reference change value."""
    last = with_variation(with_previous(s).where("back = 1"), variation, patients)
    cvi, cva = F.col("cvi"), F.col("cva")
    state = indices.rcv_state(F.col("previous"), F.col("value_num"), F.col("previous_lab"), F.col("lab"), cvi, cva)
    return last.withColumn("pct", indices.percent_change(F.col("previous"), F.col("value_num"))).withColumn("rcv_down", indices.rcv_down(cvi, cva)).withColumn("rcv_up", indices.rcv_up(cvi, cva)).withColumn("state", state)


def steady() -> Column:
    return (F.coalesce(F.col("flag"), F.lit(NORMAL)) == NORMAL) & (F.col("ref_low").isNotNull() | F.col("ref_high").isNotNull()) & F.col("value_num").isNotNull()


def personal_range(s: DataFrame, variation: DataFrame, patients: DataFrame | None = None, least: int = 3) -> DataFrame:
    """A patient's own range from the in-range points before the last one."""
    p = with_variation(with_previous(flagged(s)), variation, patients).where(F.col("cvi").isNotNull() & (F.col("back") > 1) & steady())
    out = p.groupBy(*KEY).agg(F.avg("value_num").alias("centre"), F.count("*").alias("n"), F.count_distinct(F.coalesce("lab", F.lit(""))).alias("labs"), F.max("cvi").alias("cvi"), F.max("cva").alias("cva")).where(F.col("n") >= least)
    low, high = indices.personal_bounds(F.col("centre"), F.col("n"), F.col("cvi"), F.col("cva"))
    return out.select(*KEY, "n", "labs", "centre", low.alias("low"), high.alias("high"))


CUSUM_K, CUSUM_H, CUSUM_BASE, CUSUM_LEAST = 0.5, 5.0, 4, 3


def same_lab_run(s: DataFrame) -> DataFrame:
    """The trailing run of points of the last point's lab; two unknown labs are the same."""
    p = s.withColumn("ord", F.row_number().over(in_order())).withColumn("__lab", F.last("lab").over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    other = F.max(F.when(~F.col("lab").eqNullSafe(F.col("__lab")), F.col("ord"))).over(whole_series())
    return p.withColumn("__o", F.coalesce(other, F.lit(0))).where("ord > __o").drop("__lab", "__o")


def drift(s: DataFrame, variation: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """Tabular CUSUM over the trailing one-lab run, as running sums less their running minima (no recursion)."""
    p = same_lab_run(with_variation(flagged(s), variation, patients)).where("cvi IS NOT NULL AND value_num > 0")
    p = p.withColumn("ord", F.row_number().over(in_order())).withColumn("__steady", steady().cast("int")).withColumn("__k", F.sum("__steady").over(up_to()))
    base = (F.col("__steady") == 1) & (F.col("__k") <= CUSUM_BASE)
    p = p.withColumn("__base", base).withColumn("centre", F.avg(F.when(F.col("__base"), F.col("value_num"))).over(whole_series())).withColumn("__n", F.sum(F.col("__base").cast("int")).over(whole_series())).withColumn("__end", F.max(F.when(F.col("__base"), F.col("ord"))).over(whole_series()))
    p = p.where((F.col("__n") == CUSUM_BASE) & (F.col("ord") > F.col("__end")))
    z = (F.ln("value_num") - F.ln("centre")) / indices.sigma(F.col("cvi"), F.col("cva"))
    p = p.withColumn("__z", z).withColumn("__n", F.count(F.lit(1)).over(whole_series())).where(F.col("__n") >= CUSUM_LEAST)
    for side, sign in (("up", 1), ("down", -1)):
        p = p.withColumn(f"__c_{side}", F.sum(sign * F.col("__z") - CUSUM_K).over(up_to()))
        p = p.withColumn(f"s_{side}", F.col(f"__c_{side}") - F.least(F.lit(0.0), F.min(f"__c_{side}").over(up_to())))
        zero = F.max(F.when(F.col(f"s_{side}") <= 0, F.col("ord"))).over(whole_series())
        p = p.withColumn(f"__z_{side}", F.coalesce(zero, F.lit(0)))
    out = p.groupBy(*KEY).agg(
        F.count("*").alias("n"), F.max("centre").alias("centre"), F.max_by("s_up", "ord").alias("s_up"), F.max_by("s_down", "ord").alias("s_down"),
        F.min(F.when(F.col("ord") > F.col("__z_up"), F.col("fecha"))).alias("__since_up"), F.min(F.when(F.col("ord") > F.col("__z_down"), F.col("fecha"))).alias("__since_down"),
    )
    way = F.when(F.col("s_up") > CUSUM_H, UP).when(F.col("s_down") > CUSUM_H, DOWN)
    return out.select(*KEY, "n", "centre", "s_up", "s_down", way.alias("direction"), F.when(way == UP, F.col("__since_up")).when(way == DOWN, F.col("__since_down")).alias("since"))


Z_TREND, CONFIRM_POINTS, CONFIRM_DAYS, STABLE_SHARE, PROJECTED = 1.959964, 5, 730, 0.05, 90


def trend(s: DataFrame, least: int = 3) -> DataFrame:
    """Theil-Sen slope per day with Sen's interval and intercept, from all pairs of a series' points.

    The pairs stay inside one series (some tens of points); slopes are gathered per series as an array.
    """
    p = s.select(*KEY, "result_id", F.datediff(dates.day(F.col("fecha")), F.lit("1970-01-01")).alias("x"), F.col("value_num").alias("y"), "fecha", "ref_low", "ref_high")
    a, b = p.alias("a"), p.alias("b")
    pairs = a.join(b, (F.col("a.patient_id") == F.col("b.patient_id")) & (F.col("a.canonical_id") == F.col("b.canonical_id")) & (F.col("a.x") < F.col("b.x")))
    slopes = pairs.groupBy("a.patient_id", "a.canonical_id").agg(F.array_sort(F.collect_list((F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x")))).alias("slopes"))
    last = F.struct("fecha", "result_id")
    whole = p.groupBy(*KEY).agg(F.count("*").alias("n"), F.median("x").alias("mx"), F.median("y").alias("my"), F.min("x").alias("x0"), F.max("x").alias("x1"), (F.max("y") - F.min("y")).alias("spread"), F.max_by("y", last).alias("last"), F.max_by("ref_low", last).alias("ref_low"), F.max_by("ref_high", last).alias("ref_high")).where(F.col("n") >= least)
    out = whole.join(slopes, KEY)
    size = F.size("slopes")
    at = lambda i: F.element_at("slopes", i.cast("int"))
    middle = F.when(size % 2 == 1, at((size + 1) / 2)).otherwise((at(size / 2) + at(size / 2 + 1)) / 2)
    n = F.col("n")
    c = Z_TREND * F.sqrt(n * (n - 1) * (2 * n + 5) / 18.0)
    lo = F.greatest(F.bround((size - c) / 2, 0).cast("int") - 1, F.lit(0))
    hi = F.least(F.bround((size + c) / 2, 0).cast("int"), size - 1)
    out = out.withColumn("slope", middle).withColumn("slope_low", at(lo + 1)).withColumn("slope_high", at(hi + 1))
    return out.withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx")).withColumn("days", F.col("x1") - F.col("x0")).drop("slopes")


def trend_direction(t: DataFrame) -> DataFrame:
    """pocos_datos, sin_tendencia, estable, subiendo or bajando, with the yearly change in spans and a 90-day projection."""
    span = F.when(F.col("ref_high") > F.col("ref_low"), F.col("ref_high") - F.col("ref_low")).when(F.col("spread") != 0, F.col("spread")).when(F.col("last") != 0, F.abs("last")).otherwise(1.0)
    over = F.col("slope") * F.col("days")
    word = F.when((F.col("n") < CONFIRM_POINTS) | (F.col("days") < CONFIRM_DAYS), "pocos_datos").when((F.col("slope_low") <= 0) & (F.col("slope_high") >= 0), "sin_tendencia").when(F.abs(over) < STABLE_SHARE * F.col("span"), "estable").when(over > 0, "subiendo").otherwise("bajando")
    out = t.withColumn("span", span).withColumn("direction", word).withColumn("yearly_spans", F.col("slope") * 365.25 / F.col("span"))
    decline = (F.col("slope") * 365.25 < -5) & (F.col("slope_high") < 0) & (F.col("direction") == "bajando")
    return out.withColumn("projected_90", F.col("intercept") + F.col("slope") * (F.col("x1") + PROJECTED)).withColumn("rapid_decline", decline)


MAX_GAP, LEAST_DAYS = 365, 365


def time_in_range(s: DataFrame) -> DataFrame:
    """Rosendaal's share of days in range by straight lines between neighbours, and the gaps left out."""
    nxt = lambda c: F.lead(c).over(in_order())
    p = s.withColumn("__d", F.datediff(dates.day(nxt("fecha")), dates.day(F.col("fecha")))).withColumn("__p0", ranges.normalized(F.col("value_num"), F.col("ref_low"), F.col("ref_high")))
    p = p.withColumn("__p1", nxt("__p0"))
    used = (F.col("__d") > 0) & (F.col("__d") <= MAX_GAP) & (F.col("__p0.kind") == F.col("__p1.kind"))
    inside = ranges.fraction_inside(F.col("__p0.v"), F.col("__p1.v"), F.col("__p0.a"), F.col("__p0.b"))
    out = p.groupBy(*KEY).agg(F.sum(F.when(used, F.col("__d") * inside)).alias("__in"), F.sum(F.when(used, F.col("__d"))).alias("days"), F.sum(F.when(F.col("__d") > MAX_GAP, 1).otherwise(0)).alias("gaps"))
    return out.where(F.col("days") >= LEAST_DAYS).select(*KEY, "days", "gaps", (F.col("__in") / F.col("days") * 100).alias("percent_in_range"))


def summary(s: DataFrame) -> DataFrame:
    """Counts of each series against its ranges; points without a bound don't count."""
    p = flagged(s)
    last = F.struct("fecha", "result_id")
    return p.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if(F.col("flag") == NORMAL).alias("n_normal"), F.count_if(F.col("flag") == "alto").alias("n_high"), F.count_if(F.col("flag") == "bajo").alias("n_low"), F.max_by("value_num", last).alias("last"), F.max_by("flag", last).alias("last_flag"), F.max("fecha").alias("last_fecha"))


def whole_period_change(s: DataFrame) -> DataFrame:
    """Percent change since the previous and since the first point; null on a base of 0."""
    p = with_previous(s).withColumn("first", F.first("value_num").over(in_order())).where("back = 1 AND ord > 1")
    pct = lambda c: F.when(F.col(c) != 0, indices.percent_change(F.col(c), F.col("value_num")))
    return p.select(*KEY, pct("previous").alias("pct_last"), pct("first").alias("pct_whole"))


def ranked_changes(s: DataFrame) -> DataFrame:
    """The last change of each series in widths of its current range, unchanged ones left out."""
    p = with_previous(s).where("back = 1 AND previous IS NOT NULL")
    low, high = F.col("ref_low"), F.col("ref_high")
    out = p.withColumn("size", ranges.change_size(F.col("previous"), F.col("value_num"), low, high)).withColumn("status", ranges.change_status(F.col("previous"), F.col("value_num"), low, high))
    return out.where(F.col("size").isNotNull() & (F.col("size") != 0))


def bullet_rows(s: DataFrame) -> DataFrame:
    """Last points with an upper bound above their base, with distance, label and place on the bar."""
    p = with_previous(s).where("back = 1")
    d = ranges.distance(F.col("value_num"), F.col("ref_low"), F.col("ref_high"))
    base = F.coalesce("ref_low", F.lit(0.0))
    return p.where(F.col("ref_high") > base).withColumn("distance", d).withColumn("label", ranges.deviation_label(d)).withColumn("place", (F.col("value_num") - base) / (F.col("ref_high") - base))


def heatmap(s: DataFrame) -> DataFrame:
    """(patient, test, day): the day's last value and its position."""
    d = F.substring("fecha", 1, 10)
    n = F.row_number().over(Window.partitionBy(*KEY, "day").orderBy(F.desc("fecha"), F.desc("result_id")))
    p = s.withColumn("day", d).withColumn("__n", n).where("__n = 1")
    return p.withColumn("position", ranges.position(F.col("value_num"), F.col("ref_low"), F.col("ref_high"))).select(*KEY, "day", "value_num", "position")


def heatmap_labels(cells: DataFrame, columns: int = 24) -> DataFrame:
    """Which cells of a patient's map are written: those out of range; with more days on the map than ``columns``, of each
    row only its highest high and its lowest low (of equal ones the first day's)."""
    days = cells.groupBy("patient_id").agg(F.count_distinct("day").alias("__days"))
    by = Window.partitionBy(*KEY)
    high = F.max(F.when(F.col("position") > 0, F.struct("value_num", (-F.unix_date(F.col("day").cast("date"))).alias("d")))).over(by)
    low = F.min(F.when(F.col("position") < 0, F.struct("value_num", F.unix_date(F.col("day").cast("date")).alias("d")))).over(by)
    out = cells.withColumn("__high", high).withColumn("__low", low).join(days, "patient_id")
    d = F.unix_date(F.col("day").cast("date"))
    best = ((F.col("position") > 0) & (d == -F.col("__high.d"))) | ((F.col("position") < 0) & (d == F.col("__low.d")))
    return out.withColumn("written", F.coalesce((F.col("position") != 0) & ((F.col("__days") <= columns) | best), F.lit(False))).drop("__days", "__high", "__low")


def labs_in_order(s: DataFrame) -> DataFrame:
    """Labs of each series by first appearance; an unknown lab is ''."""
    first = s.withColumn("ord", F.row_number().over(in_order())).groupBy(*KEY, F.coalesce("lab", F.lit("")).alias("lab")).agg(F.min("ord").alias("first"))
    return first.select(*KEY, "lab", F.row_number().over(Window.partitionBy(*KEY).orderBy("first")).alias("place"))


def sustained(s: DataFrame, limit: float, least: int = 2) -> DataFrame:
    """Series with values over the limit on several dates: the dates and the last such value."""
    over = s.where(F.col("value_num") > limit)
    return over.groupBy(*KEY).agg(F.sort_array(F.collect_set("fecha")).alias("dates"), F.max_by("value_num", F.struct("fecha", "result_id")).alias("last")).where(F.size("dates") >= least)


def rolling_ratio(s: DataFrame, back: int = 365, gap: int = 8) -> DataFrame:
    """Each value over the median of those 8 to 365 days before it."""
    d = s.withColumn("__day", F.datediff(dates.day(F.col("fecha")), F.lit("1970-01-01")))
    w = Window.partitionBy(*KEY).orderBy("__day").rangeBetween(-back, -gap)
    return d.withColumn("base", F.percentile("value_num", F.lit(0.5)).over(w)).withColumn("ratio", F.try_divide("value_num", "base")).drop("__day")


def filled_band(s: DataFrame) -> DataFrame:
    """A missing bound drawn at the smallest (largest) known one of the series."""
    return s.withColumn("band_low", F.coalesce("ref_low", F.min("ref_low").over(whole_series()))).withColumn("band_high", F.coalesce("ref_high", F.max("ref_high").over(whole_series())))


def sufficiency(s: DataFrame, least: int = 4) -> DataFrame:
    return s.groupBy(*KEY).agg(F.count("*").alias("n")).withColumn("state", ranges.sufficiency(F.col("n"), least))
