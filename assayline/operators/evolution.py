"""Rows behind the charts of one test over time, and the panels' latest summaries: what a drawing needs, ready to draw.

All columns of a point come from windows over its series, which share one partitioning and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import indices, ranges
from . import panels
from . import series as S

C = F.col
#: Ends of the position chart in widths of the range, tests that are compared, limits of the lipid summary.
POSITION_FROM, POSITION_TO = -0.8, 1.8
COMPARED = 2
LIPID_HIGH, HDL_LOW = {"total": 200.0, "ldl": 130.0, "tg": 150.0}, 40.0


def mild(value: Column, low: Column, high: Column) -> Column:
    """Out of range by less than the share of its width that counts as slight."""
    d = ranges.distance(value, low, high)
    return F.coalesce((d != 0) & (F.abs(d) < ranges.SLIGHT), F.lit(False))


def evolution(s: DataFrame, variation: DataFrame, patients: DataFrame | None = None, least: int = 3) -> DataFrame:
    """Every point with its filled reference band, its flag and whether it is mild, the series' personal band, and at the last
    point the band of expected variation around the previous value.

    The personal band needs ``least`` steady points before the last one, and is null otherwise. The expected band is null
    at other points, without variation data, and where the two last values come from different labs (``state`` says so).
    """
    p = S.with_variation(S.filled_band(S.with_previous(S.flagged(s))), variation, patients)
    cvi, cva, over = C("cvi"), C("cva"), S.whole_series()
    steady = cvi.isNotNull() & (C("back") > 1) & S.steady()
    mine = lambda x: F.when(steady, x)
    lab = mine(F.coalesce("lab", F.lit("")))
    p = p.withColumn("__n", F.count(mine(F.lit(1))).over(over)).withColumn("__centre", F.avg(mine(C("value_num"))).over(over)).withColumn("mixed_labs", F.coalesce(F.min(lab).over(over) != F.max(lab).over(over), F.lit(False)))
    low, high = indices.personal_bounds(C("__centre"), C("__n"), F.max(cvi).over(over), F.max(cva).over(over))
    enough = C("__n") >= least
    state = F.when(C("back") == 1, indices.rcv_state(C("previous"), C("value_num"), C("previous_lab"), C("lab"), cvi, cva))
    p = p.withColumn("personal_low", F.when(enough, low)).withColumn("personal_high", F.when(enough, high)).withColumn("state", state)
    applies = C("state") != indices.OTHER_LAB
    for side, change in (("low", indices.rcv_down(cvi, cva)), ("high", indices.rcv_up(cvi, cva))):
        p = p.withColumn(f"expected_{side}", F.when(applies, C("previous") * (1 + change / 100)))
    return p.withColumn("mild", mild(C("value_num"), C("ref_low"), C("ref_high"))).withColumn("mixed_labs", enough & C("mixed_labs")).drop("__n", "__centre")


def comparison(points: DataFrame, tests: list[str]) -> DataFrame:
    """The points of the first two of the tests asked for, each test on a panel (0, 1) of its own."""
    shown = list(dict.fromkeys(tests))[:COMPARED]
    panel = F.array_position(F.array(*[F.lit(t) for t in shown]).cast("array<string>"), C("canonical_id")).cast("int") - 1
    return points.where(C("canonical_id").isin(shown)).withColumn("panel", panel)


def changes_rows(s: DataFrame, variation: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """The ranked last changes with their state against the reference change value."""
    p = S.with_variation(S.ranked_changes(s), variation, patients)
    return p.withColumn("state", indices.rcv_state(C("previous"), C("value_num"), C("previous_lab"), C("lab"), C("cvi"), C("cva")))


def position_rows(s: DataFrame) -> DataFrame:
    """Last points on their bars: place and the previous value's place, both held inside the chart, and the side a point left."""
    p = S.bullet_rows(s)
    base = F.coalesce("ref_low", F.lit(0.0))
    held = lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(POSITION_FROM)), F.lit(POSITION_TO)))
    before = (C("previous") - base) / (C("ref_high") - base)
    side = F.when(C("place") > POSITION_TO, ">").when(C("place") < POSITION_FROM, "<").otherwise("o")
    return p.withColumn("marker", side).withColumn("previous_place", held(before)).withColumn("place", held(C("place"))).withColumn("mild", mild(C("value_num"), C("ref_low"), C("ref_high")))


def trend_lines(t: DataFrame) -> DataFrame:
    """Corners of the trend line of each fitted series: its first day, its last, and the projection 90 days on."""
    days = (C("x0"), C("x1"), C("x1") + S.PROJECTED)
    ends = F.array(*[F.struct(F.lit(i).alias("corner"), d.alias("day"), (C("intercept") + C("slope") * d).alias("value")) for i, d in enumerate(days)])
    return t.select(*S.KEY, F.explode(ends).alias("e")).select(*S.KEY, "e.*")


def lipid_summary(points: DataFrame) -> DataFrame:
    """The last date that has both total and HDL rows, whatever their units: values, an LDL estimated where none is measured,
    flags and indices."""
    p = panels.latest(points, panels.PANELS["lipid"])
    ldl = F.coalesce(C("ldl"), indices.friedewald(C("total"), C("hdl"), C("tg")))
    p = p.withColumn("ldl_estimated", C("ldl").isNull() & ldl.isNotNull()).withColumn("ldl", ldl)
    flags = [ranges.flag(C(a), F.lit(None).cast("double"), F.lit(x)).alias(f"{a}_flag") for a, x in LIPID_HIGH.items()]
    flags.append(ranges.flag(C("hdl"), F.lit(HDL_LOW), F.lit(None).cast("double")).alias("hdl_flag"))
    return p.select("patient_id", "fecha", "total", "hdl", "ldl", "tg", "ldl_estimated", *flags, indices.castelli_1(C("total"), C("hdl")).alias("castelli_1"), indices.castelli_2(ldl, C("hdl")).alias("castelli_2"), indices.tg_hdl(C("tg"), C("hdl")).alias("tg_hdl"))


def iron_summary(points: DataFrame) -> DataFrame:
    """The last date with any analyte in its unit; a saturation that the lab gives none of is estimated."""
    p = panels.latest(points, panels.PANELS["iron"])
    tsat = F.coalesce(C("tsat"), indices.tsat(C("iron"), C("transferrin")))
    i = panels.PANELS["iron"].indices
    p = p.withColumn("tsat_estimated", C("tsat").isNull() & tsat.isNotNull()).withColumn("tsat", tsat)
    flag = lambda a: ranges.flag(C(a), F.lit(i[a].low).cast("double"), F.lit(i[a].high).cast("double")).alias(f"{a}_flag")
    return p.select("patient_id", "fecha", "iron", "ferritin", "transferrin", "tsat", "tsat_estimated", flag("ferritin"), flag("tsat"))
