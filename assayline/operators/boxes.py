"""Characters with their places on a page, before they are text: blanks that lie over a glyph, glyphs drawn twice, lines.

A character is (doc_id, page, no, text, x0, x1, top): ``no`` is its place in the order of drawing, x0 to x1 its extent, top the
height of its line. Characters meet only within a page, in lines at most one apart and in a common stretch of a line, and are
joined on those: page, line and stretch are equi-join keys, and the exact test is a filter behind them. So the work grows with
the characters that do meet. Characters without finite places take no part and are kept; equal boxes are compared once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["doc_id", "page"]
#: Width of a stretch, in points; a character is in one or two.
STRETCH = 16.0
#: Side of a square in which glyphs are compared, in tolerances.
SQUARE = 8.0


def _stretches(low: Column, high: Column) -> Column:
    at = lambda x: F.floor(x / STRETCH)
    return F.explode(F.sequence(at(F.least(low, high)), at(F.greatest(low, high))))


def _placed(chars: DataFrame) -> DataFrame:
    finite = lambda c: F.abs(F.col(c)) < 1e7
    return chars.where(finite("x0") & finite("x1") & finite("top") & F.col("text").isNotNull())


def without_overlapping_blanks(chars: DataFrame, slack: float = 0.5) -> DataFrame:
    """Leaves out blanks that lie over a glyph by more than ``slack`` on either side, in their line or the one above or below."""
    line = F.bround(F.col("top")).cast("long")
    placed = _placed(chars).withColumn("line", line)
    glyphs = placed.where("text <> ' '").select(*KEY, F.col("x0").alias("g0"), F.col("x1").alias("g1"), "line").distinct()
    glyphs = glyphs.select(*KEY, "g0", "g1", F.explode(F.array(F.col("line") - 1, F.col("line"), F.col("line") + 1)).alias("line"))
    glyphs = glyphs.withColumn("stretch", _stretches(F.col("g0"), F.col("g1")))
    low, high = F.col("x0") + slack, F.col("x1") - slack
    blanks = placed.where("text = ' '").select(*KEY, "no", "x0", "x1", "line").withColumn("stretch", _stretches(low, high))
    over = blanks.join(glyphs, [*KEY, "line", "stretch"]).where((F.col("g0") < high) & (F.col("g1") > low)).select(*KEY, "no").distinct()
    return chars.join(over, [*KEY, "no"], "left_anti").select(chars.columns)


def _squares(placed: DataFrame, tolerance: float) -> DataFrame:
    """Each glyph once for every square (i, j) that it looks in: its own and, near an edge, those beyond it."""
    around = lambda c: F.explode(F.sequence(_square(F.col(c) - tolerance, tolerance), _square(F.col(c) + tolerance, tolerance)))
    return placed.withColumn("i", around("x0")).withColumn("j", around("top"))


def _square(x: Column, tolerance: float) -> Column:
    return F.floor(x / (SQUARE * tolerance))


def drawn_once(chars: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Leaves out a glyph that repeats an earlier one of the same text less than ``tolerance`` away on both axes.

    They meet in squares of ``SQUARE`` tolerances, so that most glyphs are dealt once.
    """
    placed = _placed(chars).select(*KEY, "no", "text", "x0", "top")
    first = placed.groupBy(*KEY, "text", F.col("x0").alias("e0"), F.col("top").alias("etop")).agg(F.min("no").alias("earlier"))
    first = first.withColumns({"i": _square(F.col("e0"), tolerance), "j": _square(F.col("etop"), tolerance)})
    close = (F.abs(F.col("x0") - F.col("e0")) < tolerance) & (F.abs(F.col("top") - F.col("etop")) < tolerance)
    again = _squares(placed, tolerance).join(first, [*KEY, "text", "i", "j"]).where((F.col("earlier") < F.col("no")) & close).select(*KEY, "no").distinct()
    return chars.join(again, [*KEY, "no"], "left_anti").select(chars.columns)


def text_lines(chars: DataFrame, gap: float = 3.0) -> DataFrame:
    """(doc_id, page, line, text): characters of a line from left to right, with a blank where they stand apart."""
    line = F.bround(F.col("top")).cast("long").alias("line")
    by = Window.partitionBy(*KEY, "line").orderBy("x0", "no")
    apart = (F.col("x0") - F.lag("x1").over(by) > gap) & (F.col("text") != " ") & (F.lag("text").over(by) != " ")
    c = _placed(chars).select(*KEY, line, "no", "x0", "x1", "text")
    c = c.withColumn("text", F.when(apart, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    ordered = F.sort_array(F.collect_list(F.struct("x0", "no", "text")))
    return c.groupBy(*KEY, "line").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "").alias("text"))
