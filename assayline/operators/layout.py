"""Pages of printed reports: which pages a report has, and how texts and charts flow over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Paper:
    """Heights in inches; fixed values of a printed page."""

    usable: float = 11.69 - 0.5 - 0.65
    gap: float = 0.15
    #: Of a text: above its lines, a line, below them.
    title: float = 0.3
    line: float = 9 * 1.4 / 72
    foot: float = 0.15
    #: A chart is made no smaller than this share of its height.
    least: float = 0.75


def report_plan(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(patient_id, page, pages, kind, canonical_id) of a report: a cover, the table of what is out of range, the table of the
    rest, and a chart of each of its rows (patient_id, place, canonical_id, flag) whose series has two points or more
    (``points``: patient_id, canonical_id, num_points), in the order of the rows."""
    fixed = rows.select("patient_id").distinct().select("patient_id", F.posexplode(F.array(*map(F.lit, ("cover", "out_of_range", "rest")))).alias("at", "kind"))
    fixed = fixed.select("patient_id", (F.col("at") + 1).alias("page"), "kind", F.lit(None).cast("string").alias("canonical_id"))
    charts = rows.join(points.where("num_points >= 2").select("patient_id", "canonical_id"), ["patient_id", "canonical_id"])
    n = F.row_number().over(Window.partitionBy("patient_id").orderBy("place", "canonical_id"))
    charts = charts.select("patient_id", (n + 3).alias("page"), F.lit("chart").alias("kind"), "canonical_id")
    return fixed.unionByName(charts).withColumn("pages", F.max("page").over(Window.partitionBy("patient_id")))


def heights(blocks: DataFrame, per_page: int, paper: Paper = Paper()) -> DataFrame:
    """Adds ``height`` to blocks (kind, lines, tall): a text's by its lines; a chart's is its share of a page, but neither more
    than its own height nor less than what it may shrink to; null for pages of their own and texts longer than a page."""
    share = paper.usable / per_page - paper.gap
    chart = F.least(F.col("tall"), F.greatest(F.lit(share), F.col("tall") * paper.least), F.lit(paper.usable))
    h = F.when(F.col("kind") == "text", paper.title + F.col("lines") * paper.line + paper.foot).when(F.col("kind") == "chart", chart)
    return blocks.withColumn("height", F.when(h <= paper.usable, h))


def flowed(blocks: DataFrame, paper: Paper = Paper()) -> DataFrame:
    """Adds ``page`` (from 1) and ``top`` (used height above the block) to blocks (doc_id, place, kind, height).

    Blocks fill pages from top to bottom in order. A text that a chart follows goes to the page where the chart fits too, if
    a page can hold both. A block without a height has a page of its own and ends the flow. Documents are dealt over
    partitions and each is passed over once, in order, holding one block; blocks of one doc_id are one document, null included.
    """
    by = Window.partitionBy("doc_id").orderBy("place")
    after = F.when(F.col("kind") == "text", F.when(F.lead("kind").over(by) == "chart", F.lead("height").over(by)))
    ahead = blocks.withColumn("__after", after)
    # the window has dealt documents to partitions already; the order within them is said again, for the fold relies on it
    ahead = ahead.sortWithinPartitions("doc_id", "place")
    schema = ", ".join(f"`{n}` {t}" for n, t in blocks.dtypes) + ", page int, top double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, begun, page, free, flowing = None, False, 0, paper.usable, False
        for b in batches:
            pages, tops = [], []
            for d, h, nxt in zip(b.column("doc_id").to_pylist(), b.column("height").to_pylist(), b.column("__after").to_pylist(), strict=True):
                if not begun or d != doc:
                    doc, begun, page, free, flowing = d, True, 0, paper.usable, False
                if h is None:
                    page, free, flowing = page + 1, paper.usable, False
                    pages.append(page)
                    tops.append(0.0)
                    continue
                need = h if nxt is None else min(h + paper.gap + nxt, paper.usable)
                if not flowing or need > free:
                    page, free, flowing = page + 1, paper.usable, True
                pages.append(page)
                tops.append(paper.usable - free)
                free -= h + paper.gap
            out = b.drop_columns(["__after"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(pages, pa.int32()), pa.array(tops, pa.float64())], [*out.schema.names, "page", "top"])

    return ahead.mapInArrow(run, schema)
