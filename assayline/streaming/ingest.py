"""Incremental ingest with Structured Streaming: new report texts become result rows, series are derived anew by key.

Late rows need no watermark: every statistic is a function of the full series of its (patient, test), so a batch rewrites
what it touches. The checkpoint makes a restarted run carry on where it stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import ingest
from ..operators.parsing import GENERIC, Profile, parse_reports
from ..operators.store import Tables
from ..schemas import TABLES, conform, empty
from ..sources.profiles import LabProfile


def parse_stream(texts: DataFrame, profile: Profile = GENERIC) -> DataFrame:
    """Result rows of a stream of (doc_id, body)."""
    return parse_reports(texts, profile)


def ingest_available(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, profile: Profile = GENERIC) -> StreamingQuery:
    """Parses what is new under ``source`` (Parquet of doc_id, body) into ``target``, exactly once, then stops."""
    rows = parse_stream(spark.readStream.schema(schema).parquet(source), profile)
    return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_counts(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """Points per day and test with a watermark, for monitoring a running ingest."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Versions of a store that were written to their end."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [str(s.getPath().getName()) for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(sc._jvm.org.apache.hadoop.fs.Path(f"{store}/{n}/done")))


def open_store(spark: SparkSession, store: str, before: int | None = None) -> Tables:
    """The stored tables of the latest version (below ``before``, where given); empty ones where there is none."""
    known = [v for v in _versions(spark, store) if before is None or v < before]
    if not known:
        return {n: empty(spark, n) for n in TABLES}
    return {n: spark.read.schema(s).parquet(f"{store}/version={known[-1]}/{n}") for n, s in TABLES.items()}


def write_version(spark: SparkSession, store: str, version: int, tables: Tables) -> None:
    """Writes the tables as a version of the store, which counts once all are there."""
    for n, schema in TABLES.items():
        conform(tables[n], schema).write.mode("overwrite").parquet(f"{store}/version={version}/{n}")
    spark.range(1).write.mode("overwrite").parquet(f"{store}/version={version}/done")


def ingest_files(spark: SparkSession, source: str, store: str, checkpoint: str, profiles: Sequence[LabProfile], aliases: DataFrame, now: str) -> StreamingQuery:
    """Takes new files (Parquet of filename, file_hash, body) under ``source`` into the tables of ``store``, then stops.

    Each batch is a version of the store, made from the version before it. A batch that is run again, as after a failure,
    starts from the same version and writes its own once more, so nothing is taken twice.
    """

    def take(batch: DataFrame, number: int) -> None:
        write_version(spark, store, number, ingest(open_store(spark, store, before=number), batch, profiles, aliases, now))

    files = spark.readStream.schema("filename string, file_hash string, body string").parquet(source)
    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
