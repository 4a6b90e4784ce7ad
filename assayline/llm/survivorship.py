"""Golden records: one record for each cluster of client rows, each field from the row that the survivorship rules prefer.

Dominance pruning comes before any shuffle. Each partition keeps, of a cluster's rows, only those that may still win a field:
the latest row with a segment; for each trust the latest with an e-mail, the latest among its longest names and the latest
among its fullest addresses; for each segment the latest with a balance. A row that a kept one beats in every slot can't win
anywhere, whatever other partitions hold: within one trust the latest row is fresh if any is, so staleness need not be known.
The survivors of a cluster are pruned again in salted parts and only then meet in grouped pandas, so a cluster with a third
of all rows sends a few rows a partition, and no task gathers more than the parts' survivors.

Staleness is counted apart: rows are counted by cluster and day, the days before the one that holds the cluster's threshold
are summed, and in that one day the rows are compared to the microsecond, joined on cluster and day, which spreads a large
cluster. Nothing is broadcast or collected.

A row without master_id and client_id belongs to the cluster null, which gets a record like any other. Sources other than the
four, null ones included, come last in trust. A balance that is not finite counts as null. Rows alike in updated_at, trust and
client_id are told apart by a hash of their values; rows that repeat count each time in n_records and n_stale. An empty table
gives no records. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .common import width


@dataclass(frozen=True)
class SurvivorshipParameters:
    #: Sources by falling trust.
    trust: tuple[str, ...] = ("crm", "web", "store", "partner")
    stale_hours: int = 60 * 24
    #: Salted parts in which a cluster's survivors are pruned before they meet.
    parts: int = 64
    #: Rows that a pruning task holds before it prunes, and survivors after which it starts anew.
    hold: int = 50_000
    most: int = 400_000
    #: Survivors of one group of the last step, about.
    group: int = 50_000


_DAY = 86_400_000_000
#: A record as it travels; ``none`` marks the cluster null, whose ``cluster`` is 0.
RECORD = "none int, cluster long, client_id long, trust int, updated long, tie long, name string, name_size int, email string, city string, nation_id int, filled int, segment string, balance double"
GOLDEN = "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id int, balance_cents long, name_from long, email_from long, segment_from long, balance_from long, address_from long"
_NULLABLE = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}.get
_KEY = ["none", "cluster"]


def _micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone."""
    seconds = F.datediff(F.to_date(at), F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(at) * 3600 + F.minute(at) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), at) * 1_000_000).cast("long")


def records(clients: DataFrame, p: SurvivorshipParameters = SurvivorshipParameters()) -> DataFrame:
    """The rows as ``RECORD``, blank strings null."""
    text = lambda c: F.when(F.col(c).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.col(c).cast("string")).alias(c)
    plain = clients.select(
        F.col("master_id").cast("long").alias("master_id"), F.col("client_id").cast("long").alias("client_id"), _micros(F.col("updated_at").cast("timestamp_ntz")).alias("updated"),
        *map(text, ("source", "name", "email", "city", "segment")), F.col("nation_id").cast("int").alias("nation_id"),
        F.when(F.abs(F.col("balance").cast("double")) < float("inf"), F.col("balance").cast("double")).alias("balance"),
    )
    cluster = F.coalesce("master_id", "client_id")
    trust = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(p.trust)], F.lit(len(p.trust)))
    return plain.select(
        cluster.isNull().cast("int").alias("none"), F.coalesce(cluster, F.lit(0).cast("long")).alias("cluster"), "client_id", trust.alias("trust"), "updated",
        F.xxhash64("source", "name", "email", "city", "nation_id", "segment", "balance").alias("tie"), "name", F.char_length("name").alias("name_size"), "email", "city", "nation_id",
        (F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")).alias("filled"), "segment", "balance",
    )


def _by_recency(rows: pd.DataFrame) -> pd.DataFrame:
    """Clusters in order, in each the latest row first (null last), then higher trust, then the smaller client_id."""
    return rows.sort_values([*_KEY, "updated", "trust", "client_id", "tie"], ascending=[True, True, False, True, True, True], na_position="last", kind="stable", ignore_index=True)


def _longest(rows: pd.DataFrame, size: str) -> pd.DataFrame:
    return rows[rows[size] == rows.groupby(_KEY)[size].transform("max")]


def prune(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that win a slot among these: whatever else a cluster holds, no other row can win a field."""
    rows = _by_recency(rows)
    slots = (
        rows[rows.segment.notna()].drop_duplicates(_KEY),
        rows[rows.email.notna()].drop_duplicates([*_KEY, "trust"]),
        _longest(rows[rows.name.notna()], "name_size").drop_duplicates([*_KEY, "trust"]),
        _longest(rows[rows.filled > 0], "filled").drop_duplicates([*_KEY, "trust"]),
        rows[rows.balance.notna()].drop_duplicates([*_KEY, "segment"]),
    )
    keep = slots[0].index
    for s in slots[1:]:
        keep = keep.union(s.index)
    return rows.loc[keep]


def survivors(rows: DataFrame, p: SurvivorshipParameters) -> DataFrame:
    """``prune`` within each partition."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        n = kept = 0
        schema = None
        for b in batches:
            b = b.select(names)
            schema = b.schema
            held.append(b.to_pandas(types_mapper=_NULLABLE))
            n += len(held[-1])
            if n - kept > max(p.hold, kept):
                held = [prune(pd.concat(held))]
                n = kept = len(held[0])
                if kept > p.most:
                    yield pa.RecordBatch.from_pandas(held.pop(), schema, preserve_index=False)
                    n = kept = 0
        if n:
            yield pa.RecordBatch.from_pandas(prune(pd.concat(held)), schema, preserve_index=False)

    return rows.mapInArrow(run, RECORD)


def counts(rows: DataFrame, p: SurvivorshipParameters) -> DataFrame:
    """(none, cluster, n_records, n_stale, threshold), to be summed by cluster; the threshold is null without any updated_at."""
    moments = rows.select(*_KEY, "updated", F.expr(f"updated div {_DAY} - if(updated % {_DAY} < 0, 1, 0)").alias("day"))
    days = moments.groupBy(*_KEY, "day").agg(F.count("*").alias("n"), F.max("updated").alias("latest"))
    threshold = F.col("latest") - p.stale_hours * 3_600_000_000
    total = days.groupBy(*_KEY).agg(F.sum("n").alias("n_records"), F.max("latest").alias("latest"), F.collect_list(F.struct("day", "n")).alias("days"))
    total = stored(total.withColumn("threshold", threshold).withColumn("edge", F.expr(f"threshold div {_DAY} - if(threshold % {_DAY} < 0, 1, 0)")))
    before = F.filter("days", lambda d: d["day"].isNull() | F.col("edge").isNull() | (d["day"] < F.col("edge")))
    whole = total.select(*_KEY, "n_records", F.aggregate(before, F.lit(0).cast("long"), lambda s, d: s + d["n"]).alias("n_stale"), "threshold")
    # the day that holds the threshold, where the cluster has rows in it
    edge = total.where(F.exists("days", lambda d: d["day"] == F.col("edge"))).select(*_KEY, F.col("edge").alias("day"), "threshold").hint("merge")
    part = moments.join(edge, [*_KEY, "day"]).where("updated < threshold").groupBy(*_KEY).agg(F.count("*").alias("n_stale"))
    return whole.unionByName(part.select(*_KEY, F.lit(0).cast("long").alias("n_records"), "n_stale", F.lit(None).cast("long").alias("threshold")))


def resolve(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Golden records of some clusters, from their survivors and the sums of ``counts``."""
    out = known.groupby(_KEY, as_index=False).agg({"n_records": "sum", "n_stale": "sum", "threshold": "max"})
    rows = _by_recency(rows.merge(out[[*_KEY, "threshold"]], on=_KEY))
    fresh = (rows.updated.notna() & rows.threshold.notna() & (rows.updated >= rows.threshold).fillna(False)).astype(bool)
    trusted = rows.assign(stale=~fresh, recent=range(len(rows))).sort_values([*_KEY, "stale", "trust", "recent"], ignore_index=True)

    def take(found: pd.DataFrame, source: str, *fields: str) -> None:
        nonlocal out
        first = found.drop_duplicates(_KEY)[[*_KEY, "client_id", *fields]].rename(columns={"client_id": source})
        out = out.merge(first, on=_KEY, how="left")

    take(rows[rows.segment.notna()], "segment_from", "segment")
    take(trusted[trusted.email.notna()], "email_from", "email")
    take(_longest(trusted[trusted.name.notna()], "name_size"), "name_from", "name")
    take(_longest(trusted[trusted.filled > 0], "filled"), "address_from", "city", "nation_id")
    paid = rows[rows.balance.notna()].merge(out[[*_KEY, "segment"]].rename(columns={"segment": "chosen"}), on=_KEY)
    other = ~(paid.segment.notna() & (paid.segment == paid.chosen)).astype(bool)
    take(paid.assign(other=other, recent=range(len(paid))).sort_values([*_KEY, "other", "recent"]), "balance_from", "balance")
    return out


def golden(clients: DataFrame, p: SurvivorshipParameters = SurvivorshipParameters()) -> DataFrame:
    """One row for each cluster, as ``GOLDEN``."""
    rows = records(clients, p)
    salt = F.pmod(F.spark_partition_id(), F.lit(p.parts))
    kept = survivors(rows, p).withColumn("salt", salt).repartition(width(clients.sparkSession), *_KEY, "salt")
    kept = stored(survivors(kept, p))
    known = counts(rows, p)
    groups = int(max(width(clients.sparkSession), kept.count() // p.group + 1))
    bucket = F.pmod(F.xxhash64(*_KEY), F.lit(groups)).alias("bucket")
    schema = pa.schema([(x.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[x.split()[1]]) for x in GOLDEN.split(", ")])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        out = resolve(left.to_pandas(types_mapper=_NULLABLE), right.to_pandas(types_mapper=_NULLABLE))
        cents = np.floor(100 * out.balance.astype("float64") + 0.5)
        # beyond the range of a long there is no value
        out["balance_cents"] = cents.where(cents.abs() < 2.0**63).astype("Int64")
        out["cluster_id"] = out.cluster.where(out.none == 0, None)
        return pa.Table.from_pandas(out[schema.names], schema, preserve_index=False)

    return kept.groupBy(bucket).cogroup(known.groupBy(bucket)).applyInArrow(run, GOLDEN)


SQL = r"""
WITH r AS (
  SELECT coalesce(master_id, client_id) AS cluster_id, client_id, updated_at, nation_id,
         CASE source WHEN 'crm' THEN 0 WHEN 'web' THEN 1 WHEN 'store' THEN 2 WHEN 'partner' THEN 3 ELSE 4 END AS trust,
         CASE WHEN regexp_matches(name, '[^\x20\x09-\x0D]') THEN name END AS name, CASE WHEN regexp_matches(email, '[^\x20\x09-\x0D]') THEN email END AS email,
         CASE WHEN regexp_matches(city, '[^\x20\x09-\x0D]') THEN city END AS city, CASE WHEN regexp_matches(segment, '[^\x20\x09-\x0D]') THEN segment END AS segment,
         CASE WHEN isfinite(balance) THEN balance END AS balance
  FROM clients
), s AS (
  SELECT *, coalesce(updated_at < max(updated_at) OVER (PARTITION BY cluster_id) - INTERVAL 1440 HOUR, true) AS stale,
         row_number() OVER (PARTITION BY cluster_id ORDER BY updated_at DESC NULLS LAST, trust, client_id) AS recent,
         (city IS NOT NULL)::INT + (nation_id IS NOT NULL)::INT AS filled FROM r
), t AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stale, trust, recent) AS trusted,
         first_value(segment) OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS chosen FROM s
), u AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY name IS NULL, length(name) DESC, trusted) AS by_name,
         row_number() OVER (PARTITION BY cluster_id ORDER BY filled DESC, trusted) AS by_address,
         row_number() OVER (PARTITION BY cluster_id ORDER BY balance IS NULL, coalesce(segment = chosen, false) DESC, recent) AS by_balance,
         row_number() OVER (PARTITION BY cluster_id ORDER BY email IS NULL, trusted) AS by_email,
         row_number() OVER (PARTITION BY cluster_id ORDER BY segment IS NULL, recent) AS by_segment FROM t
)
SELECT cluster_id, count(*) AS n_records, count(*) FILTER (stale) AS n_stale,
       max(name) FILTER (by_name = 1) AS name, max(email) FILTER (by_email = 1) AS email, max(segment) FILTER (by_segment = 1) AS segment,
       max(city) FILTER (by_address = 1) AS city, max(nation_id) FILTER (by_address = 1) AS nation_id,
       CAST(floor(100 * max(balance) FILTER (by_balance = 1) + 0.5) AS BIGINT) AS balance_cents,
       max(client_id) FILTER (by_name = 1 AND name IS NOT NULL) AS name_from, max(client_id) FILTER (by_email = 1 AND email IS NOT NULL) AS email_from,
       max(client_id) FILTER (by_segment = 1 AND segment IS NOT NULL) AS segment_from, max(client_id) FILTER (by_balance = 1 AND balance IS NOT NULL) AS balance_from,
       max(client_id) FILTER (by_address = 1 AND filled > 0) AS address_from
FROM u GROUP BY cluster_id
"""
