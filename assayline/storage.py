"""Intermediate tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one, on local masters only."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where is None and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if where is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="assayline-")
        sc.setCheckpointDir(where)
    return where


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet into the shared folder and read from there.

    The files go with ``dropped``, or when the driver's JVM ends.
    """
    spark = df.sparkSession
    sc, where = spark.sparkContext, f"{shared_folder(spark)}/assayline-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(where)
    out._folder = where
    return out


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """As ``stored``, in so many buckets by ``key``, a long, and of rows that share one only one: joins on it deal the other
    side's rows alone, however often they come.

    With as many buckets as shuffle partitions at least, or else the join would deal both sides anew.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            fresh = []
            for x in b.column(key).to_pylist():
                fresh.append(x not in met)
                met.add(x)
            yield b if all(fresh) else b.filter(pa.array(fresh))

    spark = df.sparkSession
    sc, name = spark.sparkContext, f"assayline_{uuid.uuid4().hex}"
    where = f"{shared_folder(spark)}/{name}"
    df.repartition(buckets, key).mapInArrow(once, df.schema).write.format("parquet").bucketBy(buckets, key).option("path", where).saveAsTable(name)
    path = sc._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    out = spark.table(name)
    out._folder, out._table = where, name
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of stored tables that nothing will read again, and lets the shuffle files behind them go."""
    for df in frames:
        sc = df.sparkSession.sparkContext
        if table := getattr(df, "_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        path = sc._jvm.org.apache.hadoop.fs.Path(df._folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def freed(spark: SparkSession) -> None:
    """Shuffle files go once the driver's collector finds that no plan needs them; on disks that fill, that is worth asking for."""
    spark.sparkContext._jvm.System.gc()
