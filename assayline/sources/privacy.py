"""A scan of files for what must not be shared: kinds of files, and valid identity numbers in texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

#: Kinds of files that hold data of patients.
FORBIDDEN = ("pdf", "db", "db-wal", "db-shm", "sqlite", "sqlite3", "xlsx", "xls", "xlsm", "ods", "csv", "log")


def binary_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")


def findings(files: DataFrame, allowed: Sequence[str] = (), forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """(path, line, kind, mark) of each finding: ``file`` for a forbidden kind that isn't allowed by its path (line null), and
    ``identity`` for each number in a text whose check letter fits. Of a number only its last digits and letter are shown.

    Files that are no UTF-8 text are passed over, as is the content of forbidden ones. Lines count from 1. A null content
    has no lines.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    banned = kind.isin(*forbidden) & ~(F.col("path").isin(*allowed) if allowed else F.lit(False))
    marked = files.select("path", "content", banned.alias("banned"))
    by_kind = marked.where("banned").select("path", F.lit(None).cast("int").alias("line"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("mark"))
    body = F.try_validate_utf8(F.col("content").cast("string"))
    lines = marked.where("NOT banned").select("path", F.posexplode(F.split(body, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", -1)).alias("at", "body"))
    found = lines.select("path", (F.col("at") + 1).alias("line"), F.explode(F.regexp_extract_all("body", F.lit(r"(?U)\b([XYZ]?\d{7,8}[A-Z])\b"), F.lit(1))).alias("number"))
    valid = found.where(F.col("number").rlike(r"^(?:[XYZ]\d{7}|\d{8})[A-Z]$") & text.identity_valid(F.col("number")))
    return by_kind.unionByName(valid.select("path", "line", F.lit("identity").alias("kind"), F.concat(F.lit("…"), F.right("number", F.lit(3))).alias("mark")))
