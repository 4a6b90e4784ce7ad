"""Files in and out: report texts, marks of what was read, small CSV dimensions, parser profiles, exports."""

from __future__ import annotations

import tomllib
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.parsing import Profile
from ..schemas import VARIATION


def report_texts(spark: SparkSession, path: str, recursive: bool = True, glob: str = "*.txt") -> DataFrame:
    """(filename, file_hash, doc_id, body) of extracted report texts; the hash is of the bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.md5("content").alias("file_hash"), F.xxhash64("path").alias("doc_id"), F.decode("content", F.lit("UTF-8")).alias("body"))


def known_files(spark: SparkSession, paths: Iterable[str], glob: str = "*") -> DataFrame:
    """Names under any of the folders."""
    one = lambda p: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(p).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"))
    out = None
    for p in paths:
        out = one(p) if out is None else out.union(one(p))
    return out.distinct()


def _csv(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return spark.read.options(header="true", comment="#", ignoreLeadingWhiteSpace="true", ignoreTrailingWhiteSpace="true", **options).csv(path)


def variation_table(spark: SparkSession, path: str) -> DataFrame:
    """The dimension of biological variation; blank ids are skipped, of a repeated id the last row counts."""
    from ..schemas import conform

    raw = conform(_csv(spark, path).withColumn("__at", F.monotonically_increasing_id()), VARIATION).withColumn("__at", F.monotonically_increasing_id())
    rows = raw.where(F.coalesce("canonical_id", F.lit("")) != "")
    return rows.groupBy("canonical_id").agg(*[F.max_by(c, "__at").alias(c) for c in VARIATION.fieldNames()[1:]])


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical_id) from a CSV whose first two columns they are."""
    raw = _csv(spark, path)
    a, c = raw.columns[:2]
    return raw.select(text.normalize_test_name(F.col(a)).alias("alias"), F.col(c).alias("canonical_id")).where("alias <> ''")


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(canonical_id, description) from one text file for each id; blank ones are none."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]+$", 1).alias("canonical_id"), F.trim("value").alias("description"))
    return raw.where("description <> ''")


#: Column of a pressure file by its header without accents, case or brackets (fixed values).
HEADERS = {
    "fecha": "measured_at", "fecha y hora": "measured_at", "fecha/hora": "measured_at", "date": "measured_at", "measured_at": "measured_at",
    "sistolica": "systolic", "sis": "systolic", "systolic": "systolic", "sys": "systolic", "alta": "systolic",
    "diastolica": "diastolic", "dia": "diastolic", "diastolic": "diastolic", "baja": "diastolic",
    "pulso": "pulse", "pulse": "pulse", "ppm": "pulse", "lugar": "place", "place": "place", "nota": "note", "notas": "note", "note": "note",
}


#: What bytes 0x80 to 0x9F are in the Windows code page; those that it leaves open stay as they are.
_WINDOWS = "".join(bytes([i]).decode("cp1252", "ignore") or chr(i) for i in range(0x80, 0xA0))

def decoded(content: Column) -> Column:
    """Text of a file's bytes: UTF-8 where they are that, else the Windows code page; without a mark of byte order."""
    raw = content.cast("string")
    windows = F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, range(0x80, 0xA0))), _WINDOWS)
    return F.regexp_replace(F.when(F.is_valid_utf8(raw), raw).otherwise(windows), "^\ufeff", "")


def header_name(x: Column) -> Column:
    """The column that a printed header names, null if none."""
    key = F.lower(text.strip_accents(F.regexp_replace(x, r"\(.*?\)", "")))
    key = F.trim(F.regexp_replace(F.replace(key, F.lit("_"), F.lit(" ")), r"\s+", " "))
    known = {k.replace("_", " "): v for k, v in HEADERS.items()}
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), key)


def pressure_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readings, errors) of files (path, content), each in its own encoding, with its own delimiter and order of columns.

    Readings are text columns for ``pressure.validated`` with path and line (the header's is 1); blank rows are skipped. The
    delimiter is the most frequent of ; , and tab in the header, ; where there is none; of columns of one name the first counts.
    A file that lacks a column it needs, or has no line, has one error and no readings.
    """
    body = files.select("path", F.split(decoded(F.col("content")), r"\r\n|\n|\r", -1).alias("lines"))
    count = lambda c: F.char_length("header") - F.char_length(F.replace("header", F.lit(c), F.lit("")))
    body = body.withColumn("header", F.col("lines")[0])
    most = F.greatest(*[count(c) for c in ";,\t"])
    sep = F.when(most == count(";"), ";").when(most == count(","), ",").otherwise("\t")

    def cells(line: Column) -> Column:
        """The cells of a line in its file's delimiter, quotes taken off."""
        one = lambda c: F.regexp_extract_all(F.concat(F.lit(c), line), F.lit(rf'{c}("(?:[^"]|"")*"|[^{c}]*)'), F.lit(1))
        found = F.when(F.col("sep") == ";", one(";")).when(F.col("sep") == ",", one(",")).otherwise(one("\t"))
        return F.transform(found, lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x))

    body = body.withColumn("sep", sep)
    body = body.withColumn("columns", F.transform(cells(F.col("header")), header_name))
    missing = F.array_compact(F.array(*[F.when(~F.array_contains(F.array_compact("columns"), c), c) for c in ("measured_at", "systolic", "diastolic")]))
    body = body.withColumn("error", F.when(F.coalesce(F.trim(F.array_join("lines", "")), F.lit("")) == "", "the file is empty").when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.array_join(missing, ", "))))
    errors = body.where("error IS NOT NULL").select("path", "error")
    rows = body.where("error IS NULL").select("path", "sep", "columns", F.posexplode("lines").alias("at", "text")).where((F.col("at") > 0) & (F.trim("text") != ""))
    rows = rows.select("path", (F.col("at") + 1).alias("line"), "columns", cells(F.col("text")).alias("cells"))
    pick = lambda c: F.trim(F.try_element_at("cells", F.array_position("columns", F.lit(c)).cast("int"))).alias(c)
    names = ("measured_at", "systolic", "diastolic", "pulse", "place", "note")
    found = rows.select("path", "line", *[F.when(F.array_contains(F.array_compact("columns"), c), pick(c)).alias(c) for c in names])
    return found.where(F.concat_ws("", *names) != ""), errors


def pressure_readings(spark: SparkSession, path: str) -> DataFrame:
    """Raw readings of one file, as text columns for ``pressure.validated``; blank rows are skipped, and a file that can't be
    read is an error."""
    found, errors = pressure_files(spark.read.format("binaryFile").load(path).select("path", "content"))
    if bad := errors.first():
        raise ValueError(bad["error"])
    return found.drop("path", "line")


def load_profiles(paths: Iterable[str]) -> list[Profile]:
    """Profiles from TOML files, by priority, then name."""
    out = []
    for p in paths:
        with open(p, "rb") as f:
            d = tomllib.load(f)
        out.append(Profile(d["name"], int(d.get("priority", 100)), tuple(d.get("signatures", ())), dict(d.get("labels", {})), tuple(d.get("stop", ()))))
    return sorted(out, key=lambda p: (p.priority, p.name))


def defused(df: DataFrame) -> DataFrame:
    """Every text cell made safe for spreadsheets."""
    return df.select(*[text.defuse_formula(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])


def export_csv(df: DataFrame, path: str, single: bool = False, mark: bool = False) -> None:
    """Defused CSV with a header; one file only where asked for. ``mark``: with the mark of byte order that spreadsheets look
    for in front of the header."""
    out = defused(df)
    if mark and out.columns:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    (out.coalesce(1) if single else out).write.mode("overwrite").option("header", "true").csv(path)


def column_widths(df: DataFrame, least: int = 10, most: int = 40) -> DataFrame:
    """(column, width) for a sheet: the longest text and two, within bounds."""
    longest = df.agg(*[F.max(F.length(F.col(c).cast("string"))).alias(c) for c in df.columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.least(F.greatest(F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(len(c))) + 2, F.lit(least)), F.lit(most)).alias("width")) for c in df.columns]))
    return longest.select(pairs.alias("x")).select("x.*")


def pages(df: DataFrame, *order: str, rows: int = 25, parts: int | None = None) -> DataFrame:
    """Adds page and pages in a total order by the columns.

    Rows are dealt by ranges of the order, numbered within their range, and moved on by the ranges before, so no task holds
    more than its range. The sums of the ranges, one row each, are all that is broadcast.
    """
    from pyspark.sql import Window

    from ..storage import stored

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # ranges are cut by a sample, so they are written once and read by both sides
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    a, b = counts.alias("a"), counts.alias("b")
    before = a.join(b, F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__all"))
    n = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) + F.col("__before")
    out = ranged.join(F.broadcast(before), "__part").join(F.broadcast(total))
    return out.withColumn("page", F.ceil(n / rows)).withColumn("pages", F.ceil(F.col("__all") / rows)).drop("__part", "__n", "__before", "__all")
