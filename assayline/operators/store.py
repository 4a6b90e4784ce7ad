"""Reports over the stored tables, and their changes as pure functions: tables in, new tables out.

Every change keeps the latest or the first row by a window over its key, fills columns by coalesce after an outer join, or
deletes by an anti-join that cascades along the parent keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, units

Tables = dict[str, DataFrame]

#: Rows that a task of a deletion's joins takes, about.
TASK_ROWS = 1_000_000
#: Tables with a patient's rows that go with the patient.
_OF_PATIENTS = ("targets", "bp_readings")


def keep_one(df: DataFrame, keys: list[str | Column], *order: Column | str) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


# Aggregations


def canonical_tests(results: DataFrame) -> DataFrame:
    """Per canonical id: a display name (the most frequent, ties to the greatest), unit, points, and whether ever out of range."""
    by_name = results.where("value_num IS NOT NULL").groupBy("canonical_id", "raw_name").agg(F.count("*").alias("n"), F.max("unit").alias("unit"), F.max(F.coalesce(F.col("flag").isin("alto", "bajo"), F.lit(False)).cast("int")).alias("out"))
    return by_name.groupBy("canonical_id").agg(F.max_by("raw_name", F.struct("n", "raw_name")).alias("name"), F.max("unit").alias("unit"), F.sum("n").alias("num_points"), F.max("out").alias("out_of_range"))


def canonical_groups(results: DataFrame) -> DataFrame:
    """Per canonical id: its variants (name, lab, n), names by falling count, labs and total."""
    v = results.groupBy("canonical_id", "raw_name", F.coalesce("lab", F.lit("")).alias("lab")).agg(F.count("*").alias("n"))
    names = v.groupBy("canonical_id", "raw_name").agg(F.sum("n").alias("n")).groupBy("canonical_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "raw_name"))), lambda x: x["raw_name"]).alias("names"))
    return v.groupBy("canonical_id").agg(F.sort_array(F.collect_list(F.struct("raw_name", "lab", "n"))).alias("variants"), F.sort_array(F.collect_set("lab")).alias("labs"), F.sum("n").alias("total")).join(names, "canonical_id")


def labs(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.coalesce("lab", F.lit("")).alias("lab")).agg(F.count("*").alias("n"))


def patients_with_counts(patients: DataFrame, reports: DataFrame) -> DataFrame:
    return patients.join(reports.groupBy(F.col("patient_id").alias("id")).agg(F.count("*").alias("num_reports")), "id", "left").withColumn("num_reports", F.coalesce("num_reports", F.lit(0)))


def patient_reports(reports: DataFrame, results: DataFrame) -> DataFrame:
    """Each report with its earliest sample date, else its request or validation date, and its number of results."""
    r = results.groupBy(F.col("report_id").alias("id")).agg(F.min("sample_date").alias("__s"), F.count("*").alias("num_results"))
    return reports.join(r, "id", "left").select("id", "patient_id", F.coalesce("__s", "request_date", "validation_date").alias("fecha"), F.coalesce("num_results", F.lit(0)).alias("num_results"))


def orphan_reports(reports: DataFrame, results: DataFrame, files: DataFrame) -> DataFrame:
    """Reports without results, or whose source file is gone."""
    counted = patient_reports(reports, results).select("id", "num_results").join(reports, "id")
    known = files.select(F.col("filename").alias("source_file"), F.lit(True).alias("__known")).distinct()
    return counted.join(known, "source_file", "left").withColumn("missing", F.col("source_file").isNotNull() & F.col("__known").isNull()).where("num_results = 0 OR missing").select("id", "patient_id", "num_results", "missing")


def stats(tables: Tables) -> DataFrame:
    """Counts, files by state and the span of dates, one row from one aggregate of each table."""
    one = lambda name, *a: tables[name].agg(*a)
    files = [F.count_if(F.col("status") == x).alias(f"files_{x}") for x in ("ok", "review", "error")]
    return (
        one("patients", F.count("*").alias("patients"))
        .join(one("reports", F.count("*").alias("reports"), F.min(F.coalesce("request_date", "validation_date")).alias("first"), F.max(F.coalesce("validation_date", "request_date")).alias("last")), how="cross")
        .join(one("results", F.count("*").alias("results"), F.count_if(F.col("flag_calc").isin("alto", "bajo")).alias("out_of_range")), how="cross")
        .join(one("processed_files", *files), how="cross")
    )


def co_occurring(results: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """Pairs of canonical ids in one report, and in how many: (a, b, reports)."""
    r = results.select("report_id", "canonical_id").distinct()
    r = r if ids is None else r.where(F.col("canonical_id").isin(*ids))
    a, b = r.alias("a"), r.alias("b")
    return a.join(b, (F.col("a.report_id") == F.col("b.report_id")) & (F.col("a.canonical_id") < F.col("b.canonical_id"))).groupBy(F.col("a.canonical_id").alias("a"), F.col("b.canonical_id").alias("b")).agg(F.count("*").alias("reports"))


def merge_check(results: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Every pair of the ids asked for (``canonical_id``; all that there are, if none are given), ids in order.

    ``blocked``: the pair shares reports and its codes are not the same non-empty set. Warnings hold for pairs that share no
    report as well: both have codes and none in common; both have units, of another size or dimension. The pairs of what is
    asked are the result, so ask for the groups that may merge.
    """
    own = lambda c: F.collect_set(F.nullif(c, F.lit("")))
    facts = results.groupBy("canonical_id").agg(F.array_sort(own("loinc_code")).alias("codes"), own("unit").alias("units"))
    if asked is not None:
        facts = asked.select("canonical_id").distinct().join(facts, "canonical_id", "left").select("canonical_id", *[F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("codes", "units")])
    a, b = (facts.select(*[F.col(c).alias(f"{c}_{k}") for c in facts.columns]) for k in "ab")
    shared = co_occurring(results if asked is None else results.join(asked.select("canonical_id").distinct(), "canonical_id", "left_semi"))
    p = a.join(b, F.col("canonical_id_a") < F.col("canonical_id_b")).join(shared.withColumnsRenamed({"a": "canonical_id_a", "b": "canonical_id_b"}), ["canonical_id_a", "canonical_id_b"], "left")
    coded = (F.size("codes_a") > 0) & (F.size("codes_b") > 0)
    relation = units.relation(F.col("units_a"), F.col("units_b"))
    warn_units = (F.size("units_a") > 0) & (F.size("units_b") > 0) & relation.isin("convertible", "incompatible")
    blocked = F.col("reports").isNotNull() & ~((F.size("codes_a") > 0) & (F.col("codes_a") == F.col("codes_b")))
    return p.select("canonical_id_a", "canonical_id_b", F.coalesce("reports", F.lit(0)).alias("reports"), blocked.alias("blocked"), (coded & ~F.arrays_overlap("codes_a", "codes_b")).alias("warn_codes"), warn_units.alias("warn_units"))


def ever_altered(s: DataFrame) -> DataFrame:
    """Last point of every series that was ever out of range."""
    from . import series as S

    ever = F.max(F.coalesce(F.col("flag").isin("alto", "bajo"), F.lit(False)).cast("int")).over(S.whole_series())
    return S.latest(s).drop("flag").join(S.flagged(s).withColumn("__e", ever).where("__e = 1").select(*S.KEY).distinct(), S.KEY, "left_semi")


def flat_results(tables: Tables) -> DataFrame:
    """All results with patient, effective date and report, for an export; no lab filter."""
    res, rep, pat = tables["results"], tables["reports"], tables["patients"]
    j = res.join(rep.withColumnRenamed("id", "report_id"), "report_id").join(pat.select(F.col("id").alias("patient_id"), "full_name"), "patient_id")
    return j.select("full_name", F.coalesce("sample_date", "request_date", "validation_date").alias("fecha"), "report_number", "lab", "section", "raw_name", "canonical_id", "value_raw", "value_num", "unit", "ref_low", "ref_high", "flag_calc")


# Changes


def already_processed(scanned: DataFrame, marks: DataFrame) -> DataFrame:
    """Scanned files (filename, file_hash) that still need work: no mark of the same content with status ok."""
    return scanned.join(marks.where("status = 'ok'").select("filename", "file_hash"), ["filename", "file_hash"], "left_anti")


def record_files(marks: DataFrame, new: DataFrame) -> DataFrame:
    """One mark per filename, the new one wins; in the new ones, the last processed."""
    both = marks.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    return keep_one(both, ["filename"], F.desc("__v"), F.desc("processed_at"), F.desc("id")).drop("__v")


def prune_files(marks: DataFrame, existing: DataFrame) -> DataFrame:
    return marks.join(existing.select("filename").distinct(), "filename", "left_semi")


def upsert_reports(reports: DataFrame, new: DataFrame) -> DataFrame:
    """By (patient, number): file, hash, lab, notes and assistance number are the newest given, id and dates those of the first
    import. Several new rows of one key come one after the other, by id."""
    k = F.struct(F.col("patient_id"), F.coalesce("report_number", F.lit("")))
    newest = {"source_file", "file_md5", "lab", "notes", "assistance_number"} & set(reports.columns)
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id")))
    fresh = new.groupBy(k.alias("__k")).agg(*[(last(c) if c in newest else F.min_by(c, "id")).alias(c) for c in reports.columns])
    j = reports.withColumn("__k", k).alias("o").join(fresh.alias("n"), "__k", "full_outer")
    first = lambda c: F.when(F.col("o.id").isNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return j.select(*[(F.coalesce(f"n.{c}", f"o.{c}") if c in newest else first(c)).alias(c) for c in reports.columns])


def replace_results(results: DataFrame, new: DataFrame) -> DataFrame:
    """The new rows take the place of all rows of their reports."""
    return results.join(new.select("report_id").distinct(), "report_id", "left_anti").select(results.columns).unionByName(new.select(results.columns))


def manual_report(patient_id: int, stamp: str, day: str, rows: DataFrame, report_id: int) -> tuple[DataFrame, DataFrame]:
    """A report typed in by hand: (report, results)."""
    from ..schemas import MANUAL_LAB, TABLES, conform

    spark = rows.sparkSession
    report = spark.createDataFrame([(report_id, patient_id, f"MANUAL-{stamp}", day, MANUAL_LAB)], "id long, patient_id long, report_number string, request_date string, lab string")
    return conform(report, TABLES["reports"]), conform(rows.withColumn("report_id", F.lit(report_id)), TABLES["results"])


def _tasks(*tables: DataFrame) -> int:
    """Tasks for joins of these tables, in proportion to the largest one's rows; 1 where adaptive execution may see to it."""
    spark = tables[0].sparkSession
    tasks = max(t.count() for t in tables) // TASK_ROWS + 1
    return tasks if tasks == 1 else max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _dealt(df: DataFrame, tasks: int, key: str) -> DataFrame:
    """Rows by ``key`` over so many tasks. Adaptive execution counts compressed bytes, of which ids have few: left to it, a
    task's rows, and what sorting them holds, grow with the tables."""
    return df if tasks == 1 else df.repartition(tasks, key)


def delete_reports(tables: Tables, ids: DataFrame) -> Tables:
    """Cascades to results; patients left without a report go, with their targets and readings."""
    tasks = _tasks(tables["reports"], tables["results"])
    cut = _dealt(ids.select("id"), tasks, "id").distinct().withColumn("__cut", F.lit(True))
    marked = _dealt(tables["reports"], tasks, "id").join(cut, "id", "left")
    reports = marked.where("__cut IS NULL").select(tables["reports"].columns)
    results = _dealt(tables["results"], tasks, "report_id").join(cut.select(F.col("id").alias("report_id")), "report_id", "left_anti").select(tables["results"].columns)
    tasks = _tasks(*(tables[k] for k in ("patients", "reports", *_OF_PATIENTS) if k in tables))
    whose = _dealt(marked.select("patient_id", F.col("__cut").isNotNull().alias("__cut")), tasks, "patient_id")
    gone = whose.groupBy(F.col("patient_id").alias("id")).agg(F.bool_and("__cut").alias("__all")).where("__all").select("id")
    return _without_patients({**tables, "reports": reports, "results": results}, gone, tasks)


def _without_patients(tables: Tables, ids: DataFrame, tasks: int) -> Tables:
    who = _dealt(ids.select(F.col("id").alias("patient_id")), tasks, "patient_id")
    out = {**tables, "patients": _dealt(tables["patients"], tasks, "id").join(who.select(F.col("patient_id").alias("id")), "id", "left_anti")}
    for name in _OF_PATIENTS:
        if name in tables:
            out[name] = _dealt(tables[name], tasks, "patient_id").join(who, "patient_id", "left_anti")
    return out


def delete_patients(tables: Tables, ids: DataFrame) -> Tables:
    tasks = _tasks(*(tables[k] for k in ("patients", "reports", *_OF_PATIENTS) if k in tables))
    who = _dealt(ids.select(F.col("id").alias("patient_id")), tasks, "patient_id")
    mine = _dealt(tables["reports"], tasks, "patient_id").join(who, "patient_id", "left_semi").select("id")
    return _without_patients(delete_reports(tables, mine), ids, tasks)


def clear_import(tables: Tables, filename: str) -> Tables:
    """Undoes the import of a file."""
    return delete_reports(tables, tables["reports"].where(F.col("source_file") == filename).select("id"))


def merge_patients(tables: Tables, mapping: DataFrame) -> Tables:
    """``mapping`` (source, target): sources go into their target one after the other, by id.

    Reports move; one whose number the target has by then goes, with its results and the mark of its file. The target's
    blanks are filled; an nhc of a source that is not the target's joins its ``nhc_alt``. Targets and readings move, the
    destination's own win, then those of the smallest source.
    """
    m = mapping.select(F.col("source").alias("__source"), F.col("target").alias("__target"))
    to = lambda df: df.join(m, df.patient_id == F.col("__source"), "left").withColumn("__from", F.col("__source")).withColumn("patient_id", F.coalesce("__target", "patient_id")).drop("__source", "__target")
    # rows that were there are first, as null comes before any source; of those without a number a patient may have several
    number, source = F.coalesce("report_number", F.lit("")), F.asc_nulls_first("__from")
    by = Window.partitionBy("patient_id", number)
    unnumbered = F.rank().over(by.orderBy(source, F.when(F.col("__from").isNotNull(), F.col("id"))))
    moved = to(tables["reports"]).withColumn("__rank", F.when(number == "", unnumbered).otherwise(F.row_number().over(by.orderBy(source, "id"))))
    reports = moved.where("__rank = 1").select(tables["reports"].columns)
    gone = moved.where("__rank > 1").select("id")
    out = {**tables, "reports": reports, "results": tables["results"].join(gone.select(F.col("id").alias("report_id")), "report_id", "left_anti").select(tables["results"].columns)}
    if "processed_files" in tables:
        marks = tables["processed_files"]
        out["processed_files"] = marks.join(gone.select(F.col("id").alias("report_id")), "report_id", "left_anti").select(marks.columns)
    columns = tables["patients"].columns
    fill = [c for c in columns if c not in ("id", "full_name", "name_key", "nhc_alt")]
    numbers = [F.transform(F.sort_array(F.collect_list(F.when(F.col("nhc").isNotNull(), F.struct("id", "nhc")))), lambda x: x["nhc"]).alias("__numbers")] if "nhc" in columns else []
    sources = tables["patients"].join(m, F.col("id") == F.col("__source")).groupBy("__target").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"__{c}") for c in fill], *numbers)
    kept = tables["patients"].join(mapping.select(F.col("source").alias("id")), "id", "left_anti").join(sources, F.col("id") == F.col("__target"), "left")
    picked = {c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in fill}
    if "nhc_alt" in columns and "nhc" in columns:
        more = F.filter(F.coalesce("__numbers", F.array().cast("array<string>")), lambda x: x != F.coalesce("nhc", "__nhc"))
        picked["nhc_alt"] = F.when(F.size(more) > 0, F.aggregate(more, F.coalesce("nhc_alt", F.lit("")), add_alternative)).otherwise(F.col("nhc_alt"))
    out["patients"] = kept.select(*[picked.get(c, F.col(c)).alias(c) for c in columns])
    for name, key in (("targets", "canonical_id"), ("bp_readings", "measured_at")):
        if name in tables:
            out[name] = keep_one(to(tables[name]), ["patient_id", key], F.asc_nulls_first("__from"), *([F.col("id")] if "id" in tables[name].columns else [])).select(tables[name].columns)
    return out


def refused_merges(results: DataFrame, mapping: DataFrame) -> DataFrame:
    """(target) of the merges in ``mapping`` (source, target) that must not be: two of the ids that would be one stand in one
    report, unless both have the same codes and at least one."""
    members = mapping.select("target", F.col("source").alias("canonical_id")).union(mapping.select("target", F.col("target").alias("canonical_id"))).distinct()
    own = results.join(members, "canonical_id").select("target", "canonical_id", "report_id", F.nullif("loinc_code", F.lit("")).alias("code"))
    codes = F.array_join(F.array_sort(F.collect_set("code")), "\n")
    coded = own.groupBy("target", "canonical_id").agg(codes.alias("codes"))
    # ids of one report that differ in codes, or have none, are in the way of each other
    ids = own.select("target", "canonical_id", "report_id").distinct().join(coded, ["target", "canonical_id"])
    met = ids.groupBy("target", "report_id").agg(F.count("*").alias("n"), F.min("codes").alias("lo"), F.max("codes").alias("hi"))
    return met.where("n > 1 AND (lo <> hi OR lo = '')").select("target").distinct()


def merge_canonical(results: DataFrame, targets: DataFrame, aliases: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``mapping`` (source, target): results and targets are renamed (the destination's target wins, then that of the smallest
    source), and every raw name of a source becomes an alias (alias, canonical_id) of its target. Merges that
    ``refused_merges`` names are left out as a whole."""
    m = mapping.join(refused_merges(results, mapping), "target", "left_anti").select("source", "target")
    renamed = lambda df: df.join(m, df.canonical_id == F.col("source"), "left")
    res = renamed(results)
    more = res.where("target IS NOT NULL").select(text.normalize_test_name(F.col("raw_name")).alias("alias"), F.col("target").alias("canonical_id")).where("alias <> ''").distinct()
    new = aliases.join(more.select("alias").distinct(), "alias", "left_anti").select("alias", "canonical_id").unionByName(more)
    put = lambda df: df.withColumn("canonical_id", F.coalesce("target", "canonical_id"))
    t = keep_one(put(renamed(targets)), ["patient_id", "canonical_id"], F.asc_nulls_first("source")).select(targets.columns)
    return put(res).select(results.columns), t, new


def set_targets(targets: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, refused): at least one bound, the lower one below the upper."""
    ok = F.coalesce("target_low", "target_high").isNotNull() & F.coalesce(F.col("target_low") < F.col("target_high"), F.lit(True))
    both = targets.withColumn("__v", F.lit(0)).unionByName(new.where(ok).withColumn("__v", F.lit(1)))
    return keep_one(both, ["patient_id", "canonical_id"], F.desc("__v"), F.desc("set_on")).drop("__v"), new.where(~ok)


def delete_rows(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti").select(table.columns)


def add_readings(readings: DataFrame, new: DataFrame) -> DataFrame:
    """The first reading of a patient's minute stays."""
    both = readings.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)))
    return keep_one(both, ["patient_id", "measured_at"], "__v", "id").drop("__v")


def validated_updates(edits: DataFrame, this_year: int, patients: DataFrame | None = None) -> DataFrame:
    """Edits of patients with ``error``: the first rule that fails; a patient who is no former smoker loses the period.

    An edit is a duplicate if another patient has its name and birth date: another edit, or a stored patient whom no edit
    changes. Without a birth date there are no duplicates.
    """
    year = lambda c: F.col(c).isNull() | F.col(c).between(1900, this_year)
    error = (
        F.when(F.coalesce(F.trim("full_name"), F.lit("")) == "", "full_name")
        .when(F.col("birth_date").isNotNull() & F.col("birth_date").try_cast("date").isNull(), "birth_date")
        .when(F.col("sex").isNotNull() & ~F.col("sex").isin("Hombre", "Mujer"), "sex")
        .when(~F.coalesce(F.col("smoker_current").isin(0, 1), F.lit(True)), "smoker_current")
        .when(~F.coalesce(F.col("smoker_former").isin(0, 1), F.lit(True)), "smoker_former")
        .when(~year("smoker_former_from") | ~year("smoker_former_to"), "year")
        .when(F.col("smoker_former_from") > F.col("smoker_former_to"), "period")
    )
    out = edits.withColumn("error", error).withColumn("name_key", text.normalize_name(F.col("full_name")))
    for c in ("smoker_former_from", "smoker_former_to"):
        out = out.withColumn(c, F.when(F.col("smoker_former") == 1, F.col(c)))
    people = out.select("id", "name_key", "birth_date")
    if patients is not None:
        people = people.unionByName(patients.join(edits.select("id"), "id", "left_anti").select("id", F.coalesce("name_key", text.normalize_name(F.col("full_name"))).alias("name_key"), "birth_date"))
    twice = people.groupBy("name_key", "birth_date").agg(F.count_distinct("id").alias("__n")).where("__n > 1")
    out = out.join(twice, ["name_key", "birth_date"], "left")
    return out.withColumn("error", F.coalesce("error", F.when(F.col("__n") > 1, "duplicate"))).select(*edits.columns, *(c for c in ("name_key", "error") if c not in edits.columns))


def add_alternative(values: Column, new: Column) -> Column:
    """A comma list as an ordered set, with one more."""
    items = F.filter(F.split(F.coalesce(values, F.lit("")), ","), lambda x: x != "")
    return F.array_join(F.array_distinct(F.when(F.coalesce(new, F.lit("")) == "", items).otherwise(F.concat(items, F.array(new)))), ",")


def drop_alternative(values: Column, old: Column) -> Column:
    return F.array_join(F.array_remove(F.filter(F.split(F.coalesce(values, F.lit("")), ","), lambda x: x != ""), F.coalesce(old, F.lit(""))), ",")


# Small reads and settings


def raw_names(results: DataFrame) -> DataFrame:
    """Every test name as it was written, once."""
    return results.select("raw_name").where("raw_name IS NOT NULL").distinct()


def patient_facts(patients: DataFrame, ids: DataFrame) -> DataFrame:
    """Birth date and sex of the patients asked for."""
    return patients.join(ids.select("id"), "id", "left_semi").select("id", "birth_date", "sex")


def files_to_review(marks: DataFrame) -> DataFrame:
    """Files whose import wants a look, with ``place`` from the newest on within each day of import."""
    by = Window.partitionBy(F.substring("processed_at", 1, 10)).orderBy(F.desc("processed_at"), F.desc("id"))
    return marks.where("status = 'review'").select("id", "filename", "processed_at", F.row_number().over(by).alias("place"))


def enough_points(tests: DataFrame, least: int) -> DataFrame:
    """Marks the tests of a list that have at least so many points."""
    return tests.withColumn("enough", F.col("num_points") >= least)


def put_settings(settings: DataFrame, new: DataFrame) -> DataFrame:
    """(key, value), the new value of a key in place of the old one."""
    return settings.join(new.select("key"), "key", "left_anti").select("key", "value").unionByName(new.select("key", "value"))


def heatmap_tests(results: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Tests that make the rows of a heat map: those ever out of range, or the ids asked for, with their points."""
    listed = canonical_tests(results)
    return (listed.where("out_of_range = 1") if ids is None else listed.join(ids.select("canonical_id").distinct(), "canonical_id", "left_semi")).select("canonical_id", "num_points")
