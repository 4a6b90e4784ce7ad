"""Changes of stored tables, small reads, audit and text rules, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indices, text
from ..operators import audit, store
from ..operators import series as S
from ..schemas import TABLES, conform, table
from ..sources import files
from ..sources.adapters import BY_PRIORITY, orders_series, read

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def tables(spark: SparkSession, sf: str) -> store.Tables:
    """Customers as patients with a target each, orders as reports, lines as results, events as readings."""
    c, o, li, e = (read(spark, sf, t) for t in ("customer", "orders", "lineitem", "events"))
    s = lambda x: F.col(x).cast("string")
    test = F.col("l_partkey") % 37
    rows = {
        "patients": c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.upper("c_name").alias("name_key"), F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-05-06"))).alias("birth_date"), F.when(F.col("c_custkey") % 2 == 0, "Mujer").otherwise("Hombre").alias("sex")),
        "reports": o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"), F.concat(F.lit("n"), s("o_orderkey")).alias("report_number"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("request_date"), F.concat(F.lit("f"), (F.col("o_orderkey") % 100).cast("string")).alias("source_file"), F.concat(F.lit("h"), s("o_orderkey")).alias("file_md5"), F.col("o_orderstatus").alias("lab")),
        "results": li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("report_id"), F.concat(F.lit("Test "), test, F.when(F.col("l_returnflag") == "R", " suero").otherwise("")).alias("raw_name"), F.concat(F.lit("t"), test).alias("canonical_id"), F.when(test < 30, F.concat(F.lit("c"), test % 25)).alias("loinc_code"), F.col("l_quantity").alias("value_num"), F.when(test % 3 == 0, F.when(F.col("l_linestatus") == "F", "g/L").otherwise("mg/dL")).otherwise("mmol/L").alias("unit"), F.when(F.col("l_linenumber") % 2 == 0, F.date_format("l_shipdate", "yyyy-MM-dd")).alias("sample_date"), F.col("l_returnflag").alias("lab")),
        "targets": c.select(F.col("c_custkey").alias("patient_id"), F.concat(F.lit("t"), F.col("c_custkey") % 37).alias("canonical_id"), F.lit(1.0).alias("target_low"), F.lit(9.0).alias("target_high"), F.lit("2020-01-01").alias("set_on")),
        "bp_readings": e.select(F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("measured_at"), F.col("value").cast("int").alias("systolic")),
    }
    return {k: conform(v, TABLES[k]) for k, v in rows.items()} | {"results_with_lab": rows["results"]}


_T = """pat AS (SELECT c_custkey AS id, c_name AS full_name FROM customer),
rep AS (SELECT o_orderkey AS id, o_custkey AS patient_id, 'n' || o_orderkey AS report_number, strftime(o_orderdate, '%Y-%m-%d') AS request_date, 'f' || o_orderkey % 100 AS source_file, 'h' || o_orderkey AS file_md5, o_orderstatus AS lab FROM orders),
res AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS report_id, 'Test ' || l_partkey % 37 || CASE WHEN l_returnflag = 'R' THEN ' suero' ELSE '' END AS raw_name, 't' || l_partkey % 37 AS canonical_id, CASE WHEN l_partkey % 37 < 30 THEN 'c' || (l_partkey % 37) % 25 END AS loinc_code, l_quantity AS value_num,
  CASE WHEN (l_partkey % 37) % 3 = 0 THEN CASE WHEN l_linestatus = 'F' THEN 'g/L' ELSE 'mg/dL' END ELSE 'mmol/L' END AS unit, CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS sample_date, l_returnflag AS lab FROM lineitem),
tar AS (SELECT c_custkey AS patient_id, 't' || c_custkey % 37 AS canonical_id FROM customer)"""


@query(f"WITH {_T} SELECT res.id AS k, full_name, coalesce(sample_date, request_date) AS fecha, report_number, rep.lab, raw_name, canonical_id, value_num, unit FROM res JOIN rep ON rep.id = report_id JOIN pat ON pat.id = patient_id")
def flat_export(spark: SparkSession, sf: str) -> DataFrame:
    """B7, D2j: every result with its patient and report, value_raw standing for its key."""
    t = tables(spark, sf)
    t["results"] = t["results"].withColumn("value_raw", F.col("id").cast("string")).drop("id")
    out = store.flat_results(t)
    return out.select(F.col("value_raw").cast("long").alias("k"), "full_name", "fecha", "report_number", "lab", "raw_name", "canonical_id", "value_num", "unit")


def _marks(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    return conform(o.select(k.alias("id"), F.concat(F.lit("f"), k).alias("filename"), F.concat(F.lit("h"), k % 2).alias("file_hash"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("processed_at"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("review").alias("status")), TABLES["processed_files"])


@query("SELECT 'f' || o_orderkey AS filename, 'h' || o_orderkey % 3 AS file_hash FROM orders WHERE NOT (o_orderkey % 3 = o_orderkey % 2 AND o_orderstatus = 'F')")
def files_to_process(spark: SparkSession, sf: str) -> DataFrame:
    """The same content with state ok is skipped."""
    m = _marks(spark, sf)
    return store.already_processed(m.select("filename", F.concat(F.lit("h"), F.col("id") % 3).alias("file_hash")), m)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 0")
def prune_marks(spark: SparkSession, sf: str) -> DataFrame:
    """E: marks whose file is gone go."""
    m = _marks(spark, sf)
    return store.prune_files(m, m.where("id % 4 <> 0").select("filename")).select("id")


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS processed_at, row_number() OVER (PARTITION BY o_orderdate ORDER BY o_orderkey DESC) AS place FROM orders WHERE o_orderstatus <> 'F'")
def review_list(spark: SparkSession, sf: str) -> DataFrame:
    """C11."""
    return store.files_to_review(_marks(spark, sf)).select("id", "processed_at", "place")


@query(f"""WITH {_T}, old AS (SELECT * FROM rep WHERE patient_id % 2 = 0), new AS (SELECT id + 1000000000 AS id, patient_id, report_number, '2030-01-01' AS request_date, CASE WHEN id % 5 <> 0 THEN 'x' || id END AS source_file, CASE WHEN id % 7 <> 0 THEN 'N' END AS lab FROM rep WHERE id % 3 <> 0)
SELECT coalesce(old.id, new.id) AS id, report_number, CASE WHEN old.id IS NULL THEN new.request_date ELSE old.request_date END AS request_date, coalesce(new.source_file, old.source_file) AS source_file, coalesce(new.lab, old.lab) AS lab FROM old FULL JOIN new USING (patient_id, report_number)""")
def report_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """File and lab newest if given, dates and id of the first import kept."""
    rep, k = tables(spark, sf)["reports"], F.col("id")
    new = rep.where("id % 3 <> 0").withColumns({"request_date": F.lit("2030-01-01"), "source_file": F.when(k % 5 != 0, F.concat(F.lit("x"), k)), "lab": F.when(k % 7 != 0, "N"), "id": k + 1000000000})
    return store.upsert_reports(rep.where("patient_id % 2 = 0"), new).select("id", "report_number", "request_date", "source_file", "lab")


@query(f"WITH {_T} SELECT id, report_id, value_num FROM res WHERE report_id % 4 <> 0 UNION ALL SELECT id, report_id, value_num FROM res WHERE report_id % 4 = 0 AND report_id NOT IN (SELECT report_id FROM res WHERE id % 10 = 1) UNION ALL SELECT id, report_id, -1.0 FROM res WHERE report_id % 4 = 0 AND id % 10 = 1")
def results_replaced(spark: SparkSession, sf: str) -> DataFrame:
    """A report that is read again loses its old rows."""
    res = tables(spark, sf)["results"]
    return store.replace_results(res, res.where("report_id % 4 = 0 AND id % 10 = 1").withColumn("value_num", F.lit(-1.0))).select("id", "report_id", "value_num")


def _ids(t: store.Tables) -> DataFrame:
    kinds = {"patients": "id", "reports": "id", "results": "id", "targets": "patient_id"}
    out = None
    for k, c in kinds.items():
        one = t[k].select(F.lit(k).alias("kind"), F.col(c).cast("long").alias("id"))
        out = one if out is None else out.unionByName(one)
    return out


_LEFT = "gone AS (SELECT patient_id FROM rep GROUP BY 1 HAVING bool_and({cut})) SELECT 'patients' AS kind, id FROM pat WHERE id NOT IN (SELECT patient_id FROM gone) UNION ALL SELECT 'reports', id FROM rep WHERE NOT ({cut}) UNION ALL SELECT 'results', id FROM res WHERE report_id NOT IN (SELECT id FROM rep WHERE {cut}) UNION ALL SELECT 'targets', patient_id FROM tar WHERE patient_id NOT IN (SELECT patient_id FROM gone)"


@query(f"WITH {_T}, " + _LEFT.format(cut="id % 3 = 0"))
def reports_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """Results go with their reports, and patients left without a report, with their targets."""
    t = tables(spark, sf)
    return _ids(store.delete_reports(t, t["reports"].where("id % 3 = 0").select("id")))


@query(f"WITH {_T}, " + _LEFT.format(cut="source_file = 'f7'"))
def import_undone(spark: SparkSession, sf: str) -> DataFrame:
    """E8."""
    return _ids(store.clear_import(tables(spark, sf), "f7"))


@query(f"WITH {_T} SELECT 'patients' AS kind, id FROM pat WHERE id % 4 <> 0 UNION ALL SELECT 'reports', id FROM rep WHERE patient_id % 4 <> 0 UNION ALL SELECT 'results', res.id FROM res JOIN rep ON rep.id = report_id WHERE patient_id % 4 <> 0 UNION ALL SELECT 'targets', patient_id FROM tar WHERE patient_id % 4 <> 0")
def patients_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """E7, E12."""
    t = tables(spark, sf)
    return _ids(store.delete_patients(t, t["patients"].where("id % 4 = 0").select("id")))


@query(f"""WITH {_T}, asked(source, target) AS (VALUES ('t25', 't0'), ('t26', 't1'), ('t3', 't2'), ('t5', 't2'), ('t31', 't30')), who AS (SELECT target AS g, source AS id FROM asked UNION SELECT target, target FROM asked),
seen AS (SELECT DISTINCT g, who.id, report_id, loinc_code FROM who JOIN res ON canonical_id = who.id), bad AS (SELECT DISTINCT a.g FROM seen a JOIN seen b ON a.g = b.g AND a.id < b.id AND a.report_id = b.report_id WHERE a.loinc_code IS NULL OR b.loinc_code IS NULL OR a.loinc_code <> b.loinc_code),
m AS (SELECT * FROM asked WHERE target NOT IN (SELECT g FROM bad))
SELECT 'result' AS kind, coalesce(target, canonical_id) AS id, count(*) AS n FROM res LEFT JOIN m ON source = canonical_id GROUP BY 1, 2
UNION ALL SELECT 'alias', lower(raw_name) || '=' || target, 1 FROM (SELECT DISTINCT raw_name, target FROM res JOIN m ON source = canonical_id) UNION ALL SELECT 'target', coalesce(target, canonical_id), count(*) FROM tar LEFT JOIN m ON source = canonical_id GROUP BY 1, 2""")
def canonical_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Results and targets take the new id, every raw name becomes an alias; ids of other codes in one report stay apart."""
    t = tables(spark, sf)
    mapping = spark.createDataFrame([("t25", "t0"), ("t26", "t1"), ("t3", "t2"), ("t5", "t2"), ("t31", "t30")], "source string, target string")
    res, tar, alias = store.merge_canonical(t["results"], t["targets"], spark.createDataFrame([], "alias string, canonical_id string"), mapping)
    count = lambda df, kind: df.groupBy(F.lit(kind).alias("kind"), F.col("canonical_id").alias("id")).agg(F.count("*").alias("n"))
    return count(res, "result").unionByName(count(tar, "target")).unionByName(alias.select(F.lit("alias").alias("kind"), F.concat("alias", F.lit("="), "canonical_id").alias("id"), F.lit(1).cast("long").alias("n")))


@query("""WITH n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 <> 0 THEN 5.0 END AS lo, CASE c_custkey % 3 WHEN 0 THEN 4.0 WHEN 1 THEN 7.0 END AS hi FROM customer), ok AS (SELECT *, coalesce(lo, hi) IS NOT NULL AND coalesce(lo < hi, true) AS fine FROM n)
SELECT k AS patient_id, NOT fine AS refused, CASE WHEN fine THEN lo ELSE 1.0 END AS low, CASE WHEN fine THEN hi ELSE 9.0 END AS high FROM ok""")
def targets_set(spark: SparkSession, sf: str) -> DataFrame:
    """A target needs a bound, and the lower one below the upper; what is refused leaves the old one."""
    old, k = tables(spark, sf)["targets"], F.col("patient_id")
    new = old.withColumns({"target_low": F.when(k % 4 != 0, 5.0), "target_high": F.when(k % 3 == 0, 4.0).when(k % 3 == 1, 7.0)})
    now, refused = store.set_targets(old, new)
    return now.join(refused.select("patient_id", F.lit(True).alias("no")), "patient_id", "left").select("patient_id", F.coalesce("no", F.lit(False)).alias("refused"), F.col("target_low").alias("low"), F.col("target_high").alias("high"))


@query(f"WITH {_T} SELECT patient_id FROM tar WHERE patient_id % 5 <> 0")
def targets_deleted(spark: SparkSession, sf: str) -> DataFrame:
    """C16."""
    t = tables(spark, sf)["targets"]
    return store.delete_rows(t, t.where("patient_id % 5 = 0").select("patient_id", "canonical_id")).select("patient_id")


@query("SELECT event_id AS id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d %H:%M') ORDER BY event_id % 2, event_id) AS k FROM events) WHERE k = 1")
def readings_added(spark: SparkSession, sf: str) -> DataFrame:
    """The first reading of a patient's minute stays; odd events are added to the even ones."""
    r = tables(spark, sf)["bp_readings"]
    return store.add_readings(r.where("id % 2 = 0"), r.where("id % 2 = 1")).select("id")


@query("""WITH e AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN c_custkey + 1 ELSE c_custkey END AS named, CASE WHEN c_custkey % 23 <> 0 THEN 1 END AS born FROM customer WHERE c_custkey % 2 = 0),
p AS (SELECT named, born, id FROM e UNION ALL SELECT c_custkey, CASE WHEN c_custkey % 5 <> 1 THEN 1 END, c_custkey FROM customer WHERE c_custkey % 2 = 1), d AS (SELECT named, born FROM p WHERE born IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
SELECT id, CASE WHEN id % 7 = 0 THEN CASE WHEN born IS NOT NULL THEN 'birth_date' WHEN id % 5 = 0 THEN 'sex' WHEN id % 11 = 0 THEN 'smoker_current' WHEN id % 13 = 0 THEN 'year' WHEN id % 17 = 0 THEN 'period' END WHEN id % 5 = 0 THEN 'sex' WHEN id % 11 = 0 THEN 'smoker_current' WHEN id % 13 = 0 THEN 'year' WHEN id % 17 = 0 THEN 'period' WHEN d.named IS NOT NULL THEN 'duplicate' END AS error,
  CASE WHEN id % 4 = 2 THEN CASE WHEN id % 13 = 0 THEN 1800 WHEN id % 17 = 0 THEN 2020 ELSE 1990 END END AS since FROM e LEFT JOIN d USING (named, born)""")
def edits_validated(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that fails, names and birth dates that another patient has, edited or stored; only former smokers
    have a period."""
    k = F.col("c_custkey")
    c = read(spark, sf, "customer")
    person = lambda n: F.concat(F.lit("Customer#"), n.cast("string"))
    birth = F.when(k % 7 == 0, "1990-13-45").otherwise("1990-01-02")
    e = c.where(k % 2 == 0).select(k.alias("id"), person(F.when(k % 19 == 0, k + 1).otherwise(k)).alias("full_name"), F.when(k % 23 != 0, birth).alias("birth_date"), F.when(k % 5 == 0, "x").otherwise("Mujer").alias("sex"), F.when(k % 11 == 0, 3).otherwise(0).alias("smoker_current"), (k % 4 == 2).cast("int").alias("smoker_former"), F.when(k % 13 == 0, 1800).when(k % 17 == 0, 2020).otherwise(1990).alias("smoker_former_from"), F.lit(2000).alias("smoker_former_to"))
    stored = c.where(k % 2 == 1).select(k.alias("id"), person(k).alias("full_name"), text.normalize_name(person(k)).alias("name_key"), F.when(k % 5 != 1, "1990-01-02").alias("birth_date"))
    return store.validated_updates(e, 2026, stored).select("id", "error", F.col("smoker_former_from").alias("since"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'a,b' ELSE 'a,b,c' END AS added, CASE WHEN c_custkey % 2 = 0 THEN 'b' ELSE 'a,b' END AS dropped FROM customer")
def alternative_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """A former number joins the list once; the present one leaves it."""
    k = F.col("c_custkey")
    return read(spark, sf, "customer").select(k.alias("id"), store.add_alternative(F.lit("a,b"), F.when(k % 3 != 0, "c").otherwise("a")).alias("added"), store.drop_alternative(F.lit("a,b"), F.when(k % 2 == 0, "a").otherwise("z")).alias("dropped"))


@query("SELECT CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END || k AS value, 's' || k AS key FROM (SELECT c_custkey AS k FROM customer)")
def settings_put(spark: SparkSession, sf: str) -> DataFrame:
    """C3, C15."""
    k = F.col("c_custkey")
    c = read(spark, sf, "customer")
    of = lambda word: c.select(k.alias("n"), F.concat(F.lit("s"), k).alias("key"), F.concat(F.lit(word), k).alias("value"))
    return store.put_settings(of("old"), of("new").where("n % 2 = 0"))


@query(f"WITH {_T} SELECT DISTINCT raw_name FROM res")
def known_test_names(spark: SparkSession, sf: str) -> DataFrame:
    """C13."""
    return store.raw_names(tables(spark, sf)["results"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 0 THEN '19' || c_custkey % 90 + 10 || '-05-06' END AS birth_date, CASE WHEN c_custkey % 2 = 0 THEN 'Mujer' ELSE 'Hombre' END AS sex FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def birth_and_sex(spark: SparkSession, sf: str) -> DataFrame:
    """C14, of the patients that have a report."""
    t = tables(spark, sf)
    return store.patient_facts(t["patients"], t["reports"].select(F.col("patient_id").alias("id")))


@query(f"WITH {BY_PRIORITY}, n AS (SELECT canonical_id, count(*) AS num_points, max((flag IN ('alto', 'bajo'))::INT) AS out FROM s GROUP BY 1) SELECT canonical_id, num_points, num_points >= 300 AS enough, out = 1 AS in_map FROM n")
def listed_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Tests with enough points, and those that a heat map shows."""
    s = S.flagged(orders_series(spark, sf))
    shown = store.heatmap_tests(s).select("canonical_id", F.lit(True).alias("in_map"))
    return store.enough_points(store.canonical_tests(s), 300).join(shown, "canonical_id", "left").select("canonical_id", "num_points", "enough", F.coalesce("in_map", F.lit(False)).alias("in_map"))


@query(f"WITH {_T} SELECT patient_id, canonical_id FROM tar")
def table_browse(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table by its listed name."""
    return table(tables(spark, sf), "targets").select("patient_id", "canonical_id")


@query(f"""WITH {BY_PRIORITY} SELECT patient_id, canonical_id, round((value_num - previous) / width, 6) AS size FROM s WHERE back = 1 AND previous IS NOT NULL AND width > 0 AND value_num <> previous""")
def changes_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """G20, O4."""
    return S.ranked_changes(orders_series(spark, sf)).select("patient_id", "canonical_id", F.round("size", 6).alias("size"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Mujer' WHEN 1 THEN 'Hombre' WHEN 2 THEN 'Mujer' WHEN 3 THEN 'Hombre' END AS sex FROM part")
def sex_words(spark: SparkSession, sf: str) -> DataFrame:
    """J7."""
    k = F.col("p_size") % 5
    return read(spark, sf, "part").select("p_partkey", text.parse_sex(F.when(k == 0, " Dona ").when(k == 1, "varón, adulto").when(k == 2, "F").when(k == 3, "home").otherwise("otro")).alias("sex"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size / 1.0 WHEN 1 THEN p_size / 1.0 END AS low, CASE p_size % 4 WHEN 0 THEN p_size + 10.5 WHEN 2 THEN p_size / 1.0 WHEN 3 THEN p_size / 1.0 END AS high FROM part")
def range_texts(spark: SparkSession, sf: str) -> DataFrame:
    """J8."""
    n, k = F.col("p_size").cast("string"), F.col("p_size") % 4
    raw = F.when(k == 0, F.concat(n, F.lit(" - "), (F.col("p_size") + 10).cast("string"), F.lit(",5"))).when(k == 1, F.concat(F.lit("> "), n)).when(k == 2, F.concat(F.lit("< "), n)).otherwise(F.concat(F.lit("Inf. a "), n))
    b = text.range_bounds(raw)
    return read(spark, sf, "part").select("p_partkey", b["low"].alias("low"), b["high"].alias("high"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_name || ' ' || p_brand END AS note FROM part")
def notes_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Control characters and runs of blanks become one blank; nothing left is no note."""
    return read(spark, sf, "part").select("p_partkey", text.clean_note(F.when(F.col("p_size") % 4 == 0, " \t\n").otherwise(F.concat(F.lit(" "), "p_name", F.lit("\t \u0007"), "p_brand", F.lit("\n")))).alias("note"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'fumador' WHEN 1 THEN 'exfumador (' || p_size || '-2001)' WHEN 2 THEN 'no fumador' END AS habit FROM part")
def smoking_words(spark: SparkSession, sf: str) -> DataFrame:
    """J22."""
    k = F.col("p_size") % 4
    none = F.lit(None).cast("int")
    return read(spark, sf, "part").select("p_partkey", text.smoking(F.when(k == 0, 1).when(k < 3, 0), F.when(k == 1, 1).when(k == 2, 0), F.when(k == 1, F.col("p_size")).otherwise(none), F.when(k == 1, 2001).otherwise(none)).alias("habit"))


@query("SELECT p_partkey, p_size > 20 OR (p_size = 20 AND p_partkey % 12 > 9) AS newer FROM part")
def versions_newer(spark: SparkSession, sf: str) -> DataFrame:
    """Compared as numbers, part by part."""
    return read(spark, sf, "part").select("p_partkey", text.newer(F.concat(F.lit("v"), "p_size", F.lit("."), F.col("p_partkey") % 12), F.lit("20.9")).alias("newer"))


@query("SELECT p_partkey, CASE WHEN p_size * 3 < 80 THEN 'microcitico' WHEN p_size * 3 > 100 THEN 'macrocitico' ELSE 'normocitico' END AS kind FROM part")
def cell_size(spark: SparkSession, sf: str) -> DataFrame:
    """H13."""
    return read(spark, sf, "part").select("p_partkey", indices.mcv_category(F.col("p_size") * 3).alias("kind"))


_G = f"{_T}, g AS (SELECT canonical_id, list_sort(list_distinct(list(unit))) AS units, list_sort(list_distinct(list(loinc_code))) AS codes, list_sort(list_distinct(list(raw_name))) AS names, list_sort(list_distinct(list(lab))) AS labs, count(*) AS n FROM res GROUP BY 1)"


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return tables(spark, sf)["results_with_lab"]


@query(f"WITH {_G} SELECT canonical_id, array_to_string(units, ',') AS units, array_to_string(codes, ',') AS codes, array_to_string(names, ',') AS names, array_to_string(labs, ',') AS labs, n FROM g")
def audit_groups(spark: SparkSession, sf: str) -> DataFrame:
    """F11."""
    g = audit.groups(_results(spark, sf))
    return g.select("canonical_id", *[F.array_join(c, ",").alias(c) for c in ("units", "codes", "names", "labs")], "n")


@query(f"WITH {_G} SELECT canonical_id FROM g WHERE len(units) > 1")
def audit_unit_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """mg/dL and g/L differ in size."""
    return audit.unit_conflicts(audit.groups(_results(spark, sf))).select("canonical_id")


@query(f"WITH {_G}, two AS (SELECT DISTINCT canonical_id FROM (SELECT canonical_id, report_id FROM res GROUP BY 1, 2 HAVING count(DISTINCT raw_name) > 1)) SELECT canonical_id FROM g WHERE len(codes) > 1 OR (len(codes) <> 1 AND canonical_id IN (SELECT canonical_id FROM two))")
def audit_mixed_groups(spark: SparkSession, sf: str) -> DataFrame:
    """F13."""
    r = _results(spark, sf)
    return audit.mixed_groups(r, audit.groups(r)).select("canonical_id")


@query("SELECT DISTINCT p_brand || CASE p_size % 4 WHEN 0 THEN ' 5 mg/dL' WHEN 1 THEN ' < 7' ELSE '' END AS raw_name FROM part WHERE p_size % 4 < 2 UNION SELECT DISTINCT '* ' || p_brand FROM part WHERE p_size % 4 = 2")
def audit_noisy_names(spark: SparkSession, sf: str) -> DataFrame:
    """F14."""
    k = F.col("p_size") % 4
    raw = F.when(k == 0, F.concat("p_brand", F.lit(" 5 mg/dL"))).when(k == 1, F.concat("p_brand", F.lit(" < 7"))).when(k == 2, F.concat(F.lit("* "), "p_brand")).otherwise(F.col("p_brand"))
    return audit.noisy_names(read(spark, sf, "part").select(F.lit("x").alias("canonical_id"), raw.alias("raw_name"))).select("raw_name")


#: Ids c and c + 25 share a code; a share of a test's reports is the same for both sides.
_P = f"""{_G}, pair AS (SELECT x.canonical_id AS a, y.canonical_id AS b, x.units AS ua, y.units AS ub, x.n AS na, y.n AS nb FROM g x JOIN g y ON x.codes = y.codes AND len(x.codes) = 1 AND x.canonical_id < y.canonical_id),
same AS (SELECT DISTINCT a, b FROM pair JOIN res x ON x.canonical_id = a JOIN res y ON y.canonical_id = b AND x.report_id = y.report_id)"""


@query(f"""WITH {_P} SELECT a AS root, CASE WHEN (na, -length(a)) >= (nb, -length(b)) THEN a ELSE b END AS target, a || ',' || b AS members, CASE WHEN ua = ub THEN 'igual' WHEN list_has(ua, 'mmol/L') <> list_has(ub, 'mmol/L') THEN 'incompatible' ELSE 'convertible' END AS relation, (SELECT count(*) FROM same WHERE same.a = pair.a)::INT AS same_report FROM pair""")
def audit_proposals(spark: SparkSession, sf: str) -> DataFrame:
    """M1, M2: ids that share a code, their target, worst unit relation and whether a report has several."""
    r = _results(spark, sf)
    return audit.proposals(audit.groups(r), r).select("root", "target", F.array_join("members", ",").alias("members"), "relation", "same_report")


@query(f"""WITH {_P}, ok AS (SELECT CASE WHEN (na, -length(a)) >= (nb, -length(b)) THEN a ELSE b END AS target, CASE WHEN (na, -length(a)) >= (nb, -length(b)) THEN b ELSE a END AS source FROM pair WHERE 't1' IN (a, b) OR 't3' IN (a, b))
SELECT DISTINCT lower(raw_name) AS alias, target AS canonical_id FROM ok JOIN res ON canonical_id = source WHERE raw_name NOT LIKE '%suero' OR target NOT IN ('t3', 't28')""")
def audit_alias_lines(spark: SparkSession, sf: str) -> DataFrame:
    """M3: names of safe proposals; here each test of a line is a report of its own, so that none is shared. Two ids
    share an unknown unit, two have none, one has an unknown unit beside a known one, some names are noisy, and some rows without
    a unit are of an id that has one."""
    r = _results(spark, sf).withColumn("report_id", F.xxhash64("id", "canonical_id"))
    cid = F.col("canonical_id")
    odd = F.when(cid.isin("t1", "t26"), "x").when(cid.isin("t2", "t27"), F.lit("")).when(cid == "t4", "y").when((F.col("id") % 10 == 1) & (cid == "t28"), F.lit(None).cast("string")).when(cid.isin("t3", "t28"), "mg/dL").otherwise(F.col("unit"))
    name = F.when(cid.isin("t3", "t28") & F.col("raw_name").endswith("suero"), F.concat(F.lit("* "), "raw_name")).otherwise(F.col("raw_name"))
    r = r.withColumn("unit", odd).withColumn("raw_name", name)
    return audit.alias_lines(audit.proposals(audit.groups(r), r), r)


@query("SELECT 'c_name' AS \"column\", least(greatest(max(length(c_name)), 6) + 2, 40)::INT AS width FROM customer UNION ALL SELECT 'c_custkey', least(greatest(greatest(max(length(c_custkey::VARCHAR)), 9) + 2, 10), 40)::INT FROM customer")
def sheet_widths(spark: SparkSession, sf: str) -> DataFrame:
    """B3."""
    return files.column_widths(read(spark, sf, "customer").select("c_custkey", "c_name"))


@query("SELECT o_orderkey, ceil(row_number() OVER (ORDER BY o_orderdate, o_orderkey) / 25.0)::BIGINT AS page, ceil(count(*) OVER () / 25.0)::BIGINT AS pages FROM orders")
def report_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in a total order, 25 to a page."""
    return files.pages(read(spark, sf, "orders").select("o_orderdate", "o_orderkey"), "o_orderdate", "o_orderkey").select("o_orderkey", "page", "pages")
