"""Store, panel, pressure, text, audit and parsing queries, each with the SQL that it must equal where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import indices, text, units
from ..operators import audit, components, panels, parsing, pressure, store
from ..operators import series as S
from ..sources.adapters import BY_PRIORITY, EVENTS_SQL, events_panel, orders_series, read, spread
from .series_queries import r6, rsql

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {BY_PRIORITY}, b AS (SELECT canonical_id, 'N' || report_id % 3 AS raw_name, count(*) AS n, max(unit) AS unit, max((flag IN ('alto', 'bajo'))::INT) AS o FROM s GROUP BY ALL)
SELECT canonical_id, arg_max(raw_name, (n, raw_name)) AS name, max(unit) AS unit, sum(n)::BIGINT AS num_points, max(o) AS out_of_range FROM b GROUP BY 1""")
def canonical_test_list(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    s = S.flagged(orders_series(spark, sf)).withColumn("raw_name", F.concat(F.lit("N"), (F.col("report_id") % 3).cast("string")))
    return store.canonical_tests(s)


@query(f"""WITH {BY_PRIORITY}, v AS (SELECT canonical_id, 'N' || report_id % 3 AS raw_name, coalesce(lab, '') AS lab, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT canonical_id, raw_name, sum(n) AS n FROM v GROUP BY ALL)
SELECT v.canonical_id, count(*) AS variants, sum(v.n)::BIGINT AS total, (SELECT string_agg(raw_name, ',' ORDER BY n DESC, raw_name) FROM m WHERE m.canonical_id = v.canonical_id) AS names, string_agg(DISTINCT v.lab, ',' ORDER BY v.lab) AS labs FROM v GROUP BY 1""")
def canonical_groups(spark: SparkSession, sf: str) -> DataFrame:
    """F2."""
    s = orders_series(spark, sf).withColumn("raw_name", F.concat(F.lit("N"), (F.col("report_id") % 3).cast("string")))
    return store.canonical_groups(s).select("canonical_id", F.size("variants").cast("long").alias("variants"), "total", F.array_join("names", ",").alias("names"), F.array_join("labs", ",").alias("labs"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    li = read(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("report_id"), F.concat(F.lit("t"), F.col("l_partkey") % 37).alias("canonical_id"), F.concat(F.lit("Test "), F.col("l_partkey") % 37, F.when(F.col("l_returnflag") == "R", " (total)").otherwise("")).alias("raw_name"), F.when(F.col("l_partkey") % 37 < 20, F.concat((F.col("l_partkey") % 37).cast("string"), F.lit("-1"))).alias("loinc_code"), F.when(F.col("l_linestatus") == "F", "mg/dL").otherwise("g/L").alias("unit"), F.col("l_quantity").alias("value_num"), F.col("l_returnflag").alias("lab"))


_LINES = """r AS (SELECT l_orderkey AS report_id, 't' || l_partkey % 37 AS canonical_id, 'Test ' || l_partkey % 37 || CASE WHEN l_returnflag = 'R' THEN ' (total)' ELSE '' END AS raw_name,
CASE WHEN l_partkey % 37 < 20 THEN (l_partkey % 37) || '-1' END AS loinc_code, CASE WHEN l_linestatus = 'F' THEN 'mg/dL' ELSE 'g/L' END AS unit FROM lineitem)"""


@query(f"WITH {_LINES}, d AS (SELECT DISTINCT report_id, canonical_id FROM r) SELECT a.canonical_id AS a, b.canonical_id AS b, count(*) AS reports FROM d a JOIN d b ON a.report_id = b.report_id AND a.canonical_id < b.canonical_id GROUP BY ALL")
def cooccurrence_block(spark: SparkSession, sf: str) -> DataFrame:
    """D6j."""
    return store.co_occurring(_lines(spark, sf))


@query(f"""WITH {_LINES}, d AS (SELECT DISTINCT report_id, canonical_id FROM r), p AS (SELECT a.canonical_id AS a, b.canonical_id AS b, count(*) AS reports FROM d a JOIN d b ON a.report_id = b.report_id AND a.canonical_id < b.canonical_id GROUP BY ALL),
c AS (SELECT canonical_id, max(loinc_code) AS code, min(unit) AS lo, max(unit) AS hi FROM r GROUP BY 1)
SELECT x.canonical_id AS canonical_id_a, y.canonical_id AS canonical_id_b, coalesce(reports, 0) AS reports, reports IS NOT NULL AND NOT coalesce(x.code = y.code, false) AS blocked, coalesce(x.code <> y.code, false) AS warn_codes, (x.lo <> y.lo OR x.hi <> y.hi) AS warn_units
FROM c x JOIN c y ON x.canonical_id < y.canonical_id LEFT JOIN p ON p.a = x.canonical_id AND p.b = y.canonical_id""")
def merge_check(spark: SparkSession, sf: str) -> DataFrame:
    """every pair of ids; mg/dL and g/L are convertible."""
    return store.merge_check(_lines(spark, sf))


@query("SELECT p_partkey, replace(replace(lower(replace(p_type, ' ', '')), '_', ''), 'µ', 'mc') AS unit_key FROM part")
def unit_key(spark: SparkSession, sf: str) -> DataFrame:
    """I1."""
    return read(spark, sf, "part").select("p_partkey", units.key(F.col("p_type")).alias("unit_key"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'igual' WHEN 1 THEN 'convertible' WHEN 2 THEN 'incompatible' ELSE 'desconocida' END AS relation FROM part""")
def unit_relation(spark: SparkSession, sf: str) -> DataFrame:
    """A unit against mg/dL."""
    k = F.col("p_size") % 4
    other = F.when(k == 0, "MG / dL").when(k == 1, "g/L").when(k == 2, "mmol/L").otherwise("index")
    return read(spark, sf, "part").select("p_partkey", units.relation(F.array(F.lit("mg/dL")), F.array(other)).alias("relation"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS num_reports FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def patient_report_counts(spark: SparkSession, sf: str) -> DataFrame:
    """F4, D3j."""
    rep = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("patient_id"))
    return store.patients_with_counts(read(spark, sf, "customer").select(F.col("c_custkey").alias("id")), rep)


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf, "orders").select(k.alias("id"), F.col("o_custkey").alias("patient_id"), F.concat(F.lit("f"), k).alias("source_file"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("request_date"), F.lit(None).cast("string").alias("validation_date"), F.col("o_orderstatus").alias("lab"))


def _results(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.when(F.col("l_quantity") < 5, "bajo").when(F.col("l_quantity") > 45, "alto").otherwise("normal").alias("flag_calc"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("sample_date"), F.col("l_quantity").alias("value_num"), F.concat(F.lit("t"), F.col("l_partkey") % 37).alias("canonical_id"))


@query("""WITH n AS (SELECT l_orderkey + (l_orderkey % 7 = 0)::INT AS id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_custkey AS patient_id, coalesce(n, 0) AS num_results, (o_orderkey % 5 = 0) AS missing FROM orders LEFT JOIN n ON id = o_orderkey WHERE coalesce(n, 0) = 0 OR o_orderkey % 5 = 0""")
def orphan_reports(spark: SparkSession, sf: str) -> DataFrame:
    """F6, D5j: the results of every seventh report are moved to the next one."""
    rep, k = _reports(spark, sf), F.col("report_id")
    moved = _results(spark, sf).withColumn("report_id", k + F.when(k % 7 == 0, 1).otherwise(0))
    return store.orphan_reports(rep, moved, rep.where("id % 5 <> 0").select(F.col("source_file").alias("filename")))


@query("""WITH n AS (SELECT l_orderkey AS id, count(*) AS n, min(strftime(l_shipdate, '%Y-%m-%d')) AS m FROM lineitem GROUP BY 1)
SELECT o_orderkey AS id, o_custkey AS patient_id, coalesce(m, strftime(o_orderdate, '%Y-%m-%d')) AS fecha, coalesce(n, 0) AS num_results FROM orders LEFT JOIN n ON id = o_orderkey""")
def patient_reports(spark: SparkSession, sf: str) -> DataFrame:
    """F5, D4j."""
    return store.patient_reports(_reports(spark, sf), _results(spark, sf))


@query("""SELECT (SELECT count(*) FROM customer) AS patients, count(*) AS reports, strftime(min(o_orderdate), '%Y-%m-%d') AS first, strftime(max(o_orderdate), '%Y-%m-%d') AS last,
(SELECT count(*) FROM lineitem) AS results, (SELECT count(*) FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45) AS out_of_range,
count(*) FILTER (o_orderstatus = 'F') AS files_ok, count(*) FILTER (o_orderstatus = 'O') AS files_review, count(*) FILTER (o_orderstatus = 'P') AS files_error FROM orders""")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    """F3."""
    state = F.element_at(F.create_map(*[F.lit(x) for x in ("F", "ok", "O", "review", "P", "error")]), F.col("lab"))
    rep = _reports(spark, sf)
    return store.stats({"patients": read(spark, sf, "customer"), "reports": rep, "results": _results(spark, sf), "processed_files": rep.select(state.alias("status"))})


@query(f"""WITH {BY_PRIORITY}, e AS (SELECT patient_id, canonical_id FROM s GROUP BY ALL HAVING bool_or(coalesce(flag IN ('alto', 'bajo'), false))) SELECT s.patient_id, s.canonical_id, value_num, previous FROM s JOIN e USING (patient_id, canonical_id) WHERE back = 1""")
def altered_ever_rows(spark: SparkSession, sf: str) -> DataFrame:
    """F16."""
    s = S.flagged(orders_series(spark, sf))
    return store.ever_altered(s).select("patient_id", "canonical_id", "value_num", "previous")


def _panel(spark: SparkSession, sf: str, names: dict[str, str]) -> DataFrame:
    """Events as a merged series whose types stand for the panel's analytes."""
    ids = spark.createDataFrame([(a, e, 1) for e, a in names.items()], "analyte string, canonical_id string, priority int")
    return S.merged(events_panel(spark, sf), ids)


def _unit(points: DataFrame, **to: str) -> DataFrame:
    """The adapter's accepted unit, written as each analyte's own."""
    u = F.col("unit")
    for a, name in to.items():
        u = F.when((F.col("analyte") == a) & (F.col("unit") == "mg/dL"), name).otherwise(u)
    return points.withColumn("unit", u)


def _index_sql(*rows: tuple[str, str, str, str]) -> str:
    """(key, formula, low, high) over ``wide``."""
    one = " UNION ALL ".join(f"SELECT patient_id, fecha, '{k}' AS index_key, ({f})::DOUBLE AS v, ({lo})::DOUBLE AS lo, ({hi})::DOUBLE AS hi FROM wide" for k, f, lo, hi in rows)
    return f"WITH {EVENTS_SQL}, i AS ({one}) SELECT patient_id, fecha, index_key, round(v, 6) AS value_num, CASE WHEN lo IS NULL AND hi IS NULL THEN NULL WHEN v < lo THEN 'bajo' WHEN v > hi THEN 'alto' ELSE 'normal' END AS flag FROM i WHERE v IS NOT NULL"


def _out(points: DataFrame, panel: str, births: DataFrame | None = None) -> DataFrame:
    return panels.index_series(points, panels.PANELS[panel], births).select("patient_id", "fecha", "index_key", *r6("value_num"), "flag")


_LDL = "coalesce(purchase, CASE WHEN signup < 400 THEN view - click - signup / 5 END)"


@query(_index_sql(("castelli_1", "view / nullif(click, 0)", "NULL", "5"), ("castelli_2", f"{_LDL} / nullif(click, 0)", "NULL", "3"), ("tg_hdl", "signup / nullif(click, 0)", "NULL", "3"), ("ldl_estimated", "CASE WHEN purchase IS NULL AND signup < 400 THEN view - click - signup / 5 END", "NULL", "130")))
def lipid_panel(spark: SparkSession, sf: str) -> DataFrame:
    """H1-H3."""
    return _out(_panel(spark, sf, {"view": "total", "click": "hdl", "purchase": "ldl", "signup": "tg"}), "lipid")


@query(_index_sql(("de_ritis", "view / nullif(click, 0)", "NULL", "2"), ("apri", "view / 40 * 100 / nullif(purchase, 0)", "NULL", "1.5"), ("fib4", "CASE WHEN click > 0 THEN (date_part('year', fecha::DATE) - 1960 - CASE WHEN strftime(fecha::DATE, '%m-%d') < '01-15' THEN 1 ELSE 0 END) * view / nullif(purchase * sqrt(click), 0) END", "NULL", "2.67")))
def hepatic_panel(spark: SparkSession, sf: str) -> DataFrame:
    """H5-H7, I2, I5, with a birth date for every patient."""
    p = _unit(_panel(spark, sf, {"view": "ast", "click": "alt", "purchase": "platelets"}), ast="U/L", alt="UI/L 37C", platelets="x10^9/L")
    return _out(p, "hepatic", p.select("patient_id").distinct().withColumn("birth_date", F.lit("1960-01-15")))


@query(f"""WITH {EVENTS_SQL}, k AS (SELECT patient_id, fecha, view AS gfr, click AS acr FROM wide WHERE view IS NOT NULL),
g AS (SELECT *, CASE WHEN gfr >= 90 THEN 'G1' WHEN gfr >= 60 THEN 'G2' WHEN gfr >= 45 THEN 'G3a' WHEN gfr >= 30 THEN 'G3b' WHEN gfr >= 15 THEN 'G4' ELSE 'G5' END AS g, CASE WHEN acr < 30 THEN 'A1' WHEN acr < 300 THEN 'A2' WHEN acr IS NOT NULL THEN 'A3' END AS a FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY fecha DESC) AS n FROM g)
SELECT patient_id, fecha, g, a, CASE WHEN a IS NULL THEN NULL WHEN g IN ('G4', 'G5') THEN 4 WHEN g = 'G3b' THEN CASE a WHEN 'A1' THEN 3 ELSE 4 END WHEN g = 'G3a' THEN CASE a WHEN 'A1' THEN 2 WHEN 'A2' THEN 3 ELSE 4 END ELSE CASE a WHEN 'A1' THEN 1 WHEN 'A2' THEN 2 ELSE 3 END END AS risk FROM l WHERE n = 1""")
def renal_panel_kdigo(spark: SparkSession, sf: str) -> DataFrame:
    """The last date whose filtration rate has its unit."""
    p = _unit(_panel(spark, sf, {"view": "gfr", "click": "acr"}), gfr="mL/min/1.73", acr="mg/g")
    g, a = indices.gfr_category(F.col("gfr")), indices.acr_category(F.col("acr"))
    return panels.latest(p, panels.PANELS["renal"]).select("patient_id", "fecha", g.alias("g"), a.alias("a"), indices.kdigo_risk(g, a).alias("risk"))


@query(_index_sql(("nlr", "view / nullif(click, 0)", "NULL", "3.83"), ("plr", "purchase / nullif(click, 0)", "NULL", "185.52"), ("mentzer", "CASE WHEN signup < 80 THEN signup / nullif(error, 0) END", "13", "NULL")))
def hemogram_panel(spark: SparkSession, sf: str) -> DataFrame:
    """H12-H14, I6."""
    p = _unit(_panel(spark, sf, {"view": "neutrophils", "click": "lymphocytes", "purchase": "platelets", "signup": "mcv", "error": "red_cells"}), neutrophils="x10³/µL", lymphocytes="10^9/L", platelets="x10^9/L", mcv="fL", red_cells="x10^12/L")
    p = p.withColumn("unit", F.when(F.col("unit") == "10^9/L", "x10^9/L").otherwise(F.col("unit")))
    return _out(p, "hemogram").where("index_key <> 'lmr'")


@query(_index_sql(("ferritin", "click", "15", "NULL"), ("tsat", "coalesce(signup, view / nullif(purchase * 1.42, 0) * 100)", "20", "50")))
def iron_panel_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Saturation estimated where the lab gives none."""
    return _out(_unit(_panel(spark, sf, {"view": "iron", "click": "ferritin", "purchase": "transferrin", "signup": "tsat"}), iron="µg/dL", ferritin="ng/mL", tsat="%"), "iron")


@query(_index_sql(("eag", "28.7 * view - 46.7", "NULL", "139.85")))
def glycemic_eag(spark: SparkSession, sf: str) -> DataFrame:
    """H18, H19."""
    return _out(_unit(_panel(spark, sf, {"view": "hba1c", "click": "glucose"}), hba1c="%"), "glycemic")


@query(f"WITH {EVENTS_SQL} SELECT patient_id, fecha, round(ln(view * click / 2), 4) AS tyg FROM wide WHERE view > 0 AND click > 0")
def tyg_index(spark: SparkSession, sf: str) -> DataFrame:
    """H20, before its rounding to two places."""
    w = panels.wide(_panel(spark, sf, {"view": "tg", "click": "glucose"}), panels.PANELS["tyg"])
    return w.select("patient_id", "fecha", F.round(indices.tyg(F.col("tg"), F.col("glucose")), 4).alias("tyg")).where("tyg IS NOT NULL")


@query(_index_sql(("corrected_calcium", "view + 0.8 * (4.0 - click / 10)", "5", "90")))
def corrected_calcium(spark: SparkSession, sf: str) -> DataFrame:
    """Albumin in g/L, the calcium row's own range."""
    return _out(_unit(_panel(spark, sf, {"view": "calcium", "click": "albumin"}), albumin="g/L"), "calcium")


@query(_index_sql(("uric", "view", "NULL", "6.8")))
def uric_flag(spark: SparkSession, sf: str) -> DataFrame:
    """6.8 itself is normal."""
    return _out(_panel(spark, sf, {"view": "uric"}), "uric")


@query(f"""WITH {EVENTS_SQL}, l AS (SELECT patient_id, arg_max(view, fecha) FILTER (view IS NOT NULL) / 10 AS crp, arg_max(click, fecha) FILTER (click IS NOT NULL) AS esr FROM wide GROUP BY 1)
SELECT patient_id, crp IS NOT NULL AND esr IS NOT NULL AND (crp < 0.5 OR crp > 9) <> (esr < 5 OR esr > 90) AS discordant FROM l WHERE crp IS NOT NULL OR esr IS NOT NULL""")
def inflammation_discordance(spark: SparkSession, sf: str) -> DataFrame:
    """CRP in mg/L with its range."""
    return panels.discordant(_unit(_panel(spark, sf, {"view": "crp", "click": "esr"}), crp="mg/L", esr="mm/h")).select("patient_id", "discordant")


@query(_index_sql(("tsh", "view", "5", "90"), ("ft4", "click", "5", "90")))
def thyroid_series(spark: SparkSession, sf: str) -> DataFrame:
    """H24, I10."""
    return _out(_unit(_panel(spark, sf, {"view": "tsh", "click": "ft4"}), tsh="µUI/mL", ft4="ng/dL"), "thyroid")


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    e, k = read(spark, sf, "events"), F.col("event_id")
    return e.select(k.alias("id"), F.col("user_id").alias("patient_id"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("measured_at"), (100 + k % 60).cast("int").alias("systolic"), (60 + k % 40).cast("int").alias("diastolic"), (k % 4 * 30).cast("int").alias("pulse"), F.when(k % 5 == 0, "consulta").otherwise("casa").alias("place"))


_BP = "b AS (SELECT event_id AS id, user_id AS patient_id, strftime(ts, '%Y-%m-%d %H:%M') AS measured_at, ts::DATE AS day, (100 + event_id % 60)::INT AS systolic, (60 + event_id % 40)::INT AS diastolic, (event_id % 4 * 30)::INT AS pulse, CASE WHEN event_id % 5 = 0 THEN 'consulta' ELSE 'casa' END AS place FROM events)"


@query(f"""WITH {_BP}, h AS (SELECT *, max(day) OVER (PARTITION BY patient_id) AS l FROM b WHERE place = 'casa'), w AS (SELECT *, min(day) OVER (PARTITION BY patient_id) AS f FROM h WHERE date_diff('day', day, l) < 7),
g AS (SELECT patient_id, count(*) AS n, count(DISTINCT day) AS days, avg(systolic) AS systolic, avg(diastolic) AS diastolic, avg(pulse) FILTER (pulse > 0) AS pulse FROM w WHERE day > f GROUP BY 1)
SELECT patient_id, n, days, {rsql('systolic', 'diastolic', 'pulse')}, n >= 12 AND days >= 3 AS valid, CASE WHEN n >= 12 AND days >= 3 THEN CASE WHEN systolic >= 135 OR diastolic >= 85 THEN 'hipertension' WHEN systolic >= 120 OR diastolic >= 70 THEN 'elevada' ELSE 'no elevada' END END AS category FROM g""")
def bp_week_protocol(spark: SparkSession, sf: str) -> DataFrame:
    """F7, H25."""
    return pressure.week_protocol(_readings(spark, sf)).select("patient_id", "n", "days", *r6("systolic", "diastolic", "pulse"), "valid", "category")


@query(f"WITH {_BP} SELECT patient_id, count(*) AS n, count(DISTINCT day) AS days, round(avg(systolic), 6) AS systolic, round(avg(diastolic), 6) AS diastolic FROM b WHERE place = 'casa' AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY 1")
def bp_period_stats(spark: SparkSession, sf: str) -> DataFrame:
    """F8, C9."""
    return pressure.period_stats(_readings(spark, sf), "2024-01-05", "2024-01-20").select("patient_id", "n", "days", *r6("systolic", "diastolic"))


@query(f"WITH {_BP} SELECT patient_id, 'day' AS mode, strftime(day, '%Y-%m-%d') AS bucket, count(*) AS n, min(systolic) AS systolic_min, max(systolic) AS systolic_max, round(avg(systolic), 6) AS systolic_mean FROM b GROUP BY 1, 3")
def bp_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """F10."""
    return pressure.buckets(_readings(spark, sf)).select("patient_id", "mode", F.col("bucket").cast("string").alias("bucket"), "n", "systolic_min", "systolic_max", *r6("systolic_mean"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 7 = 0 THEN 'measured_at' WHEN event_id % 11 = 0 THEN 'systolic' WHEN 100 + event_id % 60 <= 60 + event_id % 80 THEN 'order' WHEN event_id % 13 = 0 THEN 'pulse' WHEN event_id % 17 = 0 THEN 'place' END AS error FROM events""")
def bp_validate(spark: SparkSession, sf: str) -> DataFrame:
    """The first rule that fails."""
    k = F.col("event_id")
    raw = read(spark, sf, "events").select(k.alias("id"), F.when(k % 7 == 0, "soon").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm")).alias("measured_at"), F.when(k % 11 == 0, "x1").otherwise((100 + k % 60).cast("string")).alias("systolic"), (60 + k % 80).cast("string").alias("diastolic"), F.when(k % 13 == 0, "999").alias("pulse"), F.when(k % 17 == 0, "calle").alias("place"), F.lit(None).cast("string").alias("note"))
    return pressure.validated(raw, F.lit("2030-01-01 00:00:00").cast("timestamp")).select("id", "error")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name || ' (' || p_brand || ')'), '[^a-z0-9]+', ' ', 'g')) AS name FROM part")
def normalize_test_name(spark: SparkSession, sf: str) -> DataFrame:
    """J1, J3."""
    return read(spark, sf, "part").select("p_partkey", text.normalize_test_name(F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")"))).alias("name"))


@query("SELECT c_custkey, upper(c_mktsegment) || ' GARCIA ' || c_custkey AS name FROM customer")
def normalize_name(spark: SparkSession, sf: str) -> DataFrame:
    """The surname comes first, accented and hyphenated."""
    raw = F.concat(F.lit(" García-"), F.col("c_custkey").cast("string"), F.lit(" , "), F.col("c_mktsegment"))
    return read(spark, sf, "customer").select("c_custkey", text.normalize_name(raw).alias("name"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(lower(p_name), ' ') || CASE p_size % 5 WHEN 0 THEN ['ferro'] WHEN 1 THEN ['ferro', 'orina'] WHEN 2 THEN ['ferro', 'orina'] WHEN 3 THEN ['ferro', '%'] ELSE ['mig', 'plaquetari', 'volum'] END)), ' ') AS key,
CASE WHEN p_size % 5 = 3 THEN 'hcm,vcm' ELSE '' END AS abbreviations FROM part""")
def name_signature(spark: SparkSession, sf: str) -> DataFrame:
    """Specimen, system, kind of quantity, urine, percentage and translated words."""
    p = spread(read(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    name = lambda a, b: F.concat(F.lit(a), "p_name", F.lit(b))
    k = F.col("p_size") % 5
    raw = F.when(k == 0, name("Srm-Hierro ", "; c. subst. (mcmol/L)")).when(k == 1, name("Pac (Uri)- Hierro ", ", fr. vol")).when(k == 2, name("Hierro en orina ", " suero 9 U/L")).when(k == 3, name("Hierro % ", " (MCV/MCH, x)")).otherwise(name("Volumen plaquetar medio ", ""))
    s = text.name_signature(raw)
    key = F.when(k == 3, F.array_join(F.array_sort(F.filter(F.split(s["key"], " "), lambda w: ~w.isin("vcm", "hcm", "x"))), " ")).otherwise(s["key"])
    return p.select("p_partkey", key.alias("key"), F.array_join(s["abbreviations"], ",").alias("abbreviations"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 AND p_size % 3 = 0 THEN 'a_pct' WHEN p_size % 3 = 0 THEN 'a' ELSE replace(lower(p_name), ' ', '_') END AS canonical_id FROM part")
def canonical_id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """J4, D13j."""
    aliases = spark.createDataFrame([("alpha test", "a"), ("alpha test pct", "a_pct")], "alias string, canonical_id string")
    raw = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("Alpha  test"), F.when(F.col("p_size") % 2 == 0, " %").otherwise(""))).otherwise(F.col("p_name"))
    return audit.canonical_lookup(read(spark, sf, "part").select("p_partkey", raw.alias("raw_name")), aliases).select("p_partkey", "canonical_id")


@query("SELECT c_custkey, substr('TRWAGMYFPDXBNJZSQVHLCKE', (c_custkey + 1) % 23 + 1, 1) AS letter, true AS valid FROM customer")
def check_letter(spark: SparkSession, sf: str) -> DataFrame:
    """J24."""
    n = F.col("c_custkey") + 1
    letter = text.check_letter(n)
    return read(spark, sf, "customer").select("c_custkey", letter.alias("letter"), text.identity_valid(F.concat(F.lpad(n.cast("string"), 8, "0"), F.lit("-"), letter)).alias("valid"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '-1.5' WHEN 2 THEN '''@x' ELSE p_name END AS cell FROM part")
def formula_defuse(spark: SparkSession, sf: str) -> DataFrame:
    """B1."""
    k = F.col("p_size") % 4
    return read(spark, sf, "part").select("p_partkey", text.defuse_formula(F.when(k == 0, F.concat(F.lit("="), "p_name")).when(k == 1, "-1.5").when(k == 2, "@x").otherwise(F.col("p_name"))).alias("cell"))


@query("SELECT 'f' || o_orderkey AS filename FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)")
def incremental_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Files with the same content and status ok are skipped."""
    k = F.col("o_orderkey")
    files = read(spark, sf, "orders").select(F.concat(F.lit("f"), k).alias("filename"), F.md5(k.cast("string")).alias("file_hash"), k.alias("k"))
    marks = files.where("k % 3 = 0").select("filename", "file_hash", F.when(F.col("k") % 2 == 0, "ok").otherwise("review").alias("status"))
    return store.already_processed(files, marks).select("filename")


@query("SELECT 'f' || o_custkey AS filename, max(o_orderkey) AS id FROM orders GROUP BY 1")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    """E6."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("f"), "o_custkey").alias("filename"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("processed_at"))
    old = o.where(F.col("id") % 2 == 0).transform(lambda d: store.keep_one(d, ["filename"], F.desc("id")))
    return store.record_files(old, o).select("filename", "id")


@query("""WITH m AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 = 1 THEN o_custkey - 1 ELSE o_custkey END AS patient_id, (o_custkey % 4 = 1)::INT AS moved, o_orderkey % 50 AS number FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY patient_id, number ORDER BY moved, id) AS n FROM m) SELECT id, patient_id FROM k WHERE n = 1""")
def merge_patients_repoint(spark: SparkSession, sf: str) -> DataFrame:
    """Reports move to the target; a number that it has already goes."""
    rep = _reports(spark, sf).withColumn("report_number", F.concat(F.lit("n"), F.col("id") % 50))
    pat = read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("full_name"), F.col("c_name").alias("name_key"), F.lit(None).cast("string").alias("dni"))
    mapping = pat.where("id % 4 = 1").select(F.col("id").alias("source"), (F.col("id") - 1).alias("target"))
    return store.merge_patients({"patients": pat, "reports": rep, "results": _results(spark, sf)}, mapping)["reports"].select("id", "patient_id")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT 'p' || l_partkey % 400 AS a, 's' || l_suppkey AS b FROM lineitem),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) USING KEY (node) AS (SELECT DISTINCT a, a FROM g UNION
  SELECT x.node, x.root FROM (SELECT g.b AS node, min(r.root) AS root FROM r JOIN g ON g.a = r.node GROUP BY 1) x JOIN recurring.r c ON c.node = x.node WHERE x.root < c.root)
SELECT node, root FROM r""")
def alias_components(spark: SparkSession, sf: str) -> DataFrame:
    """M1, D14j."""
    lines = read(spark, sf, "lineitem")
    return components.connected(lines.select(F.concat(F.lit("p"), F.col("l_partkey") % 400).alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b")))


@query("SELECT l_orderkey AS doc_id, count(*) AS n, round(sum(l_quantity), 6) AS total, sum(l_linenumber)::DOUBLE AS low, sum(l_linenumber + 100)::DOUBLE AS high FROM lineitem GROUP BY 1")
def parse_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Lines are written out as a report and read back; the oracle is the table itself."""
    li = read(spark, sf, "lineitem")
    line = F.concat_ws(" ", F.lit("Test"), F.col("l_returnflag"), F.replace(F.format_string("%.2f", "l_quantity"), F.lit("."), F.lit(",")), F.lit("mg/dL"), F.concat(F.lit("("), "l_linenumber", F.lit(" - "), F.col("l_linenumber") + 100, F.lit(")")))
    docs = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("BIOQUIMICA\n"), F.array_join(F.collect_list(line), "\n")).alias("body"))
    rows = parsing.parse_reports(docs)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.sum("value_num"), 6).alias("total"), F.sum("ref_low").alias("low"), F.sum("ref_high").alias("high"))


@query("SELECT l_orderkey AS k, l_linenumber AS n, l_quantity AS plain, l_quantity * 1000 AS grouped FROM lineitem")
def number_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """Decimal commas, and dots as thousands."""
    q = F.col("l_quantity").cast("int").cast("string")
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), text.to_number(F.concat(q, F.lit(",00"))).alias("plain"), text.to_number(F.concat(q, F.lit(".000"))).alias("grouped"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') || ' 07:05:00' AS dmy FROM orders")
def date_grammar(spark: SparkSession, sf: str) -> DataFrame:
    """J6."""
    d = F.col("o_orderdate")
    return read(spark, sf, "orders").select("o_orderkey", text.parse_date(F.date_format(d, "yyyy-MM-dd")).alias("iso"), text.parse_date(F.concat(F.lit("Fecha: "), F.date_format(d, "d/M/yyyy"), F.lit(" 7:05"))).alias("dmy"))
