import datetime
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from assayline import schemas
from assayline.operators import audit, parsing, pressure, store
from assayline.operators import series as S
from assayline.sources import files
from assayline.streaming import ingest

COLUMNS = "patient_id long, canonical_id string, result_id long, report_id long, fecha string, value_num double, unit string, ref_low double, ref_high double, lab string, raw_name string"


def make(spark, *points, test="t", lab="A", low=70.0, high=130.0):
    return spark.createDataFrame([(1, test, i, i, f, float(v), "mg/dL", low, high, lab, test) for i, (f, v) in enumerate(points)], COLUMNS)


def variation(spark, cvi=10.0, cva=2.0):
    return spark.createDataFrame([("t", "t", cvi, None, None, cva, "", "", "")], schemas.VARIATION)


def test_drift_equals_recursion(spark):
    rng, rows = random.Random(1), []
    for p in range(40):
        shift = 0.0
        for i in range(rng.randint(5, 20)):
            shift += rng.choice((0, 0, 3, -2))
            rows.append((p, "t", p * 100 + i, 0, f"20{10 + i:02d}-01-01", round(100 + shift + rng.uniform(-5, 5), 2), "", 60.0, 150.0, "A" if i > 2 else "B", "t"))
    got = {r.patient_id: (r.direction, r.since, r.n) for r in S.drift(spark.createDataFrame(rows, COLUMNS), variation(spark)).collect()}
    sigma = math.sqrt(math.log(0.05**2 + 1) + math.log(0.1**2 + 1))
    want = {}
    for p in range(40):
        run = [r for r in rows if r[0] == p and r[9] == [x for x in rows if x[0] == p][-1][9]]
        base = [i for i, r in enumerate(run) if 60 <= r[5] <= 150][:4]
        if len(base) < 4 or len(run) - base[-1] - 1 < 3:
            continue
        centre, up, down, su, sd = sum(run[i][5] for i in base) / 4, 0.0, 0.0, None, None
        for r in run[base[-1] + 1 :]:
            z = (math.log(r[5]) - math.log(centre)) / sigma
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            su, sd = (su or r[4]) if up > 1e-12 else None, (sd or r[4]) if down > 1e-12 else None
        want[p] = ("sube", su, len(run) - base[-1] - 1) if up > 5 else ("baja", sd, len(run) - base[-1] - 1) if down > 5 else (None, None, len(run) - base[-1] - 1)
    assert got == want


def test_trend_resists_an_outlier(spark):
    points = [(f"{2018 + i // 2}-{1 + 6 * (i % 2):02d}-01", 60 if i == 3 else 10 + i) for i in range(8)]
    t = S.trend_direction(S.trend(make(spark, *points))).first()
    assert t.slope * 365.25 == pytest.approx(2, abs=0.1)
    assert t.slope_low > 0


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 14])
def test_trend_equals_brute_force(spark, n):
    rng = random.Random(n)
    points = [(f"{2015 + i // 3}-0{1 + 4 * (i % 3) - (i == 4)}-11", rng.randrange(40, 90)) for i in range(n)]
    got = S.trend(make(spark, *points)).first()
    if n < 3:
        assert got is None
        return
    x, y = [datetime.date.fromisoformat(d).toordinal() for d, _ in points], [v for _, v in points]
    slopes = sorted((y[j] - y[i]) / (x[j] - x[i]) for i in range(n) for j in range(i + 1, n) if x[i] != x[j])
    margin = 1.959964 * math.sqrt(n * (n - 1) * (2 * n + 5) / 18)
    first, last = max(round((len(slopes) - margin) / 2) - 1, 0), min(round((len(slopes) + margin) / 2), len(slopes) - 1)
    assert (got.slope, got.slope_low, got.slope_high) == pytest.approx((statistics.median(slopes), slopes[first], slopes[last]))


def test_time_in_range_gaps(spark):
    r = S.time_in_range(make(spark, ("2020-01-01", 5), ("2020-07-01", 15), ("2020-12-31", 5), low=0.0, high=10.0)).first()
    assert r.percent_in_range == pytest.approx(50, abs=0.5)
    assert S.time_in_range(make(spark, ("2020-01-01", 5), ("2022-01-01", 5), low=0.0, high=10.0)).count() == 0


def test_personal_range_leaves_out_flagged_points(spark):
    r = S.personal_range(make(spark, ("2020-01-01", 100), ("2020-02-01", 300), ("2020-03-01", 104), ("2020-04-01", 96), ("2020-05-01", 99)), variation(spark, 10.0, None)).first()
    assert (r.n, round(r.centre, 6)) == (3, 100)


def test_week_protocol(spark):
    rows = [(1, f"2024-01-{d:02d} {h}:00", 125, 78, None, "casa") for d in range(1, 8) for h in ("08", "20")]
    r = pressure.week_protocol(spark.createDataFrame(rows, "patient_id long, measured_at string, systolic int, diastolic int, pulse int, place string")).first()
    assert (r.n, r.days, r.systolic, r.category) == (12, 6, 125.0, "elevada")


def test_limits():
    assert pressure.check_limits({"systolic": (60, 250)})["systolic"] == (60, 250)
    with pytest.raises(ValueError):
        pressure.check_limits({"pulse": (90, 90)})
    with pytest.raises(ValueError):
        pressure.check_period("2024-02-01", "2024-01-01")


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Glucosa 95 mg/dL (70 - 110)", ("Glucosa", 95.0, "mg/dL", 70.0, 110.0)),
        ("* Colesterol HDL 38,5 mg/dL > 40", ("Colesterol HDL", 38.5, "mg/dL", 40.0, None)),
        ("PCR <0,5 mg/dL (0 - 5)", ("PCR", None, "mg/dL", 0.0, 5.0)),
        ("Exceso de base -1,2 mmol/L [-2,0 - 3,0]", ("Exceso de base", -1.2, "mmol/L", -2.0, 3.0)),
    ],
)
def test_result_lines(line, want):
    r = parsing.parse_line(line)
    assert (r["raw_name"], r["value_num"], r["unit"], r["ref_low"], r["ref_high"]) == want


def test_report(spark):
    body = "Paciente: Ana Ruiz   Sexo: Mujer\nBIOQUIMICA\nGlucosa 95 mg/dL\n(70 - 110)\nUrea 30 mg/dL (10 - 50)\n"
    docs = spark.createDataFrame([(1, body), (2, None), (3, "")], "doc_id long, body string")
    rows = {r.raw_name: r for r in parsing.parse_reports(docs).collect()}
    assert (rows["Glucosa"].ref_low, rows["Urea"].ref_high, rows["Urea"].section) == (70.0, 50.0, "BIOQUIMICA")
    status = {r.doc_id: r.status for r in parsing.ingest_status(parsing.parse_headers(docs), parsing.parse_reports(docs)).collect()}
    assert status == {1: "ok", 2: "review", 3: "review"}
    assert docs.select(parsing.detect_profile(F.col("body"), [parsing.Profile("x", 1, ("BIOQ",))]).alias("p")).first().p == "x"


def test_pressure_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Fecha y hora;Sistólica (mmHg);Diastólica;Pulso\n01/05/2024 09:30;120;80;60\n02/05/2024 09:30;90;95;\n;;;\n", encoding="utf-8")
    raw = files.pressure_readings(spark, str(tmp_path / "a.csv"))
    got = pressure.validated(raw, F.lit("2030-01-01 00:00:00").cast("timestamp")).collect()
    assert [r.error for r in got] == [None, "order"]
    bad = tmp_path / "b.csv"
    bad.write_text("fecha;pulso\n1;2\n", encoding="utf-8")
    with pytest.raises(ValueError, match="systolic, diastolic"):
        files.pressure_readings(spark, str(bad))


def test_export_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", 2.0), ("-1.5", 3.0)], "a string, b double")
    files.export_csv(df, str(tmp_path / "out"))
    assert {r.a for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()} == {"'=1+1", "-1.5"}
    assert {r.column: r.width for r in files.column_widths(df).collect()} == {"a": 10, "b": 10}


def test_store_changes(spark):
    empty = lambda n: schemas.empty(spark, n)
    pat = schemas.conform(spark.createDataFrame([(1, "A", "A", None), (2, "B", "B", "9")], "id long, full_name string, name_key string, dni string"), schemas.TABLES["patients"])
    rep = schemas.conform(spark.createDataFrame([(10, 1, "n1", "f1"), (11, 2, "n1", "f2"), (12, 2, "n2", "f3")], "id long, patient_id long, report_number string, source_file string"), schemas.TABLES["reports"])
    res = schemas.conform(spark.createDataFrame([(100, 10, "Urea", "urea"), (101, 11, "Urea", "urea"), (102, 12, "BUN", "bun")], "id long, report_id long, raw_name string, canonical_id string"), schemas.TABLES["results"])
    t = {"patients": pat, "reports": rep, "results": res, "targets": empty("targets"), "bp_readings": empty("bp_readings")}
    m = store.merge_patients(t, spark.createDataFrame([(2, 1)], "source long, target long"))
    assert sorted(r.id for r in m["reports"].collect()) == [10, 12]
    assert sorted(r.id for r in m["results"].collect()) == [100, 102]
    assert [(r.id, r.dni) for r in m["patients"].collect()] == [(1, "9")]
    gone = store.clear_import(t, "f1")
    assert [r.id for r in gone["patients"].collect()] == [2]
    assert store.flat_results(t).count() == 3
    r2, _, al = store.merge_canonical(res, t["targets"], spark.createDataFrame([], "alias string, canonical_id string"), spark.createDataFrame([("bun", "urea")], "source string, target string"))
    assert {r.canonical_id for r in r2.collect()} == {"urea"} and [(r.alias, r.canonical_id) for r in al.collect()] == [("bun", "urea")]
    new = schemas.conform(spark.createDataFrame([(99, 1, "n1", "f9")], "id long, patient_id long, report_number string, source_file string"), schemas.TABLES["reports"])
    assert {(r.id, r.source_file) for r in store.upsert_reports(rep, new).collect()} == {(10, "f9"), (11, "f2"), (12, "f3")}
    bad = store.set_targets(t["targets"], schemas.conform(spark.createDataFrame([(1, "urea", 5.0, 1.0)], "patient_id long, canonical_id string, target_low double, target_high double"), schemas.TABLES["targets"]))
    assert (bad[0].count(), bad[1].count()) == (0, 1)
    assert schemas.table(t, "patients").count() == 2
    with pytest.raises(ValueError):
        schemas.table(t, "secrets")


def test_deletions_deal_rows_over_more_tasks_as_tables_grow(spark, monkeypatch):
    """Adaptive execution gathered ever more ids in a task, as they take few bytes."""
    monkeypatch.setattr(store, "TASK_ROWS", 50, raising=False)
    n = F.col("id")
    rows = {
        "patients": spark.range(100).select("id"), "reports": spark.range(300).select("id", (n % 99).alias("patient_id")),
        "results": spark.range(2000).select("id", (n % 301).alias("report_id")), "targets": spark.range(100).select(n.alias("patient_id")), "bp_readings": spark.range(0).select("id", n.alias("patient_id")),
    }
    t = {k: schemas.conform(v, schemas.TABLES[k]) for k, v in rows.items()}
    # every report of the patients divisible by 3, some of others, one that is no report, one twice
    ids = spark.range(300).where("id % 3 = 0 OR id % 7 = 0").select("id").union(spark.range(300, 301)).union(spark.range(3, 4))
    cut = {i for i in range(301) if i % 3 == 0 or i % 7 == 0 or i == 300}
    left = {i % 99 for i in range(300) if i not in cut} | {99}
    out = store.delete_reports(t, ids)
    assert sorted(r.id for r in out["reports"].collect()) == sorted(set(range(300)) - cut)
    assert sorted(r.id for r in out["results"].collect()) == [i for i in range(2000) if i % 301 not in cut]
    assert {r.id for r in out["patients"].collect()} == left == {r.patient_id for r in out["targets"].collect()}
    assert out["results"].select(F.spark_partition_id()).distinct().count() >= 30
    out = store.delete_patients(t, spark.range(10).select("id"))
    mine = {i for i in range(300) if i % 99 < 10}
    assert sorted(r.id for r in out["reports"].collect()) == sorted(set(range(300)) - mine)
    assert sorted(r.id for r in out["results"].collect()) == [i for i in range(2000) if i % 301 not in mine]
    assert sorted(r.id for r in out["patients"].collect()) == list(range(10, 100))
    assert out["results"].select(F.spark_partition_id()).distinct().count() >= 30


def test_audit(spark):
    rows = [(1, "ferro", "Ferro (sèrum)", "µg/dL", "A", None), (2, "hierro", "Hierro", "mcg/dL", "B", None), (3, "urea", "Urea", "mg/dL", "A", None), (3, "urea", "Urea", "mmol/L", "A", None), (4, "x", "*Total 5 mg", "", "A", None)]
    res = spark.createDataFrame(rows, "report_id long, canonical_id string, raw_name string, unit string, lab string, loinc_code string")
    g = audit.groups(res)
    p = audit.proposals(g, res).collect()
    assert [(r.members, r.relation, r.same_report) for r in p] == [(["ferro", "hierro"], "igual", 0)]
    assert audit.alias_lines(audit.proposals(g, res), res).count() == 1
    assert [r.canonical_id for r in audit.unit_conflicts(g).collect()] == ["urea"]
    assert audit.noisy_names(res).count() == 1


def test_streamed_ingest_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"QUIMICA\nUrea {i},5 mg/dL (10 - 50)") for i in range(5)], "doc_id long, body string")
    docs.write.parquet(str(tmp_path / "in"))
    ingest.ingest_available(spark, str(tmp_path / "in"), "doc_id long, body string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    key = lambda df: sorted((r.doc_id, r.value_num) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(parsing.parse_reports(docs))


def _roots(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def test_components_of_the_whole_table(spark):
    from assayline.plans import catalog

    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    got = catalog.QUERIES["alias_components"](spark, sf).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == _roots({(f"p{r.l_partkey % 400}", f"s{r.l_suppkey}") for r in rows})


def test_components_of_a_long_chain(spark):
    from assayline.operators import components

    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(120)]
    df = spark.createDataFrame([*edges, ("x", "x"), ("y", None)], "a string, b string")
    assert {r.node: r.root for r in components.connected(df).collect()} == _roots(edges)


@pytest.mark.parametrize("name", ["name_signature", "pressure_dialects", "report_headers"])
def test_small_tables_of_much_work_are_spread(spark, name):
    """Scans and adaptive execution would put them into one task."""
    from assayline.plans import catalog

    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_glyphs_at_the_edges_of_squares(spark):
    """As by brute force, with glyphs on and around edges; most are dealt once or twice, not to nine cells."""
    import itertools

    from assayline.operators import boxes

    spots = [-16.5, -8.0, -0.5, 0.0, 0.5, 7.5, 8.0, 8.5, 12.0, 15.75]
    rows = [(1, 1, no, "a", x, x, y) for no, (x, y) in enumerate(itertools.product(spots, spots))]
    chars = spark.createDataFrame(rows, "doc_id long, page long, no long, text string, x0 double, x1 double, top double")
    kept = {r[2] for r in rows if not any(e[2] < r[2] and abs(e[4] - r[4]) < 1 and abs(e[6] - r[6]) < 1 for e in rows)}
    assert {r.no for r in boxes.drawn_once(chars).collect()} == kept
    even = spark.range(10_000).selectExpr("id % 100 * 0.37D AS x0", "id div 100 * 0.61D AS top")
    assert boxes._squares(even, 1.0).count() < 20_000


def test_names_are_signed_once(spark, monkeypatch):
    """Of results that repeat a name, the name is signed once; counts are of results."""
    from pyspark.sql import functions as F

    from assayline.operators import audit

    signed, calls = audit.text.name_signature, spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        calls.add(1)
        return raw

    monkeypatch.setattr(audit.text, "name_signature", lambda raw: signed(counted(raw)))
    r = spark.range(1_000).selectExpr("'x' AS canonical_id", "concat('Urea ', id % 2) AS raw_name", "'mg/dL' AS unit", "'A' AS lab", "'c' AS loinc_code")
    (g,) = audit.groups(r).collect()
    assert g.n == 1_000 and g.names == ["Urea 0", "Urea 1"] and 0 < calls.value <= 10


def test_one_report_with_two_members(spark):
    from assayline.operators import audit

    rows = [("a", 1, "1"), ("b", 2, "1"), ("c", 3, "2"), ("d", 3, "2"), ("c", 4, "2")]
    r = spark.createDataFrame([(*x, "Urea", "mg/dL", "A") for x in rows], "canonical_id string, report_id long, loinc_code string, raw_name string, unit string, lab string").withColumn("raw_name", F.concat("raw_name", "loinc_code"))
    assert {(x.root, x.same_report) for x in audit.proposals(audit.groups(r), r).collect()} == {("a", 0), ("c", 1)}


def test_mixed_groups(spark):
    """Several codes, or two names in a report without a code; names that are one when normalised, and one code, make none."""
    from assayline.operators import audit

    rows = [("a", 1, "x", "1"), ("a", 2, "x", "2"), ("b", 1, "x", None), ("b", 1, "y", None), ("c", 1, "x", "1"), ("c", 1, "y", None), ("d", 1, "x", None), ("d", 1, "X ", None), ("d", 2, "y", None), (None, 1, "x", "1"), (None, 1, "y", "2")]
    r = spark.createDataFrame([(*x, "mg/dL", "A") for x in rows], "canonical_id string, report_id long, raw_name string, loinc_code string, unit string, lab string")
    assert {x.canonical_id for x in audit.mixed_groups(r, audit.groups(r)).collect()} == {"a", "b"}
