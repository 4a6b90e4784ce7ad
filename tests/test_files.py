"""Ingest of report files, its stream, encodings of files, privacy scans, page flow and places of characters."""

import pytest
from pyspark.sql import functions as F

from assayline.functions import text
from assayline.operators import boxes, ingest, layout, store
from assayline.schemas import TABLES, empty
from assayline.sources import files, privacy
from assayline.sources import profiles as P
from assayline.streaming import ingest as stream

FILES = "filename string, file_hash string, body string"
ANA = "Pacient: Ruiz, Ana  DNI: D1\nData naixement: 1/1/1980\nPetició: n1\n"


@pytest.fixture(scope="module")
def labs():
    return P.load()


@pytest.fixture(scope="module")
def aliases(spark):
    return spark.createDataFrame([("urea serum", "urea")], "alias string, canonical_id string")


def shown(tables):
    marks = {r.filename: (r.status, r.error_message) for r in tables["processed_files"].collect()}
    reports = {(r.source_file, r.report_number, r.patient_id, r.lab) for r in tables["reports"].collect()}
    results = sorted((r.raw_name, r.canonical_id, r.value_num, r.ref_low, r.flag_calc) for r in tables["results"].collect())
    people = sorted((r.full_name, r.dni, r.birth_date) for r in tables["patients"].collect())
    return marks, reports, results, people


def test_ingest(spark, labs, aliases):
    none = {n: empty(spark, n) for n in TABLES}
    docs = [
        ("a.pdf", "h1", ANA + "(1) Urea sèrum 60 mg/dL 5 - 40"), ("b.pdf", "h2", "DNI: D1\nData naixement: 1/1/1980\nPetició: n2\n(1) Calci 9 mg/dL 8 - 10"), ("c.pdf", "h3", "quelcom"), ("d.pdf", "h4", None),
        ("e.pdf", "h5", "Pacient: Gil, Bo\nPetició: n9"), ("f.pdf", "h6", "Análisis Corchete\nD.N.I.: D1\nNombre: Ana Ruiz F. Nac.: 1/1/1980\nFecha recepción: 1/1/2024\nT4 ü 1 ng/dL\nValores de referencia\n<1 año (5-6 x)\n>0 años (2-4 x)"), (None, "h", "x"),
    ]
    one = ingest.ingest(none, spark.createDataFrame(docs, FILES), labs, aliases, "t1")
    marks, reports, results, people = shown(one)
    assert marks == {
        "a.pdf": ("ok", None), "b.pdf": ("review", "no patient's name; linked by dni"), "c.pdf": ("review", "report format not recognised"), "d.pdf": ("error", "no text"),
        "e.pdf": ("review", "patient founded without a birth date; no result"), "f.pdf": ("ok", None),
    }
    assert results == [("Calci", "calci", 9.0, 8.0, "normal"), ("T4", "t4", 1.0, 2.0, "bajo"), ("Urea sèrum", "urea", 60.0, 5.0, "alto")]
    assert people == [("Gil, Bo", None, None), ("Ana Ruiz", "D1", "1980-01-01")] or people == [("Ana Ruiz", "D1", "1980-01-01"), ("Gil, Bo", None, None)]
    assert {(f, n, lab) for f, n, _, lab in reports} == {("a.pdf", "n1", "Vallserena"), ("b.pdf", "n2", "Vallserena"), ("e.pdf", "n9", "Vallserena"), ("f.pdf", None, "Corchete")}
    # the same files once more change nothing but the ids of what is read again
    two = ingest.ingest(one, spark.createDataFrame(docs, FILES), labs, aliases, "t2")
    assert (shown(two)[0], shown(two)[2], shown(two)[3]) == (marks, results, people)
    again = {r.filename: r.processed_at for r in two["processed_files"].collect()}
    assert again["a.pdf"] == again["f.pdf"] == "t1" and again["b.pdf"] == "t2"
    # a mended file takes the place of its old report, also under another name
    three = ingest.ingest(two, spark.createDataFrame([("a2.pdf", "h8", ANA + "(1) Urea sèrum 61 mg/dL 5 - 40"), ("c.pdf", "h9", ANA.replace("n1", "n7") + "(1) Ferro 1 ug/dL 2 - 4")], FILES), labs, aliases, "t3")
    assert [r[:3] for r in shown(three)[2]] == [("Calci", "calci", 9.0), ("Ferro", "ferro", 1.0), ("T4", "t4", 1.0), ("Urea sèrum", "urea", 61.0)]
    assert three["reports"].where("report_number = 'n1'").count() == 1
    ids = [r.id for r in three["results"].collect()]
    assert len(ids) == len(set(ids))


def test_stream_of_files(spark, tmp_path, labs, aliases):
    source, place = str(tmp_path / "in"), str(tmp_path / "store")
    run = lambda: stream.ingest_files(spark, source, place, str(tmp_path / "ck"), labs, aliases, "t").awaitTermination(300)
    spark.createDataFrame([("a.pdf", "h1", ANA + "(1) Urea 60 mg/dL 5 - 40")], FILES).coalesce(1).write.parquet(f"{source}")
    run()
    spark.createDataFrame([("a.pdf", "h1", "changed"), ("b.pdf", "h2", ANA.replace("n1", "n2") + "(1) Calci 9 mg/dL 8 - 10")], FILES).coalesce(1).write.mode("append").parquet(source)
    run()
    tables = stream.open_store(spark, place)
    first = shown(tables)
    assert first[0] == {"a.pdf": ("ok", None), "b.pdf": ("ok", None)} and [r[0] for r in first[2]] == ["Calci", "Urea"]
    # a batch that is run again, as after a failure before its checkpoint was written
    last = stream._versions(spark, place)[-1]
    before = stream.open_store(spark, place, before=last)
    assert before["results"].count() == 1
    batch = spark.createDataFrame([("a.pdf", "h1", "changed"), ("b.pdf", "h2", ANA.replace("n1", "n2") + "(1) Calci 9 mg/dL 8 - 10")], FILES)
    stream.write_version(spark, place, last, ingest.ingest(before, batch, labs, aliases, "t"))
    assert shown(stream.open_store(spark, place)) == first and stream._versions(spark, place)[-1] == last


def test_number_format(spark):
    xs = [0.0, 1.0, -2.5, 0.1, 100000.0, 1e6, 123456.7, 1234567.0, 0.0001, 0.00001234567, 1e-300, 5e20, 99999.95, float("nan"), float("-inf"), None]
    got = [r.g for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").orderBy("i").select(text.format_g(F.col("x")).alias("g")).collect()]
    assert got == [None if x is None else f"{x:g}" for x in xs]


def test_encodings(spark):
    rows = "Fecha y hora;Sistólica;Diastólica;Nota\n2024-01-01 08:00;120;80;mañana €\n;;;\n"
    docs = spark.createDataFrame([("u", ("﻿" + rows).encode()), ("w", rows.encode("cp1252")), ("n", b""), ("m", "a;b\n1;2".encode())], "path string, content binary")
    found, errors = files.pressure_files(docs)
    assert {(r.path, r.line, r.systolic, r.note) for r in found.collect()} == {("u", 2, "120", "mañana €"), ("w", 2, "120", "mañana €")}
    assert {(r.path, r.error) for r in errors.collect()} == {("n", "the file is empty"), ("m", "missing columns: measured_at, systolic, diastolic")}


def test_marked_export(spark, tmp_path):
    files.export_csv(spark.createDataFrame([("x", 1)], "`año` string, b int"), str(tmp_path / "o"), single=True, mark=True)
    (part,) = (tmp_path / "o").glob("part-*")
    assert part.read_bytes().startswith(b"\xef\xbb\xbfa")


def test_privacy(spark):
    docs = [("a.PDF", b"x"), ("ok.csv", b"12345678Z"), ("t.txt", "uno\r\n12345678Z 12345678A X1234567L\n00000000T x12345678Z".encode()), ("b.bin", b"\xff\n12345678Z"), ("n.txt", None)]
    got = privacy.findings(spark.createDataFrame(docs, "path string, content binary"), allowed=("ok.csv",)).collect()
    assert {(r.path, r.line, r.kind, r.mark) for r in got} == {("a.PDF", None, "file", None), ("ok.csv", 1, "identity", "…78Z"), ("t.txt", 2, "identity", "…78Z"), ("t.txt", 2, "identity", "…67L")}


def test_flow_across_batches(spark):
    rows = [(d, i, ("text", "chart", "page")[(i * 7 + d) % 3], float(5 + i % 40), 3.0 + (i % 5)) for d in range(5) for i in range(60)] + [(None, 0, "text", 3.0, None)]
    blocks = layout.heights(spark.createDataFrame(rows, "doc_id long, place int, kind string, lines double, tall double"), 3)
    got = {(r.doc_id, r.place): r.page for r in layout.flowed(blocks).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert {(r.doc_id, r.place): r.page for r in layout.flowed(blocks).collect()} == got
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[(None, 0)] == 1
    for d in range(5):
        pages = [got[(d, i)] for i in range(60)]
        assert pages[0] == 1 and all(b - a in (0, 1) for a, b in zip(pages, pages[1:], strict=False))


def test_characters_without_places(spark):
    rows = [(1, 1, 0, "a", 0.0, 5.0, 1.0), (1, 1, 1, " ", 1.0, 4.0, 1.0), (1, 1, 2, " ", None, 4.0, 1.0), (1, 1, 3, "b", float("nan"), 4.0, 1.0), (1, 1, 4, " ", 5.2, 7.0, 1.0), (1, 1, 5, " ", 2.4, 3.0, 2.4), (1, 1, 6, "a", 0.5, 5.5, 1.2), (None, None, 7, None, 0.0, 1.0, 1.0)]
    chars = spark.createDataFrame(rows, "doc_id long, page int, no long, text string, x0 double, x1 double, top double")
    assert sorted(r.no for r in boxes.without_overlapping_blanks(chars).collect()) == [0, 2, 3, 4, 6, 7]
    assert sorted(r.no for r in boxes.drawn_once(chars).collect()) == [0, 1, 2, 3, 4, 5, 7]


def test_store_rules_in_order(spark):
    from assayline.schemas import conform

    t = lambda name, rows, cols: conform(spark.createDataFrame(rows, cols), TABLES[name])
    pat = t("patients", [(1, "A", "A", None, "H0"), (2, "B", "B", "H2", None), (3, "C", "C", "H3", None)], "id long, full_name string, name_key string, nhc string, nhc_alt string")
    rep = t("reports", [(10, 1, "n1"), (20, 2, "n1"), (21, 2, "n2"), (30, 3, "n2"), (31, 3, None)], "id long, patient_id long, report_number string")
    tar = t("targets", [(2, "urea", 2.0), (3, "urea", 3.0), (3, "calci", 9.0)], "patient_id long, canonical_id string, target_low double")
    marks = t("processed_files", [(1, "f", 20), (2, "g", 21)], "id long, filename string, report_id long")
    tables = {n: empty(spark, n) for n in TABLES} | {"patients": pat, "reports": rep, "targets": tar, "processed_files": marks}
    m = store.merge_patients(tables, spark.createDataFrame([(2, 1), (3, 1)], "source long, target long"))
    assert sorted((r.id, r.patient_id) for r in m["reports"].collect()) == [(10, 1), (21, 1), (31, 1)]
    assert [r.id for r in m["processed_files"].collect()] == [2]
    assert [(r.nhc, r.nhc_alt) for r in m["patients"].collect()] == [("H2", "H0,H3")]
    assert sorted((r.canonical_id, r.target_low) for r in m["targets"].collect()) == [("calci", 9.0), ("urea", 2.0)]
    new = t("reports", [(50, 7, "x", "f1", "2020-01-01"), (51, 7, "x", None, "2021-01-01"), (52, 7, "x", "f3", None)], "id long, patient_id long, report_number string, source_file string, request_date string")
    assert [(r.id, r.source_file, r.request_date) for r in store.upsert_reports(rep.limit(0), new).collect()] == [(50, "f3", "2020-01-01")]
