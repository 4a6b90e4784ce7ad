import datetime

import pytest
from pyspark.sql import functions as F

from assayline.functions import dates, indices, ranges, text, units


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


L = F.lit


@pytest.mark.parametrize(("v", "lo", "hi", "want"), [(None, 0, 1, None), (2, 0, 1, "alto"), (-1, 0, 1, "bajo"), (1, 0, 1, "normal"), (1, None, None, None), (5, None, 5, "normal")])
def test_flag(spark, v, lo, hi, want):
    c = lambda x: L(x).cast("double")
    assert value(spark, ranges.flag(c(v), c(lo), c(hi))) == want


@pytest.mark.parametrize(("v", "lo", "hi", "least", "most"), [(14, 12, 16, 0, 0), (11.9, 12, 16, -1, -0.3), (16.1, 12, 16, 0.3, 1), (20, 12, 16, 1, 1), (0, 12, 16, -1, -1), (300, None, 200, 1, 1)])
def test_position(spark, v, lo, hi, least, most):
    c = lambda x: L(x).cast("double")
    assert least <= value(spark, ranges.position(c(v), c(lo), c(hi))) <= most


@pytest.mark.parametrize(("p", "v", "lo", "hi", "want"), [(70, 90, 40, 80, "empeora"), (55, 62, 40, 80, "igual"), (95, 75, 40, 80, "mejora"), (35, 31, 40, 80, "empeora"), (7.5, 6.1, None, 5, "mejora")])
def test_change_status(spark, p, v, lo, hi, want):
    c = lambda x: L(x).cast("double")
    assert value(spark, ranges.change_status(c(p), c(v), c(lo), c(hi))) == want


@pytest.mark.parametrize(("x", "want"), [("7,5", 7.5), ("-12.75", -12.75), ("4.5.6", None), ("32.000", 32000.0), ("5.678,25", 5678.25)])
def test_numbers(spark, x, want):
    assert value(spark, text.to_number(L(x))) == want


@pytest.mark.parametrize(("x", "want"), [("3/2/24", "2024-02-03"), ("2024-02-03 08:15", "2024-02-03 08:15:00"), ("3 de març de 2024", "2024-03-03"), ("el 03/02/2024 7:05:09", "2024-02-03 07:05:09"), ("nada", None)])
def test_dates(spark, x, want):
    assert value(spark, text.parse_date(L(x))) == want


def test_names(spark):
    assert value(spark, text.normalize_name(L("  García, María-José "))) == "MARIA JOSE GARCIA"
    assert value(spark, text.normalize_test_name(L("Colesterol HDL (sèrum)!"))) == "colesterol hdl serum"
    assert value(spark, text.name_signature(L("Hierro en suero"))["key"]) == value(spark, text.name_signature(L("Ferro (sèrum)"))["key"])
    assert value(spark, text.name_signature(L("GOT (AST)"))["abbreviations"]) == ["ast"]


def test_cells(spark):
    assert value(spark, text.defuse_formula(L("=SUM(A1:B2)"))).startswith("'")
    assert value(spark, text.defuse_formula(L("-1.5"))) == "-1.5"
    assert value(spark, text.clean_note(L(" a\n\tb "))) == "a b"
    assert value(spark, text.identity_valid(L("00000001R")))
    assert not value(spark, text.identity_valid(L("00000000T")))
    assert value(spark, text.newer(L("v1.10.0"), L("1.9.9")))


def test_units(spark):
    a = lambda *x: F.array(*[L(v) for v in x])
    assert value(spark, units.key(L(" x10³/µL"))) == "x10^3/mcl"
    assert value(spark, units.relation(a("mg/dL"), a("g/L"))) == "convertible"
    assert value(spark, units.relation(a("mg/dL"), a("mmol/L"))) == "incompatible"
    assert value(spark, units.relation(a("index"), a("mg/dL"))) == "desconocida"


def test_formulas(spark):
    c = lambda x: L(x).cast("double")
    assert value(spark, indices.fib4(c(50), c(80), c(200), c(40))) == pytest.approx(3.1623, abs=1e-4)
    assert value(spark, indices.apri(c(80), c(200))) == 1.0
    assert value(spark, indices.de_ritis(c(30), c(0))) is None
    assert value(spark, indices.rcv_down(c(10), c(2))) == pytest.approx(-26.6, abs=0.1)
    assert value(spark, indices.rcv_up(c(10), c(2))) == pytest.approx(36.2, abs=0.1)
    assert value(spark, dates.age_at(L("1980-06-15"), L("2024-01-01"))) == 43
    assert value(spark, dates.age_at(L("1980-06-15"), L("2024-06-15"))) == 44
    assert value(spark, indices.kdigo_risk(L("G3a"), L("A2"))) == 3
    assert value(spark, indices.rcv_state(c(100), c(140), L("A"), L("B"), c(10), c(2))) == "otro_lab"
    assert value(spark, indices.rcv_state(c(100), c(140), L(None).cast("string"), L(""), c(10), c(2))) == "real"


def test_reading_times(spark):
    now = L("2024-05-01 10:00:00").cast("timestamp")
    assert value(spark, dates.parse_datetime(L("01/05/2024 09:30"), now)) == datetime.datetime(2024, 5, 1, 9, 30)
    assert value(spark, dates.parse_datetime(L("2024-05-01 10:10"), now)) is None
