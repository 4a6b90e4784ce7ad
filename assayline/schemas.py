"""Explicit schemas of the stored tables and of the long measurement model, and the enumerations that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: State words, part of the data model (fixed values).
HIGH, LOW, NORMAL = "alto", "bajo", "normal"
REAL, EXPECTED, OTHER_LAB = "real", "esperable", "otro_lab"
WORSE, BETTER, SAME = "empeora", "mejora", "igual"
UP, DOWN = "sube", "baja"
SUFFICIENCY = ("sin_datos", "un_punto", "pocos", "suficiente")
HOME, OFFICE = "casa", "consulta"
MANUAL_LAB = "Entrada manual"


def _schema(text: str) -> T.StructType:
    """From "name type, ..."; needs no session."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))])


TABLES: dict[str, T.StructType] = {
    "patients": _schema("id long, full_name string, name_key string, birth_date string, dni string, nhc string, nhc_alt string, sex string, cip string, smoker_current int, smoker_former int, smoker_former_from int, smoker_former_to int, smoker_former_period string"),
    "reports": _schema("id long, patient_id long, report_number string, request_date string, validation_date string, source_file string, file_md5 string, assistance_number string, lab string, notes string"),
    "results": _schema("id long, report_id long, section string, test_group string, loinc_code string, raw_name string, canonical_id string, value_raw string, value_num double, unit string, ref_low double, ref_high double, ref_text string, flag_pdf string, flag_calc string, sample_date string"),
    "processed_files": _schema("id long, filename string, file_hash string, processed_at string, status string, error_message string, report_id long"),
    "settings": _schema("key string, value string"),
    "targets": _schema("patient_id long, canonical_id string, target_low double, target_high double, note string, set_on string"),
    "bp_readings": _schema("id long, patient_id long, measured_at string, systolic int, diastolic int, pulse int, place string, note string, source string"),
}
VARIATION = _schema("canonical_id string, analyte string, cvi double, cvi_f double, cvi_m double, cva double, source string, doi string, note string")
#: One measured point of one patient's series of one test.
SERIES = _schema("patient_id long, canonical_id string, result_id long, fecha string, value_num double, unit string, ref_low double, ref_high double, lab string, raw_name string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast; those that are missing as nulls, others left out (additive migration)."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def empty(spark, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def table(tables: dict[str, DataFrame], name: str) -> DataFrame:
    """A stored table by name, in row order; only the known names are served."""
    if name not in TABLES:
        raise ValueError(f"no such table: {name}")
    first = TABLES[name].fieldNames()[0]
    return tables[name].orderBy(first)
