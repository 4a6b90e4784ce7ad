"""Dates that are stored as sortable text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective(sample: Column, request: Column, validation: Column) -> Column:
    """The sample's date, else the request's, else the validation's."""
    return F.coalesce(sample, request, validation)


def day(fecha: Column) -> Column:
    return F.to_date(F.substring(fecha, 1, 10))


def age_at(birth: Column, fecha: Column) -> Column:
    """Completed years; null without a birth date."""
    b, d = F.to_date(birth), day(fecha)
    return F.year(d) - F.year(b) - F.when(F.struct(F.month(d), F.dayofmonth(d)) < F.struct(F.month(b), F.dayofmonth(b)), 1).otherwise(0)


def five_years_before(fecha: Column) -> Column:
    """A text cut-off with the same month and day, also for 29 February."""
    return F.concat((F.substring(fecha, 1, 4).cast("int") - 5).cast("string"), F.substr(fecha, F.lit(5)))


FORMATS = ("yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyy/MM/dd HH:mm", "dd.MM.yyyy HH:mm", "MMM d yyyy HH:mm")


def parse_datetime(x: Column, now: Column) -> Column:
    """A reading's time by the first format that fits; before 1900 or more than five minutes ahead is refused."""
    t = F.regexp_replace(F.regexp_replace(x, "T", " "), r"^\s+|\s+$|,", "")
    at = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in FORMATS])
    return F.when((F.year(at) >= 1900) & (at <= now + F.expr("INTERVAL 5 MINUTES")), at)
