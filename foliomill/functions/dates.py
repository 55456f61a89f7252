"""Dates and times of court documents as Column expressions (DT-*, NRM-16)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import once

#: Spanish month names, in order. Fixed values.
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")

DATE_LABELS = ("FECHA_RESOLUCION",)
TIME_LABELS = ("HORA_DE_INICIO", "HORA_DE_CIERRE")

_MONTH = "|".join(MONTHS)
#: (regex, group of day, of month, of year) in the order in which suggestions are made.
DATE_FORMS = (
    (r"(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})(?:[^0-9]|$)", 4),
    (r"(?:^|[^0-9])([0-9]{1,2})/([0-9]{1,2})/([0-9]{2})(?:[^0-9]|$)", 2),
    (r"(?:^|[^0-9])([0-9]{2})/([0-9]{2})/([0-9]{4})(?:[^0-9]|$)", 4),
    (r"(?:^|[^0-9])([0-9]{2})/([0-9]{2})/([0-9]{2})(?:[^0-9]|$)", 2),
    (rf"(?i)([0-9]{{1,2}}) de ({_MONTH}) del? ([0-9]{{4}})", 4),
    (rf"(?i)([0-9]{{1,2}}) de ({_MONTH}) ([0-9]{{4}})", 4),
)
TIME_FORMS = (
    r"([0-9]{2})[.:]([0-9]{2})",
    r"(?i)([0-9]{1,2})[.:]([0-9]{2}) horas",
    r"(?i)([0-9]{1,2}).([0-9]{2}) h(?:rs|r|s)\.?",
)


def month_number(name: Column) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(name)), F.lit(0)).cast("int")


def checked_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where there is none."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def two_digit_year(year: Column) -> Column:
    return year + F.when(year < 69, 2000).otherwise(1900)


def date_suggestions(text: Column) -> Column:
    """``dd/MM/yyyy`` for each form that the text has, in order, duplicates included."""
    return once(text, _date_suggestions)


def _date_suggestions(text: Column) -> Column:
    out = []
    for pattern, digits in DATE_FORMS:
        day, month, year = (F.regexp_extract(text, pattern, g) for g in (1, 2, 3))
        month = month_number(month) if "de (" in pattern else month.try_cast("int")
        year = two_digit_year(year.try_cast("int")) if digits == 2 else year.try_cast("int")
        out.append(F.date_format(checked_date(year, month, day.try_cast("int")), "dd/MM/yyyy"))
    return F.array_compact(F.array(*out))


def time_suggestions(text: Column) -> Column:
    """``HH:mm`` for each form that the text has, in order, duplicates included."""
    out = []
    for pattern in TIME_FORMS:
        hour, minute = (F.regexp_extract(text, pattern, g).try_cast("int") for g in (1, 2))
        out.append(F.when((hour < 24) & (minute < 60), F.format_string("%02d:%02d", hour, minute)))
    return F.array_compact(F.array(*out))


def datetime_subclass(label: Column, text: Column, subclass: Column) -> Column:
    """Suggestions for date and time labels, the old subclass for all others."""
    return F.when(label.isin(*DATE_LABELS), date_suggestions(text)).when(label.isin(*TIME_LABELS), time_suggestions(text)).otherwise(subclass)


def parse_dmy(value: Column) -> Column:
    """``d_m_yy`` or ``d_m_yyyy`` as a date; null for anything else or an impossible one."""
    parts = F.split(value, "_")
    day, month, year = (F.get(parts, i).try_cast("int") for i in range(3))
    year = F.when(F.length(F.get(parts, 2)) == 2, two_digit_year(year)).otherwise(year)
    return F.when((F.size(parts) == 3) & (day <= 31) & (month <= 12), checked_date(year, month, day))


def format_dmy(value: Column) -> Column:
    return F.date_format(parse_dmy(value), "yyyy/MM/dd")
