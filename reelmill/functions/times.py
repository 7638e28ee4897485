"""Reference times, ages and buckets."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def at(moment: datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def on(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def _steps(value: Column, bounds: list[tuple[int, object]], last: object) -> Column:
    out = None
    for limit, label in bounds:
        out = F.when(value < limit, label) if out is None else out.when(value < limit, label)
    return out.otherwise(F.lit(last))


def age_bucket(birth: Column, as_of: datetime) -> Column:
    """Age as whole 365-day years in six buckets; 0 = unknown."""
    years = F.floor(F.date_diff(on(as_of.date()), birth.cast("date")) / 365)
    # Bucket limits.
    return F.when(birth.isNull(), 0).otherwise(_steps(years, [(18, 1), (25, 2), (35, 3), (45, 4), (55, 5)], 6))


def calendar_age(birth: Column, as_of: datetime) -> Column:
    """Completed calendar years, never negative, NULL when unknown."""
    before_birthday = (F.month(birth) * 100 + F.dayofmonth(birth)) > as_of.month * 100 + as_of.day
    years = F.lit(as_of.year) - F.year(birth) - before_birthday.cast("int")
    return F.when(birth.isNotNull(), F.greatest(years, F.lit(0)))


def age_label(age: Column) -> Column:
    # Label names and limits.
    steps = [(18, "lt18"), (25, "18_24"), (35, "25_34"), (45, "35_44"), (55, "45_54")]
    return F.when(age.isNull() | (age <= 0), "unknown").otherwise(_steps(age, steps, "55_plus"))


def register_bucket(created: Column, as_of: datetime) -> Column:
    """Full days since registration in five buckets; 0 = unknown."""
    days = F.timestamp_diff("DAY", created, at(as_of))
    # Bucket limits.
    return F.when(created.isNull(), 0).otherwise(_steps(days, [(30, 1), (180, 2), (365, 3), (1095, 4)], 5))


def parse_moment(text: Column) -> Column:
    """Date and time, date only, or ISO 8601 text to a zone-free timestamp; NULL when blank or unreadable."""
    value = F.nullif(F.trim(text), F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"),
        F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("timestamp_ntz"),
        value.try_cast("timestamp_ntz"),
    )
