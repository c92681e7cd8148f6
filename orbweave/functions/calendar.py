"""Epochs as column expressions: decimal years, midpoints, and the names and headers of monthly model files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern of monthly model file names.
NAME = r"(?i)^([A-Za-z]{3})-?(\d*)_?(\d{4})(\d{3})-(\d{4})(\d{3})_([A-Z]{4})_([A-Z]{5})_([A-Z]{2}\d{2})_(\d{4})"
#: Fixed pattern of the period in such a file's header.
PERIOD = r"(\d{8})\s*-\s*(\d{8})"
DAYS = 86400.0


def year_length(year: Column) -> Column:
    leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
    return F.when(leap, F.lit(366.0)).otherwise(F.lit(365.0))


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    day = F.to_date(ts)
    return F.datediff(day, F.lit("1970-01-01").cast("date")) * DAYS + F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.second(ts)


def decimal_year(ts: Column) -> Column:
    """year + (day of year - 1 + part of day) / days of the year."""
    day = F.dayofyear(ts) - 1 + (F.hour(ts) * 3600.0 + F.minute(ts) * 60.0 + F.second(ts)) / DAYS
    return F.year(ts) + day / year_length(F.year(ts))


def date_of(year: Column) -> Column:
    """Timestamp without zone of a decimal year, to the second."""
    whole = F.floor(year).cast("int")
    part = (year - whole) * year_length(whole) * DAYS
    return F.make_date(whole, F.lit(1), F.lit(1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.round(part).cast("decimal(18,6)"))


def midpoint(start: Column, last: Column) -> tuple[Column, Column]:
    """(midpoint as timestamp without zone, decimal year) of the days from start to last, both inclusive; the decimal
    year counts from the start's year."""
    zero = F.lit("1970-01-01").cast("date")
    mid = (F.datediff(start, zero) + F.datediff(last, zero) + 1) / 2.0
    at = F.timestamp_seconds(F.round(mid * DAYS).cast("long")).cast("timestamp_ntz")
    year = F.year(start)
    return at, year + (mid - F.datediff(F.make_date(year, F.lit(1), F.lit(1)), zero)) / year_length(year)


def name_fields(name: Column) -> dict[str, Column]:
    """Parts of a monthly model file's name; all null where it has another form."""
    fits = name.rlike(NAME)
    part = lambda k: F.when(fits, F.regexp_extract(name, NAME, k))
    day = lambda y, d: F.date_add(F.make_date(part(y).cast("int"), F.lit(1), F.lit(1)), part(d).cast("int") - 1)
    start, last = day(3, 4), day(5, 6)
    mid, year = midpoint(start, last)
    return {"product": F.upper(part(1)), "mission": F.upper(part(7)), "center": F.upper(part(8)), "degtype": F.upper(part(9)), "rl": part(10), "start_date": start, "end_date": last, "mid": mid, "decimal_year": year}


def header_period(text: Column) -> tuple[Column, Column]:
    """(start, last day) from a header: the period of data (its end is inclusive), else the coverage window (exclusive)."""
    line = F.regexp_extract(text, r"(?im)^\s*time_period_of_data\s*[:=]?\s*(.*)$", 1)
    a, b = (F.to_date(F.nullif(F.regexp_extract(line, PERIOD, k), F.lit("")), "yyyyMMdd") for k in (1, 2))
    edge = lambda key: F.to_date(F.nullif(F.regexp_extract(text, rf"(?im)^\s*time_coverage_{key}\s*[:=]?\s*'?(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit("")))
    return F.coalesce(a, edge("start")), F.coalesce(b, F.date_sub(edge("end"), 1))


#: Seconds of the units of numeric time; months and years have no fixed length and are refused.
TIME_UNITS = {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0, "min": 60.0, "minute": 60.0, "minutes": 60.0, "h": 3600.0, "hour": 3600.0, "hours": 3600.0, "d": 86400.0, "day": 86400.0, "days": 86400.0}


def numeric_time(value: Column, units: str) -> Column:
    """Timestamp without zone of 'days since 2000-01-01' and the like."""
    unit, _, since = units.strip().partition(" since ")
    if unit.lower() not in TIME_UNITS or not since:
        raise ValueError(f"numeric time in {units!r} has no dates")
    start = F.lit(since.strip().replace("T", " ")).cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=F.round(value * TIME_UNITS[unit.lower()]).cast("decimal(18,6)"))
