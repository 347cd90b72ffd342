"""Date and time columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import col

IST_MINUTES = 330


def leap_folded_doy(date) -> Column:
    """Day of year on a fixed 365-day frame; 29 February shares day 59."""
    d = col(date)
    doy = F.dayofyear(d)
    leap = F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) == 366
    return F.when(leap & (doy > 59), doy - 1).otherwise(doy)


def stamp_to_utc(stamp, offset_hours) -> Column:
    """``YYYYMMDDHH`` local stamp to a UTC instant; malformed stamps give NULL."""
    local = F.try_to_timestamp(col(stamp), F.lit("yyyyMMddHH"))
    return local - F.make_dt_interval(hours=col(offset_hours).cast("int"))


def utc_to_ist(ts) -> Column:
    """UTC instant to Indian wall-clock time (no zone)."""
    return (col(ts) + F.expr(f"INTERVAL {IST_MINUTES} MINUTES")).cast("timestamp_ntz")


def ist_to_utc(ts) -> Column:
    return (col(ts) - F.expr(f"INTERVAL {IST_MINUTES} MINUTES")).cast("timestamp")


def date_of_year_day(year, doy) -> Column:
    return F.date_add(F.make_date(col(year), F.lit(1), F.lit(1)), (col(doy) - 1).cast("int"))


def partial_date(year, month, day, first_year: int = 2007, last_year: int = 2011) -> Column:
    """A date only when every part is in range and the day exists."""
    y, m, d = col(year), col(month), col(day)
    valid = y.between(first_year, last_year) & m.between(1, 12) & d.between(1, 31)
    text = F.format_string("%04d-%02d-%02d", y.cast("int"), m.cast("int"), d.cast("int"))
    return F.when(valid, F.try_to_date(text, "yyyy-MM-dd"))


def night_date(ts, start_hour: int = 22, end_hour: int = 6) -> Column:
    """Date a night reading belongs to -- the day the night ends on; NULL by day."""
    t = col(ts)
    return F.when(F.hour(t) >= start_hour, F.date_add(F.to_date(t), 1)).when(F.hour(t) < end_hour, F.to_date(t))


def ist_iso(ts_utc) -> Column:
    """ISO-8601 with the +05:30 offset."""
    shifted = col(ts_utc) + F.expr(f"INTERVAL {IST_MINUTES} MINUTES")
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))


def expected_hours(year) -> Column:
    """8784 in leap years, else 8760."""
    return F.dayofyear(F.make_date(col(year), F.lit(12), F.lit(31))) * 24
