"""Time scales: barycentric dynamical seconds past J2000 (ET) and UTC texts, and elapsed times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First days of TAI - UTC = 10, 11, ... 37 seconds.
LEAP_DAYS = (
    "1972-01-01", "1972-07-01", "1973-01-01", "1974-01-01", "1975-01-01", "1976-01-01", "1977-01-01", "1978-01-01", "1979-01-01", "1980-01-01",
    "1981-07-01", "1982-07-01", "1983-07-01", "1985-07-01", "1988-01-01", "1990-01-01", "1991-01-01", "1992-07-01", "1993-07-01", "1994-07-01",
    "1996-01-01", "1997-07-01", "1999-01-01", "2006-01-01", "2009-01-01", "2012-07-01", "2015-07-01", "2017-01-01",
)
FIRST_LEAP = 10
#: TT - TAI, and noon of 2000-01-01 in seconds of the Unix epoch.
TT_TAI, J2000 = 32.184, 946728000
# Periodic part of TDB - TT, K sin(M + E sin M), M = M0 + M1 t.
K, EB, M0, M1 = 1.657e-3, 1.671e-2, 6.239996, 1.99096871e-7


def _unix(day: str) -> Column:
    return F.unix_date(F.lit(day).cast("date")).cast("long") * 86400


def _periodic(t: Column) -> Column:
    m = M0 + M1 * t
    return K * F.sin(m + EB * F.sin(m))


def _leap(t: Column, unit: int, clock: bool) -> Column:
    """TAI - UTC at a time in units of a second, on a clock without leaps (TAI) or of UTC."""
    starts = F.array(*((_unix(day) + (FIRST_LEAP + i if clock else 0)) * unit for i, day in enumerate(LEAP_DAYS)))
    return F.greatest(F.lit(FIRST_LEAP), FIRST_LEAP - 1 + F.size(F.filter(starts, lambda s: s <= t)))


def et_from_utc(utc: Column) -> Column:
    """seconds past J2000 (TDB) of a UTC timestamp or text; null for what is no time."""
    seconds = F.unix_micros(utc.try_cast("timestamp")) / 1e6
    tt = seconds + _leap(seconds, 1, False) + TT_TAI - J2000
    return tt + _periodic(tt)


def utc_from_et(et: Column) -> Column:
    """UTC text with milliseconds of seconds past J2000 (TDB). A leap second reads 23:59:60."""
    tai = F.round((et - _periodic(et) - TT_TAI + J2000) * 1000).cast("long")
    before = tai - 1000 * _leap(tai, 1000, True)
    # During a leap second the leap to come is a second away; the text is that of the second before, with 60 for 59.
    inside = (_leap(tai + 1000, 1000, True) > _leap(tai, 1000, True)) & (before % 86400000 < 1000)
    text = F.date_format(F.timestamp_millis(before - F.when(inside, 1000).otherwise(0)), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.when(inside, F.concat(F.substring(text, 1, 17), F.lit("60"), F.substring(text, 20, 4))).otherwise(text)


def elapsed(start: Column, end: Column) -> Column:
    """hours, minutes and seconds between two timestamps as text, days before them; negative ones count from the
    day before."""
    us = F.unix_micros(end) - F.unix_micros(start)
    days, rest = F.floor(us / 86400000000), F.pmod(us, F.lit(86400000000))
    clock = F.concat(F.floor(rest / 3600000000).cast("string"), F.format_string(":%02d:%02d", F.floor(rest / 60000000) % 60, F.floor(rest / 1000000) % 60))
    micros = F.when(rest % 1000000 != 0, F.format_string(".%06d", rest % 1000000)).otherwise("")
    lead = F.when(days == 0, "").when(F.abs(days) == 1, F.concat(days.cast("string"), F.lit(" day, "))).otherwise(F.concat(days.cast("string"), F.lit(" days, ")))
    return F.concat(lead, clock, micros)


def now() -> Column:
    """the time at which the query starts, with its zone."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
