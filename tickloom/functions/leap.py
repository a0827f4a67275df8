"""TAI and UTC: leap seconds as a CASE expression, and nanosecond integers."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, from the public IERS Bulletin C: UTC date from which TAI - UTC is so many seconds; 0 before the first.
LEAP_SECONDS = [
    ("1972-01-01", 10), ("1972-07-01", 11), ("1973-01-01", 12), ("1974-01-01", 13), ("1975-01-01", 14), ("1976-01-01", 15), ("1977-01-01", 16), ("1978-01-01", 17), ("1979-01-01", 18), ("1980-01-01", 19),
    ("1981-07-01", 20), ("1982-07-01", 21), ("1983-07-01", 22), ("1985-07-01", 23), ("1988-01-01", 24), ("1990-01-01", 25), ("1991-01-01", 26), ("1992-07-01", 27), ("1993-07-01", 28), ("1994-07-01", 29),
    ("1996-01-01", 30), ("1997-07-01", 31), ("1999-01-01", 32), ("2006-01-01", 33), ("2009-01-01", 34), ("2012-07-01", 35), ("2015-07-01", 36), ("2017-01-01", 37),
]
NS = 1_000_000_000


def _starts() -> list[tuple[int, int]]:
    return [(int(datetime.fromisoformat(d).replace(tzinfo=UTC).timestamp()) * NS, s) for d, s in LEAP_SECONDS]


def _offset(ns: Column, shift: bool) -> Column:
    """TAI - UTC in ns at a UTC instant, or, if shift, at a TAI instant."""
    out = F.lit(0)
    for start, s in _starts():
        out = F.when(ns >= start + (s * NS if shift else 0), F.lit(s * NS)).otherwise(out)
    return out


def utc_to_tai(ns: Column) -> Column:
    return ns + _offset(ns, False)


def tai_to_utc(ns: Column) -> Column:
    return ns - _offset(ns, True)


def to_ns(ts: Column) -> Column:
    """A timestamp (microseconds) or an integer (already nanoseconds) as int64 nanoseconds."""
    whole = F.typeof(ts).isin("tinyint", "smallint", "int", "bigint")
    return F.when(whole, ts.cast("string").try_cast("bigint")).otherwise(F.unix_micros(ts.cast("timestamp")) * 1000)


def day_start(day: Column, is_utc: bool = True, tz_offset: timedelta = timedelta(0), offset: timedelta = timedelta(0)) -> Column:
    """The timestamp at which a date starts, tz_offset east of Greenwich, and offset later.

    The date names a day of UTC, or, without is_utc, of TAI, whose days have no leap seconds. Both offsets are elapsed
    time, so leap seconds between count.
    """
    ns = F.unix_date(day).cast("long") * (86_400 * NS)
    shift = round((offset - tz_offset) / timedelta(microseconds=1)) * 1000
    if is_utc and not shift:
        return F.timestamp_micros(F.unix_date(day).cast("long") * 86_400_000_000)
    return F.timestamp_micros(F.call_function("div", tai_to_utc((utc_to_tai(ns) if is_utc else ns) + shift), F.lit(1000)))
