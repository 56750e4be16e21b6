"""DOS and FILETIME stamps against Unix seconds, in integer column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1980-01-01 in Unix seconds, and seconds between 1601 and 1970.
DOS_EPOCH = 315_532_800
FILETIME_SHIFT = 11_644_473_600


def _stamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def dos_date(seconds: Column) -> Column:
    """The 16-bit DOS date, clamped to 1980 ... 2107."""
    t = _stamp(seconds)
    packed = (F.year(t) - 1980) * 512 + F.month(t) * 32 + F.dayofmonth(t)
    return F.when(seconds < DOS_EPOCH, 0x0021).when(F.year(t) > 2107, 0xFF9F).otherwise(packed).cast("int")


def dos_time(seconds: Column) -> Column:
    t = _stamp(seconds)
    packed = F.hour(t) * 2048 + F.minute(t) * 32 + F.floor(F.second(t) / 2)
    return F.when(seconds < DOS_EPOCH, 0).when(F.year(t) > 2107, 0xBF7D).otherwise(packed).cast("int")


def from_dos(date: Column, time: Column) -> Column:
    """Unix seconds of DOS fields; each field is clamped by itself, so 31 February runs on into March."""
    year = 1980 + F.shiftright(date, 9)
    month = F.least(F.greatest(F.shiftright(date, 5).bitwiseAND(15), F.lit(1)), F.lit(12))
    day = F.greatest(date.bitwiseAND(31), F.lit(1))
    hour = F.least(F.shiftright(time, 11).bitwiseAND(31), F.lit(23))
    minute = F.least(F.shiftright(time, 5).bitwiseAND(63), F.lit(59))
    second = F.least(time.bitwiseAND(31) * 2, F.lit(58))
    days = F.datediff(F.make_date(year, month, F.lit(1)), F.lit("1970-01-01").cast("date")) + day - 1
    return days.cast("long") * 86_400 + hour * 3600 + minute * 60 + second


def from_filetime(ticks: Column) -> Column:
    whole = (ticks - F.pmod(ticks, F.lit(10_000_000))).cast("decimal(20,0)") / 10_000_000
    return whole.cast("long") - FILETIME_SHIFT


def to_filetime(seconds: Column) -> Column:
    return F.greatest(seconds + FILETIME_SHIFT, F.lit(0)) * 10_000_000


def modified(extra: Column, dos_seconds: Column) -> Column:
    """An extra field's time comes before the DOS stamp."""
    return F.coalesce(extra, dos_seconds)
