"""Times: milliseconds, frames of 1/75 s and clocks of 90 kHz, all as integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole(a: Column, n: int) -> Column:
    """Integer division of numbers that are not negative."""
    return F.floor(a / F.lit(n)).cast("long")


def timestamp_text(ms: Column) -> Column:
    """HH:MM:SS,mmm; hours go past 99."""
    return F.format_string("%02d:%02d:%02d,%03d", whole(ms, 3_600_000), whole(ms, 60_000) % 60, whole(ms, 1000) % 60, ms % 1000)


def parse_timestamp(text: Column) -> Column:
    """The inverse; a comma or a full stop before the milliseconds; null if it is no time."""
    pattern = r"^\s*([0-9]+):([0-9]+):([0-9]+)[,.]([0-9]{1,3})\s*$"
    part = lambda i: F.regexp_extract(text, pattern, i).cast("long")
    return F.when(text.rlike(pattern), part(1) * 3_600_000 + part(2) * 60_000 + part(3) * 1000 + F.rpad(F.regexp_extract(text, pattern, 4), 3, "0").cast("long"))


def msf(frames: Column) -> Column:
    """Frames as mm:ss:ff."""
    return F.format_string("%02d:%02d:%02d", whole(frames, 75 * 60), whole(frames, 75) % 60, frames % 75)


def frames_to_ms(frames: Column) -> Column:
    return whole(frames * 1000, 75)


def frames(minutes: Column, seconds: Column, frame: Column) -> Column:
    return (minutes * 60 + seconds) * 75 + frame


def seconds_to_ms(seconds: Column) -> Column:
    """Seconds as text or number to rounded milliseconds, never negative."""
    return F.greatest(F.round(F.coalesce(F.try_to_number(seconds, F.lit("999999999.999999")).cast("double"), seconds.try_cast("double"), F.lit(0.0)) * 1000).cast("long"), F.lit(0).cast("long"))


def hms(ms: Column) -> Column:
    return F.format_string("%d:%02d:%02d", whole(ms, 3_600_000), whole(ms, 60_000) % 60, whole(ms, 1000) % 60)


def duration_ms(text: Column) -> Column:
    """h:m:s, m:s or s in milliseconds."""
    return F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda a, p: a * 60 + F.coalesce(p.try_cast("long"), F.lit(0).cast("long")), lambda a: a * 1000)


def year_of(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def dcsq_ms(delay: Column) -> Column:
    """Delays of subpictures tick every 1024 of 90,000 a second."""
    return whole(delay * 1024 * 1000, 90_000)
