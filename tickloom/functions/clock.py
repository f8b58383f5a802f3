"""Clock representations: packed ``HHMMSSuuuuuu`` integers and microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
SESSION_START = 90_000_000_000   # 09:00:00.000000 packed
SESSION_END = 153_000_000_000    # 15:30:00.000000 packed


def packed_to_micros(packed: Column) -> Column:
    value = packed.cast("bigint")
    clock = F.floor(value / SECOND_US)
    hours, minutes, seconds = F.floor(clock / 10_000), F.floor(clock / 100) % 100, clock % 100
    return (hours * 3600 + minutes * 60 + seconds) * SECOND_US + value % SECOND_US


def packed_to_seconds(packed: Column) -> Column:
    return packed_to_micros(packed) / float(SECOND_US)


def micros_to_packed(micros_of_day: Column) -> Column:
    value = micros_of_day.cast("bigint")
    total = F.floor(value / SECOND_US)
    hours, minutes, seconds = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return (hours * 10_000 + minutes * 100 + seconds) * SECOND_US + value % SECOND_US


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall clock. Built from its fields, so that neither the session
    zone nor its daylight saving changes a timestamp that has no zone."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    micros = (F.extract(F.lit("SECOND"), ts) * SECOND_US).cast("bigint")
    return ((days * 24 + F.hour(ts)) * 60 + F.minute(ts)) * 60 * SECOND_US + micros


def bucket_of(micros: Column, width_us: int) -> Column:
    return F.floor(micros / F.lit(width_us)).cast("bigint")
