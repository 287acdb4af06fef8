"""Time offsets in seconds, calendar parts, day buckets and gap arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
EPOCH = "2017-12-01"  # fixed value: day zero of the transaction clock
GAP_LINE = 480  # fixed value: intercept of the gap line


def event_time(offset: Column, epoch: str = EPOCH) -> Column:
    """Zone-free timestamp ``epoch + offset`` seconds."""
    whole = offset.cast("long")
    days = F.floor(whole / DAY).cast("int")
    secs = F.pmod(whole, F.lit(DAY)).cast("decimal(18,6)")
    start = F.lit(epoch).cast("date").cast("timestamp_ntz")
    return start + F.make_dt_interval(days, F.lit(0), F.lit(0), secs)


def offset_seconds(ts: Column, epoch: str) -> Column:
    """Whole seconds from ``epoch`` to a zone-free timestamp, whatever the session time zone."""
    days = F.datediff(ts.cast("date"), F.lit(epoch).cast("date")).cast("long")
    return days * DAY + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def weekday(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def calendar_parts(ts: Column) -> dict[str, Column]:
    return {"Weekday": F.weekday(ts), "Hour": F.hour(ts), "Day": F.dayofmonth(ts)}


# fixed values: first and last hour of each part of the day
DAY_PARTS = {"Morning": (7, 11), "Noon": (12, 18), "Evening": (19, 23), "Midnight": (0, 6)}


def day_part_flags(hour: Column) -> dict[str, Column]:
    return {name: hour.between(lo, hi).cast("int") for name, (lo, hi) in DAY_PARTS.items()}


def day_bucket(offset: Column, shift_hours: int = 12) -> Column:
    return F.floor((offset + 3600 * shift_hours) / DAY)


def gap_slope(gap: Column, offset: Column, line: int = GAP_LINE, day_shift: Column | int = 0) -> Column:
    return F.try_divide(gap - line, F.floor(offset / DAY) - day_shift)


def gap_delta(gap: Column, offset: Column, line: int = GAP_LINE) -> Column:
    return F.floor(offset / DAY) + line - gap


def gap_rate(gap: Column, offset: Column, line: int = GAP_LINE) -> Column:
    return F.try_divide(gap.cast("double"), F.floor(offset / DAY) + line)


def delta_sign(delta: Column) -> Column:
    """1 for a non-negative delta, 0 otherwise (missing included)."""
    return F.coalesce((delta >= 0).cast("int"), F.lit(0))


def shift_gap(gap: Column, days: int) -> Column:
    return gap - days
