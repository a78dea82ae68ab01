"""Times of day, calendar periods and epoch conversions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hours [from, to) of the parts of the day in two profiles. Night of profile A runs over midnight.
PROFILE_A = {"Evening": (19, 23), "Morning": (6, 12), "Day": (12, 19), "Night": (23, 6), "AllDay": (0, 24)}
PROFILE_B = {"night": (0, 6), "morning": (6, 10), "day": (10, 19), "evening": (19, 25), "all": (0, 25)}


def in_part(ts: Column, hours: tuple[int, int]) -> Column:
    first, last = hours
    hour = F.hour(ts)
    return (hour >= first) & (hour < last) if first <= last else (hour >= first) | (hour < last)


def part_filters(ts: Column, profile: dict[str, tuple[int, int]]) -> dict[str, Column]:
    return {name: in_part(ts, hours) for name, hours in profile.items()}


def part_name(ts: Column, profile: dict[str, tuple[int, int]]) -> Column:
    """The first part that holds the time and is not the whole day."""
    out = F.lit(None).cast("string")
    for name, hours in reversed(profile.items()):
        if name not in ("AllDay", "all"):
            out = F.when(in_part(ts, hours), F.lit(name)).otherwise(out)
    return out


def week_suffix(ts: Column) -> Column:
    """The Monday of the week as yyyy-MM-dd."""
    return F.date_format(F.date_trunc("week", ts), "yyyy-MM-dd")


def day_of_period(ts: Column, size: int) -> Column:
    """Number of the day in a week (7, Monday is 0), a month (31) or a year (356)."""
    kinds = {7: F.weekday, 31: F.dayofmonth, 356: F.dayofyear}
    if size not in kinds:
        raise ValueError(f"a period has 7, 31 or 356 days, not {size}")
    return kinds[size](ts)


def period_keys(size: int) -> Column:
    """All day numbers that the period can have: a month is 1 to 31 and a year 1 to 366."""
    first, last = {7: (0, 6), 31: (1, 31), 356: (1, 366)}[size]
    return F.sequence(F.lit(first), F.lit(last))


def day_name(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def seconds_half_up(s: Column) -> Column:
    """A timestamp from fractional epoch seconds, rounded half up to whole ones."""
    return F.timestamp_seconds(F.floor(s + 0.5).cast("long"))


def epoch_seconds(ts: Column) -> Column:
    """Epoch seconds with microseconds, as a double."""
    return F.unix_micros(ts) / F.lit(1e6)


def post_time(text: Column) -> Column:
    """``Sun Nov 23 10:00:00 +0000 2014`` as a timestamp; null if it has another form."""
    return F.try_to_timestamp(F.substring(text, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy"))
