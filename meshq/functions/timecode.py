"""Microsecond times and their three-limb form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMB = (1 << 21) - 1
#: Seconds beyond which microseconds don't fit a long.
MOST_SECONDS = 9_223_372_036_854.0


def _positive_us(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return whole.cast("long") * 1_000_000 + F.round((seconds - whole) * 1e6).cast("long")


def seconds_to_us(seconds: Column) -> Column:
    """Rounded half away from zero; whole seconds are split off first so that no digit is lost. What no long holds raises an error."""
    far = F.isnan(seconds) | (F.abs(seconds) > MOST_SECONDS)
    safe = F.when(~far, seconds)
    us = F.when(safe < 0, -_positive_us(-safe)).otherwise(_positive_us(safe))
    return F.when(far, F.raise_error(F.concat(F.lit("no time in microseconds: "), seconds.cast("string"))).cast("long")).otherwise(us)


def timestamp_to_us(ts: Column) -> Column:
    """Works for timestamps without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def limbs(us: Column) -> list[Column]:
    """Bits 42-62, 21-41 and 0-20, each plus one so that no coordinate is zero. Negative times raise an error."""
    good = F.when(us < 0, F.raise_error(F.concat(F.lit("a negative time: "), us.cast("string"))).cast("long")).otherwise(us)
    return [(F.shiftright(good, n).bitwiseAND(F.lit(LIMB)) + 1).cast("double") for n in (42, 21, 0)]


def stem_seconds(path: Column) -> Column:
    """The file stem as seconds; null if it is not a number in full."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1).try_cast("double")


def safe_timestamp(seconds: Column) -> Column:
    return F.replace(F.format_string("%.6f", seconds), F.lit("."), F.lit("_"))
