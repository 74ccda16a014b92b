"""Column expressions shared by the operators. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from basketflow.params import MINUTE_NS, NS


def half_even(x: Column, decimals: int) -> Column:
    """Round the scaled double half to even."""
    scale = float(10**decimals)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def safe_div(a: Column, b: Column) -> Column:
    """Division whose zero divisor gives NULL (ANSI `/` raises)."""
    return F.try_divide(a, b)


def int_div(x: Column, n: int | Column) -> Column:
    """Integral division; nanosecond clocks do not fit a double."""
    return F.call_function("div", x, n if isinstance(n, Column) else F.lit(n).cast("bigint"))


def second_of(ts_ns: Column) -> Column:
    return int_div(ts_ns, NS)


def minute_of(ts_ns: Column) -> Column:
    return int_div(ts_ns, MINUTE_NS)


def minute_ceil(ts_ns: Column) -> Column:
    return int_div(ts_ns + F.lit(MINUTE_NS - 1), MINUTE_NS)


def clock_code(second: Column) -> Column:
    """10,000,000 + hhmmss of an epoch second, UTC clock."""
    of_day = F.pmod(second, F.lit(86400))
    hh = int_div(of_day, 3600)
    mm = F.pmod(int_div(of_day, 60), F.lit(60))
    ss = F.pmod(of_day, F.lit(60))
    return (F.lit(10_000_000) + hh * 10_000 + mm * 100 + ss).cast("int")


def to_timestamp(ts_ns: Column) -> Column:
    """Epoch nanoseconds as TIMESTAMP (microseconds)."""
    return F.timestamp_micros(int_div(ts_ns, 1000))


def bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.cast("int"))


def has_bit(mask: Column, position: Column) -> Column:
    return mask.bitwiseAND(bit(position)) != F.lit(0)


def lenient_date(text: Column) -> Column:
    """`YYYY/MM/DD` or `YYYY-MM-DD`; anything else gives NULL. Only the format that can
    match is tried: a failed one costs an exception a row."""
    day = F.trim(text)
    slashed = F.try_to_timestamp(day, F.lit("yyyy/MM/dd"))
    return F.when(F.contains(day, F.lit("/")), slashed).otherwise(F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))).cast("date")


def clip(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)
