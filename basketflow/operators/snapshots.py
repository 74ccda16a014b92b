"""Closed sliding snapshots [T - lookback, T] and the per-second roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.functions.scalars import (
    clock_code,
    half_even,
    int_div,
    minute_ceil,
    minute_of,
    safe_div,
    second_of,
)
from basketflow.operators.ticks import in_calendar, usable_weights
from basketflow.params import Calendar


def with_trigger_range(trades: DataFrame, calendar: Calendar) -> DataFrame:
    """First and last trigger minute whose snapshot holds the row.

    Both snapshot ends are closed, so a row exactly on a minute already
    belongs to that minute. The quote must lie in the snapshot as well; as the
    quote is never younger than the trade, it alone limits the last trigger.
    """
    limit = F.coalesce(F.col("quote_ts_ns"), F.col("ts_ns"))
    return (
        trades.withColumn("first_trigger", minute_ceil(F.col("ts_ns")))
        .withColumn("last_trigger", minute_of(limit) + F.lit(calendar.lookback_minutes))
        .filter("first_trigger <= last_trigger")
    )


def fan_out(rows: DataFrame, calendar: Calendar) -> DataFrame:
    """One copy per trigger minute of the row's range."""
    return rows.withColumn(
        "trigger_min", F.explode(F.sequence("first_trigger", "last_trigger"))
    ).filter(in_calendar(F.col("trigger_min"), calendar))


def second_partials(sided: DataFrame, calendar: Calendar) -> DataFrame:
    """Sum the trades of one second that share a trigger range.

    This shrinks the data before it is fanned out. `bin` stays in the key, so
    the grouping reuses the partitioning the as-of step left behind.
    """
    return (
        with_trigger_range(sided, calendar)
        .withColumn("sec", second_of(F.col("ts_ns")))
        .groupBy("run_date", "stock", "bin", "sec", "side", "first_trigger", "last_trigger")
        .agg(
            F.sum("volume").alias("part_vol"),
            F.sum(F.col("price") * F.col("volume")).alias("part_value"),
            F.max("ts_ns").alias("part_ts"),
        )
        .drop("bin")
    )


def second_rollup(sided: DataFrame, weights: DataFrame, calendar: Calendar) -> DataFrame:
    """Per trigger, second, stock, side and basket quantity: volume, value,
    last time and the number of lots.

    The explicit repartition is the only shuffle from here to the similarity
    join: roll-up, block start and the snapshot masks all group by supersets
    of (run_date, side, sec).
    """
    basket = usable_weights(weights).select("run_date", "stock", "quantity")
    partials = second_partials(sided, calendar).join(basket, ["run_date", "stock"])
    return (
        fan_out(partials.repartition("run_date", "side", "sec"), calendar)
        .groupBy("run_date", "side", "sec", "trigger_min", "stock", "quantity")
        .agg(
            F.sum("part_vol").alias("matched_vol"),
            F.sum("part_value").alias("matched_value"),
            F.max("part_ts").alias("ts_ns"),
        )
        .withColumn("time_str", clock_code(F.col("sec")))
        .withColumn("num_lot", half_even(safe_div(F.col("matched_vol"), F.col("quantity")), 4))
    )


def block_start(rollup: DataFrame, keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """First time of the row's second, per trigger and side. Rows without a
    usable lot count here too."""
    w = W.partitionBy(*keys, "side", "sec", "trigger_min")
    return rollup.withColumn("block_start_ns", F.min("ts_ns").over(w))


def slot_of(rows: DataFrame) -> DataFrame:
    """Trigger position relative to the minute of the row itself."""
    return rows.withColumn("slot", F.col("trigger_min") - int_div(F.col("sec"), 60))
