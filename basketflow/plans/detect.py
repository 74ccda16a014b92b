"""The detection chain: ticks, quotes and weights in, detections out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketflow.functions.scalars import to_timestamp
from basketflow.operators.buckets import bucket_literal
from basketflow.operators.segments import (
    arbit_unwind,
    core_filter,
    eligible,
    first_detection,
    long_segments,
    segment_stats,
    segments,
    shift_time,
)
from basketflow.operators.similarity import neighbour_counts, similarity_blocks, snapshot_masks
from basketflow.operators.snapshots import block_start, second_rollup
from basketflow.operators.ticks import asof_quotes, basket_only, trade_side
from basketflow.params import Calendar, DetectionParams

# Column order of a stored detection.
RESULT = (
    "time_str",
    "stock",
    "side",
    "quantity",
    "matched_vol",
    "matched_value",
    "ts",
    "num_lot",
    "block_start_time",
    "no_similarity_stock",
    "segment_ids",
    "lot_bucket",
    "segment_length",
    "initial_ts",
    "arbit_ratio",
    "unwind_ratio",
    "arbit_value",
    "unwind_value",
)


def sided_trades(
    trades: DataFrame, quotes: DataFrame, weights: DataFrame, calendar: Calendar
) -> DataFrame:
    """Basket trades with their quote and side."""
    return trade_side(
        asof_quotes(
            basket_only(trades, weights),
            basket_only(quotes, weights),
            max_age_minutes=calendar.lookback_minutes,
            bin_minutes=max(20, calendar.lookback_minutes),
        )
    )


def rollup_rows(
    trades: DataFrame, quotes: DataFrame, weights: DataFrame, calendar: Calendar
) -> DataFrame:
    """Roll-up rows with their block start. Independent of all thresholds."""
    return block_start(
        second_rollup(sided_trades(trades, quotes, weights, calendar), weights, calendar)
    )


def similar_rows(
    trades: DataFrame, quotes: DataFrame, weights: DataFrame, params: DetectionParams
) -> DataFrame:
    masked = snapshot_masks(rollup_rows(trades, quotes, weights, params.calendar))
    counted = neighbour_counts(masked, params.tolerance, params.seconds_gap, params.calendar)
    return similarity_blocks(counted, params.min_unique)


def segment_rows(similar: DataFrame, params: DetectionParams) -> DataFrame:
    """Segments of sufficient length, with their statistics."""
    table = bucket_literal(similar.sparkSession, params.buckets)
    return long_segments(
        segment_stats(segments(similar, table, params.seconds_early)), params.min_segment
    )


def eligible_rows(segmented: DataFrame, params: DetectionParams) -> DataFrame:
    kept = core_filter(segmented, params.core_threshold)
    return shift_time(
        eligible(
            kept,
            live=params.live,
            hold_back_seconds=params.shift_seconds,
            utc_offset_hours=params.calendar.utc_offset_hours,
            clock_offset_hours=params.eligibility_offset_hours,
        ),
        params.shift_seconds,
    )


def detect_flow(
    trades: DataFrame,
    quotes: DataFrame,
    weights: DataFrame,
    params: DetectionParams | None = None,
) -> DataFrame:
    """Detections of all dates and minutes in one job."""
    params = params or DetectionParams()
    similar = similar_rows(trades, quotes, weights, params)
    return arbit_unwind(first_detection(eligible_rows(segment_rows(similar, params), params)))


def result_layout(detections: DataFrame) -> DataFrame:
    """Stored layout: `run_date` plus the 18 result columns."""
    return detections.withColumns(
        {
            "ts": to_timestamp(F.col("ts_ns")),
            "initial_ts": to_timestamp(F.col("initial_ts_ns")),
            "block_start_time": to_timestamp(F.col("block_start_ns")),
            "side": F.col("side").cast("double"),
        }
    ).select("run_date", *RESULT)


def daily_net_flow(detections: DataFrame, *keys: str) -> DataFrame:
    """Arbitrage value minus unwind value per day."""
    return detections.groupBy(*(keys or ("run_date",))).agg(
        (F.sum("arbit_value") - F.sum("unwind_value")).alias("net_flow")
    )
