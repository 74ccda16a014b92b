"""Segments inside a snapshot, and the final selection of detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.functions.scalars import int_div
from basketflow.operators.buckets import assign_buckets
from basketflow.params import MINUTE_NS, NS

OFFSET = 1_000_000
UNSEGMENTED = -1


def segments(
    similar: DataFrame,
    buckets: Column,
    seconds_early: int | str,
    keys: tuple[str, ...] = ("run_date",),
    n_buckets: Column | None = None,
) -> DataFrame:
    """Split every (snapshot, side, bucket) at time gaps and number the parts.

    A gap of exactly `seconds_early` splits. The number is
    `offset + running gap count`; the offset grows by 1,000,000 per bucket,
    empty or not, but an absent buy side takes none.

    All windows nest below (keys, trigger), hence one shuffle, and all but the
    segments' own use one order. A group holds one snapshot: at most one row
    per second, stock, side and quantity. `n_buckets` is the size of the whole
    table where `buckets` holds only the entries of the row's lots.
    """
    early = F.col(seconds_early) if isinstance(seconds_early, str) else F.lit(seconds_early)
    snapshot = [*keys, "trigger_min"]
    # Buckets are assigned before the shuffle, so their table never travels. A
    # lot outside all buckets still proves that its side is present.
    size = F.size(buckets) if n_buckets is None else n_buckets
    assigned = assign_buckets(
        similar.withColumn("n_buckets", size), buckets, keep_unplaced=True
    ).drop("buckets")
    lane = W.partitionBy(*snapshot, "side", "bucket_idx")
    ordered = lane.orderBy("time_str", "stock", "ts_ns", "quantity")
    wait = F.col("ts_ns") - F.lag("ts_ns").over(ordered)
    gap = F.coalesce(wait >= early.cast("bigint") * F.lit(NS), F.lit(False))
    upto_here = ordered.rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        assigned.repartition(*snapshot)
        .withColumn("_gap", gap.cast("bigint"))
        .withColumn("_gaps", F.sum("_gap").over(upto_here))
        .withColumn("has_buy", F.max(F.col("side") == 1).over(W.partitionBy(*snapshot)))
        .filter(F.col("bucket_idx").isNotNull())
    )
    side_rank = F.when((F.col("side") == -1) & F.col("has_buy"), 1).otherwise(0)
    base = (side_rank * F.col("n_buckets") + F.col("bucket_idx")).cast("bigint") * OFFSET
    return placed.withColumn("segment_ids", base + F.col("_gaps")).drop("_gap", "_gaps", "has_buy", "n_buckets")


def segment_stats(segmented: DataFrame, keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """Length and core strength (largest neighbour count) of each segment."""
    w = W.partitionBy(*keys, "trigger_min", "side", "bucket_idx", "segment_ids")
    return segmented.withColumns(
        {
            "segment_length": F.count(F.lit(1)).over(w),
            "core_strength": F.max("no_similarity_stock").over(w),
        }
    )


def long_segments(stats: DataFrame, min_segment: int | str) -> DataFrame:
    need = F.col(min_segment) if isinstance(min_segment, str) else F.lit(min_segment)
    return stats.filter(F.col("segment_length") >= need)


def core_filter(stats: DataFrame, core_threshold: int | str) -> DataFrame:
    """Keep segments with a strong core. A threshold of 0 or less keeps all;
    unsegmented rows always stay."""
    need = F.col(core_threshold) if isinstance(core_threshold, str) else F.lit(core_threshold)
    return stats.filter(
        (need <= 0) | (F.col("segment_ids") == UNSEGMENTED) | (F.col("core_strength") >= need)
    )


def eligible(
    rows: DataFrame,
    live: bool = True,
    hold_back_seconds: int = 45,
    utc_offset_hours: int = 7,
    clock_offset_hours: int = 0,
    keys: tuple[str, ...] = ("run_date",),
) -> DataFrame:
    """Drop rows of the last seconds before the snapshot's cut-off time.

    Live: the trigger's local time, capped at 14:30 local. Otherwise: 14:30 on
    the day of the snapshot's last row, with that row's seconds. `clock_offset_hours` shifts the row's
    clock before it is compared.
    """
    close_ns = (14 * 60 + 30) * MINUTE_NS
    day_ns = 24 * 60 * MINUTE_NS

    def close_of(ts_ns: Column) -> Column:
        return int_div(ts_ns, day_ns) * F.lit(day_ns) + F.lit(close_ns)

    if live:
        now = (F.col("trigger_min") + F.lit(utc_offset_hours * 60)) * F.lit(MINUTE_NS)
        latest = F.least(now, close_of(now))
    else:
        # Only the day of the last row matters, and a snapshot's rows come from
        # one group that is already partitioned by its keys.
        last = F.max("ts_ns").over(W.partitionBy(*keys, "trigger_min"))
        latest = close_of(last) + F.pmod(last, F.lit(MINUTE_NS))
    clock = F.col("ts_ns") + F.lit(clock_offset_hours * 60 * MINUTE_NS)
    return (
        rows.withColumn("_cut", latest - F.lit(hold_back_seconds * NS).cast("bigint"))
        .filter(clock <= F.col("_cut"))
        .drop("_cut")
    )


def shift_time(rows: DataFrame, seconds: int = 45) -> DataFrame:
    """Move `ts_ns` forward and keep the original."""
    return rows.withColumn("initial_ts_ns", F.col("ts_ns")).withColumn(
        "ts_ns", F.col("ts_ns") + F.lit(seconds * NS)
    )


def first_detection(rows: DataFrame, keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """The same second of a stock is found by several snapshots: keep the
    first by trigger, then buys, then bucket. The side is not part of the key.

    `row_number() = 1` is pruned on the map side before the shuffle.
    """
    w = W.partitionBy(*keys, "time_str", "stock", "initial_ts_ns", "ts_ns").orderBy(
        "trigger_min", F.desc("side"), "bucket_idx", "quantity"
    )
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def arbit_unwind(rows: DataFrame) -> DataFrame:
    """Buys count as arbitrage, sells as unwinding."""

    def on(side: int, value: str) -> Column:
        return F.when(F.col("side") == side, F.col(value)).otherwise(F.lit(0.0))

    return rows.withColumns(
        {
            "arbit_ratio": on(1, "num_lot"),
            "unwind_ratio": on(-1, "num_lot"),
            "arbit_value": on(1, "matched_value"),
            "unwind_value": on(-1, "matched_value"),
        }
    )
