"""The lot-bucket table and the assignment of lots to buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions.scalars import clip, half_even
from basketflow.params import BucketParams

EPS = 1e-9
COLUMNS = ("start", "stop", "num", "step", "growth", "int_threshold", "first_center")


def _let(value: Column, body) -> Column:
    """`body(value)` with `value` computed once. Referring to an array column
    several times would paste its whole expression each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _previous(lots: Column, i: Column) -> Column:
    return F.element_at(lots, F.greatest(i, F.lit(1)))


def _ascending(lots: Column) -> Column:
    """Drop every lot that does not exceed its predecessor."""
    return F.filter(lots, lambda x, i: (i == 0) | (x > _previous(lots, i) + EPS))


def _replace_last(lots: Column, last: Column) -> Column:
    return F.concat(F.slice(lots, 1, F.size(lots) - 1), F.array(last))


def lot_buckets(decimals: int = 3) -> Column:
    """Array of (bucket_idx, lot, lo, hi) from the parameter columns `COLUMNS`.

    Each parameter set is one row and its table an array of at most `num` + 2
    entries, so any number of sets is built in one pass without a shuffle.
    """
    start, stop, num, step, growth, int_threshold, first_center = (
        F.col(c).cast("int" if c == "num" else "double") for c in COLUMNS
    )
    start_r, stop_r = half_even(start, decimals), half_even(stop, decimals)
    span = F.ln(stop) - F.ln(start)
    centre = F.greatest(first_center, start)

    def point(i: Column) -> Column:
        raw = F.exp(F.ln(start) + span * F.pow(i / (num - 1), growth))
        return clip(F.rint(raw / step) * step, start, stop)

    def snap(lots: Column) -> Column:
        return F.transform(lots, lambda x: F.when(x >= int_threshold, F.rint(x)).otherwise(x))

    def close(lots: Column) -> Column:
        open_end = F.element_at(lots, -1) < stop - EPS
        return F.when(open_end, F.concat(lots, F.array(stop))).otherwise(lots)

    def replace_head(lots: Column) -> Column:
        """The first centre takes the place of every lot up to it."""
        tail = F.filter(lots, lambda x: x > centre + EPS)
        return F.when(first_center.isNull(), lots).otherwise(F.concat(F.array(centre), tail))

    def rounded(lots: Column) -> Column:
        return F.transform(lots, lambda x: half_even(x, decimals))

    def end_at_stop(lots: Column) -> Column:
        return _replace_last(lots, stop_r)

    def bounds(lots: Column) -> Column:
        n = F.size(lots)

        def midpoint(a: Column, b: Column) -> Column:
            return half_even((a + b) / 2, decimals)

        table = F.transform(
            lots,
            lambda x, i: F.struct(
                i.cast("int").alias("bucket_idx"),
                x.alias("lot"),
                F.when(i == 0, start_r).otherwise(midpoint(_previous(lots, i), x)).alias("lo"),
                F.when(i == n - 1, stop_r)
                .otherwise(midpoint(x, F.element_at(lots, F.least(i + 2, n))))
                .alias("hi"),
            ),
        )
        problem = F.raise_error(F.lit("a lot-bucket table needs at least two lots"))
        return F.when(n > 1, table).otherwise(problem)

    lots = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), num - 1), point)))
    for stage in (
        end_at_stop,
        snap,
        _ascending,
        close,
        replace_head,
        rounded,
        end_at_stop,
        _ascending,
        bounds,
    ):
        lots = _let(lots, stage)
    return lots


def with_lot_buckets(params: DataFrame, decimals: int = 3) -> DataFrame:
    """Add the bucket table of each parameter row as column `buckets`."""
    return params.withColumn("buckets", lot_buckets(decimals))


def bucket_row(spark, buckets: BucketParams) -> DataFrame:
    """One parameter set as a row for `with_lot_buckets`."""
    schema = (
        "start double, stop double, num int, step double, growth double, "
        "int_threshold double, first_center double"
    )
    row = tuple(
        None if v is None else (int(v) if c == "num" else float(v))
        for c, v in ((c, getattr(buckets, c)) for c in COLUMNS)
    )
    return spark.createDataFrame([row], schema)


def bucket_literal(spark, buckets: BucketParams) -> Column:
    """The table of one parameter set as a constant array. At most `num` + 2
    entries come to the driver."""
    rows = with_lot_buckets(bucket_row(spark, buckets)).select("buckets").first()[0]
    return F.array(
        *[
            F.struct(
                F.lit(r.bucket_idx).alias("bucket_idx"),
                F.lit(r.lot).alias("lot"),
                F.lit(r.lo).alias("lo"),
                F.lit(r.hi).alias("hi"),
            )
            for r in rows
        ]
    )


def bucket_table(params: DataFrame, *keep: str) -> DataFrame:
    """The bucket tables as rows: kept columns, bucket_idx, lot, lo, hi."""
    return with_lot_buckets(params).select(*keep, F.inline("buckets"))


def buckets_of_lot(buckets: Column) -> Column:
    """The entries that hold the row's lots. Ends are closed and shared, so a lot on an edge falls into two."""
    lot = F.col("num_lot")
    return F.filter(buckets, lambda b: (lot >= b["lo"]) & (lot <= b["hi"]))


def assign_buckets(rows: DataFrame, buckets: Column, keep_unplaced: bool = False) -> DataFrame:
    """One copy per bucket holding the row's lots. Ends are closed and shared,
    so a lot on an edge falls into two buckets. A lot outside all buckets is
    dropped, or kept without a bucket."""
    hits = buckets_of_lot(buckets)
    explode = F.explode_outer if keep_unplaced else F.explode
    return (
        rows.withColumn("_b", explode(hits))
        .withColumn("bucket_idx", F.col("_b.bucket_idx"))
        .withColumn("lot_bucket", F.col("_b.lot"))
        .drop("_b")
    )
