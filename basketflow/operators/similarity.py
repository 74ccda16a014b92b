"""How many stocks trade in a similar multiple of the basket shortly after."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions.scalars import bit, has_bit, int_div
from basketflow.operators.snapshots import slot_of
from basketflow.params import NS, Calendar

# The snapshot bits of a candidate are shifted by whole minutes of the gap.
MOST_GAP_SECONDS = 1800

# What identifies one state of a roll-up row besides the caller's keys.
ROW = (
    "side",
    "sec",
    "time_str",
    "stock",
    "quantity",
    "matched_vol",
    "matched_value",
    "ts_ns",
    "num_lot",
    "block_start_ns",
)


def snapshot_masks(rows: DataFrame, keys: tuple[str, ...] = ("run_date",)) -> DataFrame:
    """Fold the copies of a row back into one row with a bit per snapshot.

    A row looks the same in nearly all of its snapshots, so this undoes the
    fan-out; copies that differ (a partial second on the minute, a quote that
    left the snapshot) stay separate.
    """
    return slot_of(rows).groupBy(*keys, *ROW).agg(F.bit_or(bit(F.col("slot"))).alias("mask"))


def _lot_band(lot: Column, tolerance: Column) -> Column:
    """Logarithmic band wide enough that all lots similar to `lot` lie in its
    own band or a neighbouring one."""
    width = F.when(tolerance < 1.0, -F.ln(F.lit(1.0) - tolerance) * 1.000001 + 1e-9)
    return F.coalesce(
        F.when((lot > 0.0) & width.isNotNull(), F.floor(F.ln(lot) / width)).cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def _similar_pairs(masked: DataFrame, tol: Column, gap: Column, keys: tuple[str, ...]) -> DataFrame:
    """Every row with the rows that are similar to it: `c_stock`, `c_ts`, `c_lot` and the snapshot bits that both share. A row
    without any stays, with no bits.

    Every row probes one (time bin, lot band) cell; as a candidate it is copied to the cells that may need it. A cell holds a
    stock at most once for each second of two bins and copy of the roll-up, so pairs grow with the rows, not with their square;
    they stay in the partition where they arise, whose keys lead the result.
    """
    gap_ns = gap.cast("bigint") * F.lit(NS)
    # The probe and the candidate side must scan the same exchange.
    base = masked.withColumns(
        {
            "gap_ns": gap_ns,
            "lot_lo": F.col("num_lot") * (F.lit(1.0) - tol),
            "lot_hi": F.col("num_lot") * (F.lit(1.0) + tol),
            "band": _lot_band(F.col("num_lot"), tol),
        }
    )
    own_cell = int_div(F.col("ts_ns"), F.col("gap_ns"))
    candidate = (
        base.filter(F.col("num_lot").isNotNull())
        .select(
            *keys,
            "side",
            F.explode(F.array(own_cell, own_cell - 1)).alias("cell"),
            "band",
            F.col("sec").alias("c_sec"),
            F.col("stock").alias("c_stock"),
            F.col("ts_ns").alias("c_ts"),
            F.col("num_lot").alias("c_lot"),
            F.col("mask").alias("c_mask"),
        )
        .withColumn(
            "band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
        )
    )
    # Candidates earlier than the block never match, so the shift is not
    # negative where it matters.
    later = F.greatest(int_div(F.col("c_sec"), 60) - int_div(F.col("sec"), 60), F.lit(0)).cast("int")
    shared = F.col("mask").bitwiseAND(F.call_function("shiftleft", F.col("c_mask"), later))
    cell_keys = cell_keys_of(keys)
    p = base.withColumn("cell", int_div(F.col("block_start_ns"), F.col("gap_ns"))).alias("p")
    on = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in cell_keys]
    on += [
        F.col("c_ts") >= F.col("block_start_ns"),
        F.col("c_ts") <= F.col("block_start_ns") + F.col("gap_ns"),
        F.col("c_lot") >= F.col("lot_lo"),
        F.col("c_lot") <= F.col("lot_hi"),
        shared != 0,
    ]
    return p.join(candidate.alias("c"), on, "left").select(
        *[F.col(f"p.{k}") for k in cell_keys],
        *[c for c in ROW if c != "side"],
        "mask",
        "c_stock",
        "c_ts",
        "c_lot",
        F.coalesce(shared, F.lit(0)).alias("shared"),
    )


def cell_keys_of(keys: tuple[str, ...]) -> list[str]:
    return [*keys, "side", "cell", "band"]


def _checked_gap(seconds_gap: int) -> int:
    if not 0 < seconds_gap <= MOST_GAP_SECONDS:
        raise ValueError(f"seconds_gap must be positive and at most {MOST_GAP_SECONDS}")
    return int(seconds_gap)


def neighbour_counts(
    masked: DataFrame,
    tolerance: float,
    seconds_gap: int,
    calendar: Calendar,
    keys: tuple[str, ...] = ("run_date",),
) -> DataFrame:
    """For every row and snapshot: number of distinct stocks with a row of the
    same side and snapshot, time in [block start, block start + gap] and lots
    in [n(1-tol), n(1+tol)], ends closed, the row itself included.

    The gap is at most half an hour: the snapshot bits reach no further. A
    tolerance of 1 or more puts all lots of a time bin into one cell.
    """
    pairs = _similar_pairs(masked, F.lit(float(tolerance)), F.lit(_checked_gap(seconds_gap)), keys)
    row_cols = [*cell_keys_of(keys), *[c for c in ROW if c != "side"], "mask"]
    per_stock = pairs.groupBy(*row_cols, "c_stock").agg(F.bit_or("shared").alias("shared"))
    slots = range(calendar.lookback_minutes + 1)
    counted = per_stock.groupBy(*row_cols).agg(
        *[F.count_if(has_bit(F.col("shared"), F.lit(k))).alias(f"n{k}") for k in slots]
    )
    return _per_snapshot(counted, [F.col(f"n{k}") for k in slots], *keys, *ROW)


def _per_snapshot(rows: DataFrame, counts: list[Column], *keep: str) -> DataFrame:
    """One row per snapshot of the mask, with the count of its slot."""
    per_slot = F.array(*[F.struct(F.lit(k).alias("k"), n.alias("n")) for k, n in enumerate(counts)])
    return (
        rows.withColumn("at", F.explode(per_slot))
        .filter(has_bit(F.col("mask"), F.col("at.k")))
        .select(
            *keep,
            (int_div(F.col("sec"), 60) + F.col("at.k")).alias("trigger_min"),
            F.col("at.n").cast("bigint").alias("no_similarity_stock"),
        )
    )


#: Pairs of a row and a candidate that are compared at once, and rows of a block that share one pass over the candidates.
MOST_PAIRS = 1 << 20
ROWS_AT_ONCE = 256
#: Steps that a batch of rows holds before it is sent.
MOST_STEPS = 1 << 18

#: The steps of a row, by stock: which stock (a number of the row's own), how long after the block start, lots, shared snapshots.
NEAR = "near struct<stock: array<int>, after_ns: array<bigint>, lot: array<double>, shared: array<bigint>>"


def _deciding(first: np.ndarray, rank: np.ndarray, above_own: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which steps can decide a count, of steps ordered by row, stock and time. `first` marks where a (row, stock) begins,
    `rank` orders the lots, `above_own` tells the side of the row's lots.

    A step is left out if for each of its snapshots an earlier one stands there that is no further off on the same side of
    the row's own lots.
    """
    far = rank.max(initial=0) + 1
    # Each (row, stock) lies below all before it, so a running minimum starts anew.
    base = np.cumsum(first) * -(far + 1)
    keep = np.zeros(len(rank), bool)
    used = int(np.bitwise_or.reduce(shared)) if len(shared) else 0
    for above in (True, False):
        side = above_own if above else ~above_own
        off = rank if above else far - 1 - rank
        for k in range(used.bit_length()):
            if used >> k & 1:
                member = side & ((shared >> k & 1) == 1)
                least = np.where(member, off, far) + base
                before = np.minimum.accumulate(least)
                keep |= member & (least < np.concatenate([[1], before[:-1]]))
    return keep


def _stairs(rows: pa.RecordBatch, tol: float, gap_ns: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Rows of one cell whose turn it is, each with its steps: their numbers, then lengths, stocks, times, lots and snapshots."""
    def longs(name: str) -> np.ndarray:
        return rows.column(name).fill_null(0).to_numpy(zero_copy_only=False)

    ts, block, mask, minute = longs("ts_ns"), longs("block_start_ns"), longs("mask"), longs("sec") // 60
    lot = rows.column("num_lot").cast(pa.float64()).to_numpy(zero_copy_only=False)
    stock = rows.column("stock").dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    known = rows.column("num_lot").is_valid().to_numpy(zero_copy_only=False)
    usable = known & rows.column("in_cell").to_numpy(zero_copy_only=False)
    others = np.flatnonzero(usable)
    others = others[np.lexsort((ts[others], stock[others]))]
    lo, hi = lot * (1.0 - tol), lot * (1.0 + tol)
    asks = np.flatnonzero(rows.column("asks").to_numpy(zero_copy_only=False))
    asks = asks[np.lexsort((lot[asks], block[asks]))]
    for block_rows in np.split(asks, np.flatnonzero(np.diff(block[asks])) + 1):
        if not len(block_rows):
            continue
        start = block[block_rows[0]]
        later = others[(ts[others] >= start) & (ts[others] <= start + gap_ns)]
        at = 0
        while at < len(block_rows):
            p = block_rows[at : at + max(1, min(ROWS_AT_ONCE, MOST_PAIRS // max(len(later), 1)))]
            at += len(p)
            # NaN lots equal each other and no other, as in SQL.
            c = later[((lot[later] >= np.fmin.reduce(lo[p])) & (lot[later] <= np.fmax.reduce(hi[p]))) | np.isnan(lot[later])]
            near = (lot[c] >= lo[p][:, None]) & (lot[c] <= hi[p][:, None])
            near |= np.isnan(lot[c]) & (np.isnan(lot[p]) & known[p])[:, None]
            rank = np.unique(lot[c], return_inverse=True)[1].astype(np.int64)
            i, j = np.nonzero(near)
            rank, j = rank[j], c[j]
            shared = mask[p[i]] & (mask[j] << np.maximum(minute[j] - minute[p[i]], 0))
            seen = shared != 0
            i, j, shared, rank = i[seen], j[seen], shared[seen], rank[seen]
            first = np.ones(len(i), bool)
            first[1:] = (i[1:] != i[:-1]) | (stock[j[1:]] != stock[j[:-1]])
            keep = _deciding(first, rank, lot[j] >= lot[p[i]], shared)
            i, j, shared = i[keep], j[keep], shared[keep]
            yield p, [np.bincount(i, minlength=len(p)), stock[j], ts[j] - start, lot[j], shared]


def neighbour_stairs(
    masked: DataFrame,
    most_tolerance: float,
    most_gap: int,
    keys: tuple[str, ...] = ("run_date",),
) -> DataFrame:
    """Every row with `near`: for each stock with a similar row the steps
    (after_ns, lot, shared) that can decide a count for any smaller tolerance
    and gap.

    Rows meet in cells of (keys, side, time bin); a row is sent to the bin it asks in and, as a candidate, to its own bin and
    the one before. Pairs are compared a block of one second at a time and only their deciding steps leave the task. One such
    pass serves all parameter sets, whatever their number.
    """
    tol, gap_ns = float(most_tolerance), _checked_gap(most_gap) * NS
    own, asked = int_div(F.col("ts_ns"), gap_ns), int_div(F.col("block_start_ns"), gap_ns)
    whole = F.lit(True)
    for c in [*keys, "side"]:
        whole = whole & F.col(c).isNotNull()
    cells = (
        masked.select(*keys, *ROW, "mask")
        .withColumn("cell", F.explode(F.array_distinct(F.array(asked, own, own - 1))))
        .withColumn("asks", F.col("cell").eqNullSafe(asked))
        # As a candidate a row without a time, or in a cell that no equal keys can share, counts for none.
        .withColumn("in_cell", F.coalesce(whole & ((F.col("cell") == own) | (F.col("cell") == own - 1)), F.lit(False)))
        .filter("asks OR in_cell")
    )
    kept = [*keys, *ROW, "mask"]

    def with_near(rows: pa.RecordBatch, parts: list) -> pa.RecordBatch:
        sizes, *steps = [np.concatenate(x) for x in zip(*[steps for _, steps in parts])]
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        types = (pa.int32(), pa.int64(), pa.float64(), pa.int64())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in zip(steps, types)]
        near = pa.StructArray.from_arrays(lists, ["stock", "after_ns", "lot", "shared"])
        own_rows = rows.select(kept).take(pa.array(np.concatenate([p for p, _ in parts])))
        return pa.RecordBatch.from_arrays([*own_rows.columns, near], [*kept, "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        for batch in rows.to_batches():
            parts, held = [], 0
            for part in _stairs(batch, tol, gap_ns):
                parts.append(part)
                held += len(part[1][1])
                if held >= MOST_STEPS:
                    yield with_near(batch, parts)
                    parts, held = [], 0
            if parts:
                yield with_near(batch, parts)

    schema = masked.select(*kept).withColumn("near", F.lit(None).cast(NEAR.split(" ", 1)[1])).schema
    return cells.groupBy(*keys, "side", "cell").applyInArrow(run, schema)


def _count_udf(n_slots: int):
    """Counts per slot of rows with `near`: the stocks with a step within the row's tolerance and gap that shares the slot."""

    @F.arrow_udf("array<bigint>")
    def counts(stock: pa.Array, after: pa.Array, lot: pa.Array, shared: pa.Array, own: pa.Array, tolerance: pa.Array, gap: pa.Array) -> pa.Array:
        def numbers(a: pa.Array, kind) -> np.ndarray:
            return a.cast(kind).to_numpy(zero_copy_only=False)

        n = len(stock)
        row = np.repeat(np.arange(n), stock.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        which, bits, at = stock.flatten().to_numpy(), shared.flatten().to_numpy(), lot.flatten().to_numpy()
        lots, tol = numbers(own, pa.float64()), numbers(tolerance, pa.float64())
        # A missing tolerance or gap meets nothing.
        known = tolerance.is_valid().to_numpy(zero_copy_only=False) & gap.is_valid().to_numpy(zero_copy_only=False)
        gap_ns = gap.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) * NS
        lo, hi = lots * (1.0 - tol), lots * (1.0 + tol)
        met = known[row] & (after.flatten().to_numpy() <= gap_ns[row])
        met &= ((at >= lo[row]) & (at <= hi[row])) | (np.isnan(at) & np.isnan(lots)[row])
        out = np.zeros((n, n_slots), np.int64)
        row, which, bits = row[met], which[met], bits[met]
        if len(row):
            starts = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (which[1:] != which[:-1])]))
            per_stock, row = np.bitwise_or.reduceat(bits, starts), row[starts]
            for k in range(n_slots):
                out[:, k] = np.bincount(row[(per_stock >> k & 1) == 1], minlength=n)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * n_slots, pa.int32()), pa.array(out.ravel()))

    return counts


def counts_within(
    rows: DataFrame,
    tolerance: Column,
    seconds_gap: Column,
    calendar: Calendar,
    *keep: str,
    before_fan_out: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """`neighbour_counts` of rows with `near`, for a tolerance and gap of each row's own: a lookup, without a shuffle.

    `before_fan_out` gets the rows with their `counts`, one a slot, and their largest as `no_similarity_stock`: what does not
    depend on the snapshot is cheaper there.
    """
    n_slots = calendar.lookback_minutes + 1
    near = [F.col(f"near.{c}") for c in ("stock", "after_ns", "lot", "shared")]
    counted = rows.withColumn("counts", _count_udf(n_slots)(*near, F.col("num_lot"), tolerance, seconds_gap)).drop("near")
    if before_fan_out is not None:
        counted = before_fan_out(counted.withColumn("no_similarity_stock", F.array_max("counts")))
    return _per_snapshot(counted, [F.element_at("counts", k + 1) for k in range(n_slots)], *keep, *ROW)


def similarity_blocks(counted: DataFrame, min_unique: int | str) -> DataFrame:
    """Rows with enough similar stocks."""
    threshold = F.col(min_unique) if isinstance(min_unique, str) else F.lit(min_unique)
    return counted.filter(F.col("no_similarity_stock") >= threshold)
