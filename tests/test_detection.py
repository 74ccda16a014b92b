"""Edge rows of the detection, by hand and against brute force."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from basketflow.operators import buckets as bk
from basketflow.operators import segments as sg
from basketflow.operators import similarity as sm
from basketflow.operators import snapshots as sn
from basketflow.operators import ticks as tk
from basketflow.params import MINUTE_NS, NS, BucketParams, Calendar

D = date(2024, 1, 1)
T0 = 1_704_074_400 * NS  # 02:00 UTC, 09:00 local
TRADE = "run_date date, stock string, ts_ns bigint, src_seq bigint, price double, volume double"
QUOTE = "run_date date, stock string, ts_ns bigint, src_seq bigint, bid double, ask double"
WEIGHT = "run_date date, stock string, quantity double, weight double"


def asof(spark, trades, quotes, **kw):
    t = spark.createDataFrame([(D, *r) for r in trades], TRADE)
    q = spark.createDataFrame([(D, *r) for r in quotes], QUOTE)
    return tk.asof_quotes(t, q, **kw)


def test_asof_ties_age_and_missing(spark):
    rows = asof(
        spark,
        [("A", T0, 9, 1.0, 1.0), ("A", T0 + 6 * MINUTE_NS, 10, 1.0, 1.0), ("B", T0, 11, 1.0, 1.0)],
        [("A", T0, 1, 1.0, 2.0), ("A", T0, 2, None, 3.0), ("A", T0 + 1, 3, 5.0, 6.0)],
    ).orderBy("src_seq").collect()
    # Equal time counts, the later of two equal quotes wins, NULLs included.
    assert (rows[0].quote_seq, rows[0].bid, rows[0].ask) == (2, None, 3.0)
    assert rows[1].quote_ts_ns is None  # older than five minutes
    assert rows[2].quote_ts_ns is None  # no quote at all


def test_asof_matches_brute_force_across_bins(spark):
    rnd = random.Random(7)
    quotes = [("AB"[i % 2], T0 + rnd.randrange(60 * MINUTE_NS), i, float(i), i + 1.0) for i in range(60)]
    trades = [("AB"[i % 2], T0 + rnd.randrange(60 * MINUTE_NS), i, 1.0, 1.0) for i in range(300)]
    got = {r.src_seq: r.quote_seq for r in asof(spark, trades, quotes, bin_minutes=5).collect()}
    for stock, ts, seq, *_ in trades:
        past = [q for q in quotes if q[0] == stock and ts - 5 * MINUTE_NS <= q[1] <= ts]
        assert got[seq] == (max(past, key=lambda q: (q[1], q[2]))[2] if past else None)


def test_sides(spark):
    df = spark.createDataFrame(
        [(1, 5.0, 6.0, 4.0), (2, 5.0, 4.0, 6.0), (3, 6.0, 4.0, 6.0), (4, 4.0, 4.0, 6.0), (5, 7.0, None, 6.0)],
        "id int, price double, bid double, ask double",
    )
    # Crossed quote sells; between the quotes there is no side.
    assert {r.id: r.side for r in tk.trade_side(df).collect()} == {1: -1, 3: 1, 4: -1, 5: 1}


def test_trade_on_the_minute_has_six_triggers(spark):
    cal = Calendar()
    df = spark.createDataFrame(
        [(1, T0 + 10 * MINUTE_NS, T0 + 10 * MINUTE_NS), (2, T0 + 10 * MINUTE_NS + 1, T0 + 10 * MINUTE_NS),
         (3, T0 + 10 * MINUTE_NS + 1, T0 + 9 * MINUTE_NS - 1)],
        "id int, ts_ns bigint, quote_ts_ns bigint",
    )
    counts = {r.id: r["count"] for r in sn.fan_out(sn.with_trigger_range(df, cal), cal).groupBy("id").count().collect()}
    assert counts == {1: 6, 2: 5, 3: 3}  # the old quote leaves two snapshots early


def test_lunch_hour_has_no_triggers(spark):
    noon = (T0 + 3 * 60 * MINUTE_NS) // MINUTE_NS
    df = spark.createDataFrame([(noon - 1,), (noon,), (noon + 60,)], "m bigint")
    assert [r.ok for r in df.select(tk.in_calendar(F.col("m"), Calendar()).alias("ok")).collect()] == [True, False, True]


def test_zero_quantity_gives_null_lots(spark):
    t = [("A", T0 + NS, 2, 9.0, 100.0), ("A", T0 + NS + 5, 3, 9.0, 50.0)]
    sided = tk.trade_side(asof(spark, t, [("A", T0, 1, 5.0, 6.0)]))
    w = spark.createDataFrame([(D, "A", 0.0, 1.0), (D, "A", None, 1.0)], WEIGHT)
    rows = sn.second_rollup(sided, w, Calendar()).collect()
    assert len(rows) == 5
    assert all(r.num_lot is None and r.matched_vol == 150.0 and r.ts_ns == T0 + NS + 5 for r in rows)


def blocks(spark, n, seed, span=400):
    rnd = random.Random(seed)
    rows, seen = [], set()
    for _ in range(n):
        sec, stock, side = rnd.randrange(span), f"S{rnd.randrange(12)}", rnd.choice([1, -1])
        if (sec, stock, side) in seen:
            continue
        seen.add((sec, stock, side))
        ts = T0 + sec * NS + rnd.randrange(NS) * (rnd.random() > 0.1)
        first = -(-ts // MINUTE_NS)
        last = ts // MINUTE_NS + 5 - rnd.choice([0, 0, 0, 1, 2])
        lot = rnd.choice([0.0, None, 0.1, 0.136, 0.2, 1.0, 1.3633, 2.0, rnd.random() * 5])
        for t in range(first, last + 1):
            rows.append((D, t, side, T0 // NS + sec, 0, stock, 100.0, 1.0, 1.0, ts, lot))
    schema = (
        "run_date date, trigger_min bigint, side int, sec bigint, time_str int, stock string, "
        "quantity double, matched_vol double, matched_value double, ts_ns bigint, num_lot double"
    )
    return sn.block_start(spark.createDataFrame(rows, schema))


@pytest.mark.parametrize("tolerance,gap", [(0.3633, 45), (0.05, 70), (1.2, 10)])
def test_neighbour_counts_match_brute_force(spark, tolerance, gap):
    df = blocks(spark, 500, gap)
    rows = df.collect()
    counted = sm.neighbour_counts(sm.snapshot_masks(df), tolerance, gap, Calendar()).collect()
    got = {(r.trigger_min, r.side, r.sec, r.stock): r.no_similarity_stock for r in counted}
    assert len(got) == len(rows) == len(counted)
    groups = {}
    for r in rows:
        groups.setdefault((r.trigger_min, r.side), []).append(r)
    for r in rows:
        lo, hi = (r.num_lot or 0) * (1.0 - tolerance), (r.num_lot or 0) * (1.0 + tolerance)
        want = {
            o.stock
            for o in groups[r.trigger_min, r.side]
            if r.num_lot is not None
            and o.num_lot is not None
            and r.block_start_ns <= o.ts_ns <= r.block_start_ns + gap * NS
            and lo <= o.num_lot <= hi
        }
        assert got[r.trigger_min, r.side, r.sec, r.stock] == len(want)


def test_bucket_table_and_shared_edge(spark):
    table = bk.with_lot_buckets(bk.bucket_row(spark, BucketParams())).first().buckets
    lots = [b.lot for b in table]
    assert lots == sorted(set(lots)) and lots[0] == 0.25 and lots[-1] == 100.0
    assert table[0].lo == 0.02 and table[-1].hi == 100.0
    assert all(a.hi == b.lo for a, b in zip(table, table[1:]))
    rows = spark.createDataFrame([(table[0].hi,), (table[0].lo,), (1000.0,)], "num_lot double")
    hits = bk.assign_buckets(rows, bk.bucket_literal(spark, BucketParams())).collect()
    assert sorted((r.num_lot, r.bucket_idx) for r in hits) == sorted(
        [(table[0].hi, 0), (table[0].hi, 1), (table[0].lo, 0)]
    )
    for bad in ({"start": 0}, {"stop": 0.01}, {"num": 1}, {"growth": 0}):
        with pytest.raises(ValueError):
            BucketParams(**bad)


def similar(spark, rows):
    schema = (
        "run_date date, trigger_min bigint, side int, time_str int, stock string, quantity double, "
        "ts_ns bigint, num_lot double, no_similarity_stock bigint"
    )
    return spark.createDataFrame([(D, *r) for r in rows], schema)


def lanes(*edges):
    return F.array(
        *[
            F.struct(F.lit(i).alias("bucket_idx"), F.lit(lo).alias("lot"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"))
            for i, (lo, hi) in enumerate(edges)
        ]
    )


def test_segment_ids(spark):
    rows = [
        (1, 1, 1, "A", 1.0, 0, 0.5, 5),
        (1, 1, 2, "A", 1.0, 16 * NS, 0.5, 5),  # a gap of exactly 16 s splits
        (1, 1, 3, "A", 1.0, 32 * NS - 1, 0.5, 5),
        (1, -1, 1, "B", 1.0, 0, 1.5, 5),
        (2, -1, 1, "B", 1.0, 0, 1.5, 5),  # no buys in this snapshot
        (3, 1, 1, "C", 1.0, 0, 99.0, 5),  # a buy outside all buckets
        (3, -1, 1, "B", 1.0, 0, 0.5, 5),
    ]
    out = sg.segments(similar(spark, rows), lanes((0.0, 1.0), (1.1, 2.0)), 16).collect()
    got = sorted((r.trigger_min, r.side, r.ts_ns, r.segment_ids) for r in out)
    assert got == [
        (1, -1, 0, 3_000_000),
        (1, 1, 0, 0),
        (1, 1, 16 * NS, 1),
        (1, 1, 32 * NS - 1, 1),
        (2, -1, 0, 1_000_000),
        (3, -1, 0, 2_000_000),
    ]


def test_core_filter(spark):
    df = spark.createDataFrame([(1, 3), (2, 9), (-1, 0)], "segment_ids bigint, core_strength bigint")
    ids = lambda t: sorted(r.segment_ids for r in sg.core_filter(df, t).collect())
    assert ids(8) == [-1, 2] and ids(0) == [-1, 1, 2]


def test_first_detection_ignores_side(spark):
    schema = "run_date date, trigger_min bigint, side int, time_str int, stock string, quantity double, ts_ns bigint, initial_ts_ns bigint, bucket_idx int"
    df = spark.createDataFrame(
        [(D, 2, 1, 1, "A", 1.0, 5, 5, 0), (D, 1, -1, 1, "A", 1.0, 5, 5, 0), (D, 1, 1, 1, "A", 1.0, 5, 5, 1)], schema
    )
    (row,) = sg.first_detection(df).collect()
    assert (row.trigger_min, row.side) == (1, 1)


def test_eligibility_clock(spark):
    last = T0 // MINUTE_NS + 5
    df = spark.createDataFrame(
        [(D, last, T0), (D, last, last * MINUTE_NS - 45 * NS), (D, last, last * MINUTE_NS - 44 * NS)],
        "run_date date, trigger_min bigint, ts_ns bigint",
    )
    assert sg.eligible(df).count() == 3  # UTC against local time
    assert sg.eligible(df, clock_offset_hours=7).count() == 2
    assert sg.eligible(df, live=False).count() == 3


def test_closed_day_keeps_the_last_rows_seconds(spark):
    at = (14 * 60 + 29) * 60 * 10**9
    rows = spark.createDataFrame([(date(1970, 1, 1), 900, at + s * 10**9) for s in (20, 30)], "run_date date, trigger_min long, ts_ns long")
    assert sg.eligible(rows, live=False, hold_back_seconds=45).count() == 2
    assert sg.eligible(rows, live=False, hold_back_seconds=65).count() == 1
