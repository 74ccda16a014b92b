"""Oracles of the detection queries."""

from oracles.common import (
    ASOF,
    DETECTED,
    MARKET,
    ROLLUP,
    SEGMENTS,
    SIDED,
    SIMILAR,
    SNAPSHOTS,
    bucket_ctes,
    upto,
    CHAIN,
)

DAY = "strftime(run_date, '%Y-%m-%d') AS run_date"


def cents(expr: str, name: str | None = None) -> str:
    return f"round_even(({expr}) * 100, 0) / 100 AS {name or expr}"


BUCKETS = CHAIN[6]

DETECTION_COLUMNS = f"""
SELECT {DAY}, time_str, stock, side, quantity, matched_vol, {cents('matched_value')},
       shifted_ns AS ts_ns, num_lot, block_start_ns, no_similarity_stock, segment_ids, lot_bucket,
       segment_length, initial_ts_ns, arbit_ratio, unwind_ratio, {cents('arbit_value')},
       {cents('unwind_value')}
FROM detected"""

ORACLES = {
    "basket_ticks": upto(
        ASOF,
        f"SELECT {DAY}, stock, ts_ns // 1000 AS ts_us, src_seq, price, volume FROM basket_trades",
    ),
    "asof_quotes": upto(
        ASOF,
        f"SELECT {DAY}, stock, ts_ns, src_seq, price, quote_ts_ns, quote_seq, bid, ask FROM quoted",
    ),
    "csv_ticks": upto(
        ASOF, f"SELECT {DAY}, stock, ts_ns, price, volume, quote_ts_ns, bid, ask FROM quoted"
    ),
    "trade_side": upto(
        SIDED, f"SELECT {DAY}, stock, ts_ns, src_seq, price, bid, ask, side FROM sided"
    ),
    "trigger_fanout": upto(
        SNAPSHOTS, f"SELECT {DAY}, trigger_min, stock, src_seq, ts_ns FROM fanned"
    ),
    "second_rollup": upto(
        ROLLUP,
        f"""SELECT {DAY}, trigger_min, time_str, stock, side, quantity, matched_vol,
                   {cents('matched_value')}, ts_ns, num_lot FROM rollup_rows""",
    ),
    "block_start": upto(
        ROLLUP,
        f"SELECT {DAY}, trigger_min, side, time_str, stock, quantity, block_start_ns FROM blocks",
    ),
    "similarity_count": upto(
        SIMILAR,
        f"""SELECT {DAY}, trigger_min, side, time_str, stock, quantity, num_lot, no_similarity_stock
            FROM alike""",
    ),
    "bucket_assign": upto(
        BUCKETS,
        f"""SELECT {DAY}, trigger_min, side, time_str, stock, num_lot, bucket_idx, lot AS lot_bucket
            FROM alike JOIN buckets ON num_lot BETWEEN lo AND hi""",
    ),
    "segments": upto(
        SEGMENTS,
        f"""SELECT {DAY}, trigger_min, side, bucket_idx, time_str, stock, segment_ids, segment_length,
                   core_strength FROM stats""",
    ),
    "core_filter": upto(
        SEGMENTS,
        f"SELECT {DAY}, trigger_min, time_str, stock, side, segment_ids, core_strength FROM core",
    ),
    "eligibility": upto(
        SEGMENTS,
        f"""SELECT {DAY}, trigger_min, time_str, stock, side, segment_ids, ts_ns FROM core
            WHERE ts_ns + 420 * 60000000000 <= least((trigger_min + 420) * 60000000000,
              (trigger_min + 420) // 1440 * 86400000000000 + 52200000000000) - 45000000000""",
    ),
    "eligibility_closed": upto(
        SEGMENTS,
        f"""SELECT {DAY}, trigger_min, time_str, stock, side, segment_ids, ts_ns
            FROM (SELECT *, max(ts_ns) OVER (PARTITION BY run_date, trigger_min) AS last_ns FROM core)
            WHERE ts_ns + 720 * 60000000000 <= last_ns // 86400000000000 * 86400000000000 + 52200000000000
              + last_ns % 60000000000 - 45000000000""",
    ),
    "result_sink": upto(
        DETECTED,
        f"""SELECT {DAY}, time_str, stock, CAST(side AS DOUBLE) AS side, shifted_ns // 1000 AS ts_us,
                   initial_ts_ns // 1000 AS initial_ts_us, segment_ids, {cents('arbit_value')}, {cents('unwind_value')}
            FROM detected""",
    ),
    "first_detection": upto(
        DETECTED,
        f"""SELECT {DAY}, trigger_min, time_str, stock, side, initial_ts_ns, shifted_ns AS ts_ns
            FROM firsts""",
    ),
    "arbit_unwind": upto(
        DETECTED,
        f"""SELECT {DAY}, time_str, stock, side, initial_ts_ns, arbit_ratio, unwind_ratio,
                   {cents('arbit_value')}, {cents('unwind_value')} FROM detected""",
    ),
    "detect_flow": upto(DETECTED, DETECTION_COLUMNS),
    "daily_net_flow": upto(
        DETECTED,
        f"""SELECT {DAY}, {cents('sum(arbit_value) - sum(unwind_value)', 'net_flow')}
            FROM detected GROUP BY run_date""",
    ),
    "lot_buckets": f"""WITH p AS (
      SELECT s_suppkey AS param_id, 0.02::DOUBLE + (s_suppkey * 37 % 79) / 100.0::DOUBLE AS start,
             CAST(50 + s_suppkey * 17 % 51 AS DOUBLE) AS stop, CAST(20 + s_suppkey * 13 % 41 AS INTEGER) AS num,
             0.25::DOUBLE + (s_suppkey % 6) * 0.05::DOUBLE AS step,
             1.0::DOUBLE + (s_suppkey * 7 % 51) / 100.0::DOUBLE AS growth,
             CAST(3 + s_suppkey % 7 AS DOUBLE) AS int_threshold,
             CASE WHEN s_suppkey % 5 > 0 THEN 0.05::DOUBLE + (s_suppkey * 3 % 10) * 0.05::DOUBLE END
               AS first_center
      FROM supplier), {bucket_ctes('p')}
    SELECT param_id, bucket_idx, lot, lo, hi FROM buckets""",
}

ORACLES["result_csv"] = ORACLES["result_sink"]
