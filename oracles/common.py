"""Shared pieces: the fixture adapters of `basketflow.fixtures` in SQL, and the
detection steps written the long way (explicit snapshots, plain joins)."""

from __future__ import annotations

MARKET = """
ev AS (
  SELECT event_id AS src_seq, user_id % 40 AS stock_no,
         'S' || lpad(CAST(user_id % 40 AS VARCHAR), 2, '0') AS stock, event_type, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10 AS volume,
         (epoch_us(ts) - 1704067200000000) // 864000000000 AS d,
         (epoch_us(ts) - 1704067200000000) % 864000000000 AS r
  FROM events),
clocked AS (
  SELECT *, DATE '2024-01-01' + CAST(d AS INTEGER) AS run_date,
         (1704067200000000 + d * 86400000000 + 7200000000 + r // 300) * 1000 AS ts_ns
  FROM ev),
trades AS (
  SELECT run_date, stock, ts_ns, src_seq, value AS price, volume FROM clocked
  WHERE event_type IN ('click', 'purchase', 'error')),
quotes AS (
  SELECT run_date, stock, ts_ns, src_seq, value * 0.999::DOUBLE AS bid, value * 1.001::DOUBLE AS ask
  FROM clocked WHERE event_type IN ('view', 'signup')),
basket AS (
  SELECT DISTINCT run_date, stock, 100.0::DOUBLE * (1 + stock_no % 20) AS quantity
  FROM clocked WHERE stock_no NOT IN (38, 39))"""

ASOF = """
basket_trades AS (SELECT t.* FROM trades t SEMI JOIN basket b USING (run_date, stock)),
basket_quotes AS (
  SELECT q.* FROM quotes q SEMI JOIN basket b USING (run_date, stock)
  QUALIFY row_number() OVER (PARTITION BY run_date, stock, ts_ns ORDER BY src_seq DESC) = 1),
asof_all AS (
  SELECT t.run_date, t.stock, t.ts_ns, t.src_seq, t.price, t.volume,
         q.ts_ns AS q_ts, q.src_seq AS q_seq, q.bid AS q_bid, q.ask AS q_ask
  FROM basket_trades t ASOF LEFT JOIN basket_quotes q
    ON t.run_date = q.run_date AND t.stock = q.stock AND t.ts_ns >= q.ts_ns),
quoted AS (
  SELECT run_date, stock, ts_ns, src_seq, price, volume,
         CASE WHEN q_ts >= ts_ns - 300000000000 THEN q_ts END AS quote_ts_ns,
         CASE WHEN q_ts >= ts_ns - 300000000000 THEN q_seq END AS quote_seq,
         CASE WHEN q_ts >= ts_ns - 300000000000 THEN q_bid END AS bid,
         CASE WHEN q_ts >= ts_ns - 300000000000 THEN q_ask END AS ask
  FROM asof_all)"""

SIDED = """
sided AS (
  SELECT * FROM (
    SELECT *, CASE WHEN price <= bid THEN -1 WHEN price >= ask THEN 1 END AS side FROM quoted)
  WHERE side IS NOT NULL)"""

# Every trigger minute of the calendar, with its own snapshot of the trades.
# A trade whose quote is older than the snapshot has no side there.
SNAPSHOTS = """
minutes AS (
  SELECT run_date, epoch_ns(CAST(run_date AS TIMESTAMP)) // 60000000000 + m AS trigger_min
  FROM (SELECT DISTINCT run_date FROM trades), range(0, 1440) g(m)
  WHERE (m + 7 * 60) % 1440 // 60 IN (9, 10, 11, 13, 14)),
fanned AS (
  SELECT s.*, m.trigger_min FROM sided s JOIN minutes m
    ON s.run_date = m.run_date AND s.ts_ns <= m.trigger_min * 60000000000
   AND s.ts_ns >= (m.trigger_min - 5) * 60000000000
   AND s.quote_ts_ns >= (m.trigger_min - 5) * 60000000000)"""

ROLLUP = """
rolled AS (
  SELECT f.run_date, trigger_min, ts_ns // 1000000000 AS sec, f.stock, side, quantity,
         sum(volume) AS matched_vol, sum(price * volume) AS matched_value, max(ts_ns) AS last_ns
  FROM fanned f JOIN basket b ON f.run_date = b.run_date AND f.stock = b.stock
  GROUP BY ALL),
rollup_rows AS (
  SELECT run_date, trigger_min, sec,
         CAST(10000000 + sec % 86400 // 3600 * 10000 + sec % 3600 // 60 * 100 + sec % 60 AS INTEGER)
           AS time_str,
         stock, side, quantity, matched_vol, matched_value, last_ns AS ts_ns,
         round_even(matched_vol / quantity * 10000, 0) / 10000 AS num_lot
  FROM rolled),
blocks AS (
  SELECT *, min(ts_ns) OVER (PARTITION BY run_date, trigger_min, side, sec) AS block_start_ns
  FROM rollup_rows)"""

SIMILAR = """
counted AS (
  SELECT a.*, n.no_similarity_stock FROM blocks a JOIN (
    SELECT i.run_date, i.trigger_min, i.side, i.sec, i.stock, i.quantity,
           count(DISTINCT j.stock) AS no_similarity_stock
    FROM blocks i JOIN blocks j
      ON i.run_date = j.run_date AND i.trigger_min = j.trigger_min AND i.side = j.side
     AND j.ts_ns BETWEEN i.block_start_ns AND i.block_start_ns + 45000000000
     AND j.num_lot >= i.num_lot * (1.0::DOUBLE - 0.3633::DOUBLE)
     AND j.num_lot <= i.num_lot * (1.0::DOUBLE + 0.3633::DOUBLE)
    GROUP BY ALL) n
  USING (run_date, trigger_min, side, sec, stock, quantity)),
alike AS (SELECT * FROM counted WHERE no_similarity_stock >= 3)"""


def bucket_ctes(source: str, prefix: str = "") -> str:
    """Bucket tables of the parameter rows in `source` (param_id, start, stop,
    num, step, growth, int_threshold, first_center), with window functions."""
    p = prefix
    return f"""
{p}pts AS (
  SELECT DISTINCT param_id, start, stop, int_threshold, first_center,
         least(greatest(round_even(exp(ln(start) + (ln(stop) - ln(start))
           * pow(i::DOUBLE / (num - 1), growth)) / step, 0) * step, start), stop) AS v
  FROM {source}, LATERAL (SELECT unnest(range(0, num)) AS i)),
{p}snapped AS (
  SELECT *, CASE WHEN v1 >= int_threshold THEN round_even(v1, 0) ELSE v1 END AS v2 FROM (
    SELECT *, CASE WHEN lead(v) OVER w IS NULL THEN round_even(stop * 1000, 0) / 1000 ELSE v END AS v1,
           lead(v) OVER w IS NULL AS is_last
    FROM {p}pts WINDOW w AS (PARTITION BY param_id ORDER BY v))),
{p}kept AS (
  SELECT * FROM {p}snapped
  QUALIFY coalesce(v2 > lag(v2) OVER (PARTITION BY param_id ORDER BY v) + 1e-9, true)),
{p}closed AS (
  SELECT param_id, start, stop, first_center, v2 AS x FROM {p}kept
  UNION ALL
  SELECT param_id, start, stop, first_center, stop FROM {p}snapped
  WHERE is_last AND v2 < stop - 1e-9),
{p}centred AS (
  SELECT param_id, start, stop, x FROM {p}closed
  WHERE first_center IS NULL OR x > greatest(first_center, start) + 1e-9
  UNION ALL
  SELECT DISTINCT param_id, start, stop, greatest(first_center, start) FROM {p}closed
  WHERE first_center IS NOT NULL),
{p}rounded AS (
  SELECT param_id, start, stop,
         CASE WHEN lead(x) OVER w IS NULL THEN round_even(stop * 1000, 0) / 1000
              ELSE round_even(x * 1000, 0) / 1000 END AS x,
         row_number() OVER w AS rn
  FROM {p}centred WINDOW w AS (PARTITION BY param_id ORDER BY x)),
{p}lots AS (
  SELECT param_id, start, stop, x, rn FROM {p}rounded
  QUALIFY coalesce(x > lag(x) OVER (PARTITION BY param_id ORDER BY rn) + 1e-9, true)),
{p}buckets AS (
  SELECT param_id, CAST(row_number() OVER w - 1 AS INTEGER) AS bucket_idx, x AS lot,
         coalesce(round_even((lag(x) OVER w + x) / 2 * 1000, 0) / 1000,
                  round_even(start * 1000, 0) / 1000) AS lo,
         coalesce(round_even((x + lead(x) OVER w) / 2 * 1000, 0) / 1000,
                  round_even(stop * 1000, 0) / 1000) AS hi
  FROM {p}lots WINDOW w AS (PARTITION BY param_id ORDER BY rn))"""


DEFAULT_PARAMS = """
bucket_params AS (
  SELECT 0 AS param_id, 0.02::DOUBLE AS start, 100.0::DOUBLE AS stop, 22 AS num, 0.2::DOUBLE AS step,
         1.1167::DOUBLE AS growth, 7.0::DOUBLE AS int_threshold, 0.25::DOUBLE AS first_center)"""

SEGMENTS = """
placed AS (
  SELECT s.*, b.bucket_idx, b.lot AS lot_bucket,
         CASE WHEN s.side = -1 AND f.has_buy THEN (SELECT count(*) FROM buckets) ELSE 0 END AS rank_offset
  FROM alike s
  JOIN (SELECT run_date, trigger_min, bool_or(side = 1) AS has_buy FROM alike GROUP BY ALL) f
    USING (run_date, trigger_min)
  JOIN buckets b ON s.num_lot BETWEEN b.lo AND b.hi),
gaps AS (
  SELECT *, CASE WHEN ts_ns - lag(ts_ns) OVER (PARTITION BY run_date, trigger_min, side, bucket_idx
    ORDER BY time_str, stock, ts_ns, quantity) >= 16000000000 THEN 1 ELSE 0 END AS gap FROM placed),
segmented AS (
  SELECT *, CAST((rank_offset + bucket_idx) * 1000000 + sum(gap) OVER (
    PARTITION BY run_date, trigger_min, side, bucket_idx ORDER BY time_str, stock, ts_ns, quantity
    ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment_ids FROM gaps),
stats AS (
  SELECT *, count(*) OVER w AS segment_length, max(no_similarity_stock) OVER w AS core_strength
  FROM segmented WINDOW w AS (PARTITION BY run_date, trigger_min, segment_ids)),
long_segments AS (SELECT * FROM stats WHERE segment_length >= 3),
core AS (SELECT * FROM long_segments WHERE core_strength >= 4)"""

# Live run, no clock offset: UTC ticks against local time minus 45 seconds.
DETECTED = """
elig AS (
  SELECT *, ts_ns AS initial_ts_ns, ts_ns + 45000000000 AS shifted_ns FROM core
  WHERE ts_ns <= least((trigger_min + 420) * 60000000000,
      (trigger_min + 420) // 1440 * 86400000000000 + 52200000000000) - 45000000000),
firsts AS (
  SELECT * FROM elig QUALIFY row_number() OVER (
    PARTITION BY run_date, time_str, stock, initial_ts_ns, shifted_ns
    ORDER BY trigger_min, side DESC, bucket_idx, quantity) = 1),
detected AS (
  SELECT *, CASE WHEN side = 1 THEN num_lot ELSE 0.0 END AS arbit_ratio,
         CASE WHEN side = -1 THEN num_lot ELSE 0.0 END AS unwind_ratio,
         CASE WHEN side = 1 THEN matched_value ELSE 0.0 END AS arbit_value,
         CASE WHEN side = -1 THEN matched_value ELSE 0.0 END AS unwind_value
  FROM firsts)"""

CHAIN = [
    MARKET,
    ASOF,
    SIDED,
    SNAPSHOTS,
    ROLLUP,
    SIMILAR,
    DEFAULT_PARAMS + "," + bucket_ctes("bucket_params"),
    SEGMENTS,
    DETECTED,
]


def upto(piece: str | None, final: str) -> str:
    """The chain up to and including the given piece, then `final`."""
    end = len(CHAIN) if piece is None else CHAIN.index(piece) + 1
    return "WITH " + ",".join(CHAIN[:end]) + "\n" + final
