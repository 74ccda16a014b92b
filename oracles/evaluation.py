"""Oracles of the table and evaluation queries."""

from oracles.common import DETECTED, upto
from oracles.detection import cents


def r(expr: str, digits: int, name: str | None = None) -> str:
    return f"round_even(({expr}) * 1e{digits}::DOUBLE, 0) / 1e{digits}::DOUBLE AS {name or expr}"


def d(col: str, name: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d') AS {name or col}"


TX = """
tx AS (
  SELECT CAST(o_orderdate AS DATE) AS date, CAST(l_suppkey AS VARCHAR) AS ticker,
         CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END AS buy,
         CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS sell,
         l_extendedprice / l_quantity AS price, l_extendedprice / 1e6::DOUBLE AS value_million
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
daily AS (
  SELECT date, count(ticker) AS n_tickers, sum(value_million) * 1e6::DOUBLE AS total_value
  FROM tx GROUP BY date)"""

REPORTED = """
reported AS (
  SELECT run_date, sum(price * volume) AS flow FROM trades
  WHERE run_date <= DATE '2024-01-02' GROUP BY run_date),
predicted AS (
  SELECT run_date, sum(arbit_value) - sum(unwind_value) AS net_flow FROM detected GROUP BY run_date)"""

LOTS = """
lots AS (
  SELECT DISTINCT (user_id % 40 % 4 + 1) * 10 AS similarity,
         (1704067200000000 + (epoch_us(ts) - 1704067200000000) // 864000000000 * 86400000000 + 7200000000
          + (epoch_us(ts) - 1704067200000000) % 864000000000 // 300) * 1000 AS ts_ns,
         user_id % 40 AS stock, event_type = 'click' AS buy,
         round_even(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 10
           / (100.0::DOUBLE * (1 + user_id % 40 % 20)) * 10000, 0) / 10000 AS num_lot
  FROM events WHERE event_type IN ('click', 'purchase', 'error')
  AND CAST(json_extract_string(props, '$.k') AS DOUBLE) > 0),
quant AS (
  SELECT similarity, count(*) AS n, quantile_cont(num_lot, 0.001) AS q_low,
         quantile_cont(num_lot, 0.999) AS q_high
  FROM lots WHERE num_lot > 0 GROUP BY similarity)"""

HIST = """
trimmed AS (
  SELECT l.similarity, num_lot FROM lots l JOIN quant q USING (similarity)
  WHERE num_lot BETWEEN q_low AND q_high),
ends AS (SELECT similarity, min(num_lot) AS low, max(num_lot) AS high FROM trimmed GROUP BY ALL),
frame AS (
  SELECT similarity, i AS bin,
         CASE WHEN i = 0 THEN low ELSE exp(ln(low) + i * (ln(high) - ln(low)) / 9) END AS bin_left,
         CASE WHEN i = 8 THEN high ELSE exp(ln(low) + (i + 1) * (ln(high) - ln(low)) / 9) END AS bin_right
  FROM ends, range(0, 9) g(i)),
hist AS (
  SELECT f.similarity, bin, bin_left, bin_right, count(num_lot) AS count
  FROM frame f LEFT JOIN trimmed t
    ON f.similarity = t.similarity AND num_lot > bin_left AND num_lot <= bin_right
  GROUP BY ALL)"""

HPD = """
runs AS (
  SELECT a.similarity, a.bin AS i, b.bin AS j, a.bin_left AS lower_bound, b.bin_right AS upper_bound,
         sum(c.count) AS obs, (SELECT sum(count) FROM hist h WHERE h.similarity = a.similarity) AS total
  FROM hist a JOIN hist b ON a.similarity = b.similarity AND a.bin <= b.bin
  JOIN hist c ON c.similarity = a.similarity AND c.bin BETWEEN a.bin AND b.bin
  GROUP BY ALL),
hpd AS (
  SELECT similarity, lower_bound, upper_bound, CAST(obs AS BIGINT) AS obs_in_range,
         CAST(total AS BIGINT) AS total_obs
  FROM runs WHERE obs / total >= 0.75
  QUALIFY row_number() OVER (PARTITION BY similarity ORDER BY upper_bound - lower_bound, i, j) = 1)"""

INTRADAY = """
intraday AS (
  SELECT CAST(ts AS DATE) AS date, ts, event_id, 'S' || user_id % 40 AS sym, 'F' || user_id % 3 AS fund,
         event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
daily AS (
  SELECT date, last(sym ORDER BY ts, event_id) AS sym, last(fund ORDER BY ts, event_id) AS fund,
         sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) AS arbit_ratio,
         sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS unwind_ratio,
         sum(CASE WHEN event_type = 'click' THEN k * value ELSE 0 END) AS arbit_value,
         sum(CASE WHEN event_type = 'purchase' THEN k * value ELSE 0 END) AS unwind_value
  FROM intraday GROUP BY date)"""

COMP = """
comp AS (
  SELECT *, n * 500000 AS total_units, (n_open - n_done) * 500000 AS net_unit_change,
         round_even(nav / (n * 500000) * 1e6, 0) / 1e6 AS nav_per_unit,
         CASE WHEN day(date) = 28 THEN 0 ELSE 500000 END AS creation_unit, nav // n AS equity_value_basket,
         CASE WHEN day(date) = 13 THEN NULL ELSE date END AS parsed
  FROM (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n,
               count(*) FILTER (o_orderstatus = 'O') AS n_open,
               count(*) FILTER (o_orderstatus = 'F') AS n_done,
               CAST(sum(CAST(round_even(o_totalprice, 0) AS BIGINT)) AS BIGINT) AS nav
        FROM orders GROUP BY ALL))"""

BASKET = """
per_stock AS (
  SELECT CAST(o_orderdate AS DATE) AS date, l_suppkey, CAST(l_suppkey AS VARCHAR) AS stock,
         CASE WHEN l_suppkey % 50 = 7 THEN 0 ELSE sum(l_quantity) END AS shares,
         CAST(sum(CAST(round_even(l_extendedprice, 0) AS BIGINT)) AS DOUBLE) AS market_value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY CAST(o_orderdate AS DATE), l_suppkey),
joined AS (
  SELECT b.*, round_even(market_value / sum(market_value) OVER (PARTITION BY b.date) * 1e8, 0) / 1e6 AS weight_pct,
         CASE WHEN day(b.date) > 9 THEN 30.0::DOUBLE + day(b.date) / 10 END AS usd_to_twd,
         CASE WHEN day(b.date) > 9 THEN 25000.0::DOUBLE + day(b.date) END AS usd_to_vnd,
         c.net_unit_change, c.creation_unit, c.equity_value_basket
  FROM per_stock b LEFT JOIN comp c ON b.date = c.parsed),
priced AS (SELECT *, weight_pct / 100 AS weight, market_value / nullif(shares, 0) AS price FROM joined),
metrics AS (
  SELECT *, round_even(floor(weight * equity_value_basket / nullif(price, 0)) / 100, 0) * 100 AS quantity,
         net_unit_change / nullif(creation_unit, 0) AS net_primary_lot FROM priced),
shifted AS (
  SELECT date, stock, lag(quantity) OVER w AS volume, lag(weight) OVER w AS weight
  FROM metrics WINDOW w AS (PARTITION BY stock ORDER BY date))"""

ORACLES = {
    "reported_flow": f"""WITH {TX} SELECT {d('date', '"Date"')},
        {cents('sum(buy * price - sell * price)', 'primary_flow_vnd')} FROM tx GROUP BY date""",
    "flow_mae": upto(DETECTED, "").rstrip()
    + f""", {REPORTED} SELECT {cents('avg(abs(net_flow - flow))', 'mae')}
        FROM predicted JOIN reported USING (run_date)""",
    "flow_compare": upto(DETECTED, "").rstrip()
    + f""", {REPORTED} SELECT {d('run_date', '"Date"')}, {cents('net_flow', 'predicted')},
        {cents('flow', '"true"')} FROM predicted JOIN reported USING (run_date)""",
    "daily_traded": f"""WITH {TX} SELECT {d('date')}, n_tickers, {cents('total_value')} FROM daily""",
    "describe_daily": f"""WITH {TX} SELECT count(*) AS count, {r('avg(n_tickers)', 6, 'mean')},
        {r('stddev_samp(n_tickers)', 6, 'std')}, CAST(min(n_tickers) AS DOUBLE) AS min,
        {r('quantile_cont(n_tickers, 0.25)', 6, 'q25')}, {r('quantile_cont(n_tickers, 0.5)', 6, 'q50')},
        {r('quantile_cont(n_tickers, 0.75)', 6, 'q75')}, CAST(max(n_tickers) AS DOUBLE) AS max
        FROM daily""",
    "equal_width_hist": f"""WITH {TX},
      ends AS (SELECT min(n_tickers)::DOUBLE AS low, (max(n_tickers) - min(n_tickers)) / 10.0::DOUBLE AS w FROM daily),
      placed AS (SELECT least(floor((n_tickers - low) / w), 9) AS bin FROM daily, ends)
      SELECT CAST(i AS INTEGER) AS bin, {r('low + i * w', 6, 'bin_left')}, {r('low + (i + 1) * w', 6, 'bin_right')},
             (SELECT count(*) FROM placed p WHERE p.bin = i) AS count
      FROM ends, range(0, 10) g(i)""",
    "net_flow_hist": f"""WITH {TX},
      flows AS (SELECT {cents('sum(buy * price - sell * price)', 'flow')} FROM tx GROUP BY date),
      ends AS (SELECT min(flow)::DOUBLE AS low, (max(flow) - min(flow)) / 10.0::DOUBLE AS w FROM flows),
      placed AS (SELECT least(floor((flow - low) / w), 9) AS bin FROM flows, ends)
      SELECT CAST(i AS INTEGER) AS bin, {cents('low + i * w', 'bin_left')}, {cents('low + (i + 1) * w', 'bin_right')},
             (SELECT count(*) FROM placed p WHERE p.bin = i) AS count
      FROM ends, range(0, 10) g(i)""",
    "numlot_quantiles": f"""WITH {LOTS} SELECT CAST(similarity AS INTEGER) AS similarity, n,
        {r('q_low', 8)}, {r('q_high', 8)} FROM quant""",
    "lot_folders": f"""WITH {LOTS} SELECT CAST(similarity AS INTEGER) AS similarity, count(*) AS n,
        min(num_lot) AS low, max(num_lot) AS high FROM lots WHERE num_lot > 0 GROUP BY similarity""",
    "numlot_histogram": f"""WITH {LOTS}, {HIST} SELECT CAST(similarity AS INTEGER) AS similarity,
        CAST(bin AS INTEGER) AS bin, {r('bin_left', 6)}, {r('bin_right', 6)}, count,
        printf('(%.3g, %.3g]', bin_left, bin_right) AS bin_label FROM hist""",
    "hpd_range": f"""WITH {LOTS}, {HIST}, {HPD} SELECT CAST(similarity AS INTEGER) AS similarity,
        {r('lower_bound', 6)}, {r('upper_bound', 6)}, obs_in_range, total_obs FROM hpd""",
    "hpd_envelope": f"""WITH {LOTS}, {HIST}, {HPD} SELECT {r('min(lower_bound)', 6, 'lower_bound')},
        {r('max(upper_bound)', 6, 'upper_bound')} FROM hpd""",
    "detected_daily": f"""WITH {INTRADAY} SELECT {d('date', '"Date"')}, sym AS "Symbol", fund AS fund_name,
        {cents('arbit_ratio')}, {cents('unwind_ratio')}, {cents('arbit_value')}, {cents('unwind_value')},
        {cents('arbit_value - unwind_value', 'ab_un_diff')} FROM daily""",
    "report_compare": f"""WITH {INTRADAY},
      report AS (SELECT date, sum(value) AS flow FROM intraday
                 WHERE event_type = 'signup' AND day(date) % 2 = 0 GROUP BY date)
      SELECT {d('date', '"Date"')}, {cents('arbit_value - unwind_value', 'pi_detect')},
             {cents('coalesce(flow, 0)', 'dc_report')}
      FROM daily LEFT JOIN report USING (date) WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""",
    "composition_clean": f"""WITH {COMP} SELECT {d('parsed', '"Date"')}, nav, total_units, net_unit_change,
        nav_per_unit, creation_unit, equity_value_basket, n_done AS cash_component,
        CASE WHEN n_open > n_done THEN 'Yes' ELSE 'No' END AS fund_purchase,
        CASE WHEN n_open < n_done THEN 'Yes' ELSE 'No' END AS fund_redemption FROM comp""",
    "csv_union": f"""WITH {COMP} SELECT CASE WHEN day(date) % 2 = 0 THEN strftime(date, '%Y/%m/%d') END AS requested_date,
        nav, total_units, nav_per_unit, CASE WHEN n_open > n_done THEN 'Yes' ELSE 'No' END AS fund_purchase,
        CASE WHEN day(date) % 2 = 1 THEN 'a, b' END AS note FROM comp""",
    "composition_join": f"""WITH {COMP}, {BASKET} SELECT {d('date', '"Date"')}, stock, shares, market_value,
        net_unit_change, creation_unit, equity_value_basket FROM joined""",
    "basket_metrics": f"""WITH {COMP}, {BASKET} SELECT {d('date', '"Date"')}, stock, {r('weight', 8, 'weight_pct')},
        {r('price', 6, 'price_per_share')}, quantity, net_primary_lot,
        {r('net_primary_lot * equity_value_basket / usd_to_twd * usd_to_vnd', 0, 'primary_flow_vnd')}
        FROM metrics""",
    "weight_shift": f"""WITH {COMP}, {BASKET} SELECT {d('date', '"Date"')}, stock, volume, {r('weight', 8)}
        FROM shifted""",
    "weight_dense": f"""WITH {COMP}, {BASKET} SELECT {d('a.date', '"Date"')}, s.stock, volume,
        {r('weight', 8)} FROM (SELECT DISTINCT date FROM shifted) a
        CROSS JOIN (SELECT DISTINCT stock FROM shifted) s
        LEFT JOIN shifted x ON x.date = a.date AND x.stock = s.stock""",
}

ORACLES["weight_wide"] = ORACLES["weight_dense"]
ORACLES["wide_csv"] = ORACLES["weight_wide"]
