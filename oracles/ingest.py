"""Oracles of the page and file queries: what the pages were written from."""

PAGES = """
p AS (
  SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open,
         count(*) FILTER (o_orderstatus = 'F') AS n_done,
         CAST(sum(CAST(round_even(o_totalprice, 0) AS BIGINT)) AS BIGINT) AS nav
  FROM orders GROUP BY ALL),
pages_ AS (
  SELECT *, CASE WHEN day(d) = 5 THEN d - 1 ELSE d END AS data_d, isodow(d) >= 6 AS weekend FROM p),
held AS (
  SELECT d, code, idx, count(o_orderkey) AS c, coalesce(sum(CAST(round_even(o_totalprice, 0) AS BIGINT)), 0) AS v
  FROM p CROSS JOIN (VALUES (0, 'VIC VN', '1-URGENT'), (1, 'VHM VN', '2-HIGH'), (2, 'HPG VN', '3-MEDIUM'),
       (3, 'MSN VN', '4-NOT SPECIFIED'), (4, 'FPT VN', '5-LOW')) t(idx, code, prio)
  LEFT JOIN orders ON CAST(o_orderdate AS DATE) = d AND o_orderpriority = prio GROUP BY ALL),
firsts AS (
  SELECT data_d, min(d) AS d FROM pages_ WHERE NOT weekend AND day(d) <> 25 GROUP BY data_d)"""

DATES = """strftime(d, '%Y-%m-%d') AS requested_date,
  strftime(CASE WHEN day(d) = 5 THEN d - 1 ELSE d END, '%Y-%m-%d') AS data_date"""

CASH = """CAST(n * 12000 AS VARCHAR) AS cash_twd, CAST(n * 13000 AS VARCHAR) AS cash_usd,
  CASE WHEN day(d) % 2 = 0 THEN CAST(n * 17000 AS VARCHAR) END AS cash_vnd,
  CAST(n_done * 19000 AS VARCHAR) AS payables_twd"""

PER_UNIT = "printf('%.3f', round_even(nav / n / 500, 0) / 1000) AS nav_per_unit"

RATES = """CASE WHEN day(d) <> 3 THEN 30.0::DOUBLE + day(d) / 10 END AS usd_to_twd,
  CASE WHEN day(d) <> 3 THEN 25000.5::DOUBLE + day(d) END AS usd_to_vnd"""

HELD_FIELDS = f"""{DATES}, CAST(nav AS VARCHAR) AS net_asset_value, CAST(n * 500000 AS VARCHAR) AS total_units,
  {PER_UNIT}, {RATES}, CASE WHEN day(d) <> 20 THEN CAST(nav AS VARCHAR) END AS total_market_value,
  CASE WHEN day(d) <> 20 THEN '100.00' END AS total_weight, {CASH}"""

ORACLES = {
    "page_fields": f"""WITH {PAGES} SELECT {DATES}, CAST(n * 1000 AS VARCHAR) AS total_advance_subscription,
        CAST(nav AS VARCHAR) AS nav, CAST(n * 500000 AS VARCHAR) AS total_units,
        CAST((n_open - n_done) * 500000 AS VARCHAR) AS net_unit_change, {PER_UNIT},
        '500000' AS creation_unit, CAST(nav // n AS VARCHAR) AS equity_value_basket,
        CAST(n_done * 100 - 300 AS VARCHAR) AS cash_component, CAST(nav // n + 7 AS VARCHAR) AS price_per_basket,
        CASE WHEN n_open > n_done THEN 'Yes' ELSE 'No' END AS fund_purchase,
        CASE WHEN n_open < n_done THEN 'Yes' ELSE 'No' END AS fund_redemption FROM p""",
    "holdings_rows": f"""WITH {PAGES} SELECT {HELD_FIELDS}, code AS stock_code, 'Name & ' || idx AS stock_name,
        CAST(c * 1000 AS VARCHAR) AS shares, CAST(v AS VARCHAR) AS market_value,
        printf('%.2f', round_even(v / nav * 10000, 0) / 100) AS weight_pct
        FROM p JOIN held USING (d) WHERE day(d) <> 25
        UNION ALL SELECT {HELD_FIELDS}, 'ZZZ VN', 'late', '1', '2', '3' FROM p WHERE day(d) = 20""",
    "cash_labels": f"WITH {PAGES} SELECT {DATES}, {CASH} FROM p",
    "fx_fill": """SELECT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS "Date", l_suppkey || ' VN' AS stock_code,
        CASE WHEN day(o_orderdate) <> 3 THEN 30.0::DOUBLE + day(o_orderdate) / 10 END AS usd_to_twd,
        CASE WHEN day(o_orderdate) > 9 THEN 25000.0::DOUBLE + day(o_orderdate)
             WHEN day(o_orderdate) <> 3 THEN 25000.5::DOUBLE + day(o_orderdate) END AS usd_to_vnd
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "rate_gaps": """SELECT DISTINCT strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') AS "Date"
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE day(o_orderdate) <= 9""",
    "pages_to_weights": f"""WITH {PAGES},
      once AS (SELECT data_d, min(d) AS d FROM pages_ WHERE day(d) <> 25 GROUP BY data_d),
      basket AS (
        SELECT data_d, split_part(code, ' ', 1) AS stock, c * 1000::DOUBLE AS shares, v::DOUBLE AS market_value,
               CAST(printf('%.2f', round_even(v / nav * 10000, 0) / 100) AS DOUBLE) / 100 AS weight, nav, {PER_UNIT}
        FROM once JOIN p USING (d) JOIN held USING (d)
        UNION ALL SELECT data_d, 'ZZZ', 1, 2, 3::DOUBLE / 100, nav, {PER_UNIT} FROM once JOIN p USING (d) WHERE day(d) = 20),
      comp AS (SELECT d AS data_d, nav, {PER_UNIT}, (nav // n)::DOUBLE AS equity FROM p),
      sized AS (
        SELECT data_d, stock, weight,
               round_even(floor(weight * equity / nullif(market_value / nullif(shares, 0), 0)) / 100, 0) * 100 AS quantity
        FROM basket LEFT JOIN comp USING (data_d, nav, nav_per_unit))
      SELECT strftime(data_d, '%Y-%m-%d') AS "Date", stock, lag(quantity) OVER w AS volume,
             round_even(lag(weight) OVER w * 1e8::DOUBLE, 0) / 1e8::DOUBLE AS weight
      FROM sized WINDOW w AS (PARTITION BY stock ORDER BY data_d)""",
    "missing_dates": f"""WITH {PAGES},
      days AS (SELECT unnest(generate_series((SELECT min(d) FROM p WHERE day(d) % 2 = 0),
                 (SELECT max(d) FROM p WHERE day(d) % 2 = 0), INTERVAL 1 DAY))::DATE AS d)
      SELECT strftime(d, '%Y-%m-%d') AS data_date, CAST(isodow(d) >= 6 AS INTEGER) AS weekend FROM days
      WHERE d NOT IN (SELECT d FROM p WHERE day(d) % 2 = 0)""",
    "ingest_status": f"""WITH {PAGES}
      SELECT CASE WHEN weekend THEN 'skipped' WHEN day(q.d) = 25 THEN 'failed' WHEN f.d IS NOT NULL THEN 'success'
             ELSE 'duplicate' END AS status, count(*) AS n
      FROM pages_ q LEFT JOIN firsts f ON q.data_d = f.data_d AND q.d = f.d GROUP BY 1""",
    "first_writer_sink": f"""WITH {PAGES},
      w AS (SELECT * FROM pages_ WHERE NOT weekend
            QUALIFY row_number() OVER (PARTITION BY data_d ORDER BY d) = 1)
      SELECT strftime(data_d, '%Y-%m-%d') AS data_date, strftime(d, '%Y-%m-%d') AS requested_date,
             CAST(nav AS VARCHAR) AS nav FROM w""",
}

ORACLES["rates_written_back"] = ORACLES["fx_fill"]
