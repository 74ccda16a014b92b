"""Adapters from the driver's test tables to the inputs of the engine.

Plain column expressions only, so each has a literal twin in the oracle SQL.
Events of 30 days are laid onto three run dates: ten days each, the clock
compressed and started at 02:00 UTC (09:00 local).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.functions.scalars import int_div, safe_div

DAY_US = 86_400_000_000
EPOCH_2024_US = 1_704_067_200_000_000
SPAN_US = 10 * DAY_US
OPEN_US = 2 * 3_600_000_000

TRADE_EVENTS = ("click", "purchase", "error")
QUOTE_EVENTS = ("view", "signup")
# Stock number 38 has no weight row, number 39 one with NULLs.
STOCKS, UNLISTED, UNWEIGHTED = 40, 38, 39
# The third run date has no reported flow.
REPORTED_UNTIL = "2024-01-02"


@dataclass(frozen=True)
class Market:
    trades: DataFrame
    quotes: DataFrame
    weights: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def clocked_events(events: DataFrame, clock_div: int = 300) -> DataFrame:
    """run_date, stock, ts_ns and the raw event columns."""
    rel = _us(F.col("ts")) - F.lit(EPOCH_2024_US)
    day = int_div(rel, SPAN_US)
    us = (
        F.lit(EPOCH_2024_US + OPEN_US) + day * DAY_US + int_div(F.pmod(rel, F.lit(SPAN_US)), clock_div)
    )
    n = F.pmod(F.col("user_id"), F.lit(STOCKS))
    return events.select(
        F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("run_date"),
        F.concat(F.lit("S"), F.lpad(n.cast("string"), 2, "0")).alias("stock"),
        n.alias("stock_no"),
        (us * 1000).alias("ts_ns"),
        F.col("event_id").alias("src_seq"),
        "event_type",
        "value",
        (F.get_json_object("props", "$.k").cast("double") * 10).alias("volume"),
    )


def trades(events: DataFrame, clock_div: int = 300) -> DataFrame:
    return (
        clocked_events(events, clock_div)
        .filter(F.col("event_type").isin(*TRADE_EVENTS))
        .select("run_date", "stock", "ts_ns", "src_seq", F.col("value").alias("price"), "volume")
    )


def quotes(events: DataFrame, clock_div: int = 300) -> DataFrame:
    return (
        clocked_events(events, clock_div)
        .filter(F.col("event_type").isin(*QUOTE_EVENTS))
        .select(
            "run_date",
            "stock",
            "ts_ns",
            "src_seq",
            (F.col("value") * 0.999).alias("bid"),
            (F.col("value") * 1.001).alias("ask"),
        )
    )


def weights(events: DataFrame, clock_div: int = 300) -> DataFrame:
    n = F.col("stock_no")
    return (
        clocked_events(events, clock_div)
        .select("run_date", "stock", "stock_no")
        .distinct()
        .filter(n != UNLISTED)
        .withColumn(
            "quantity",
            F.when(n != UNWEIGHTED, (F.pmod(n, F.lit(20)) + 1).cast("double") * 100.0),
        )
        .withColumn(
            "weight", F.col("quantity") / F.sum("quantity").over(W.partitionBy("run_date"))
        )
        .select("run_date", "stock", "quantity", "weight")
    )


def market(spark: SparkSession, sf_dir: str, clock_div: int = 300) -> Market:
    events = table(spark, sf_dir, "events")
    return Market(trades(events, clock_div), quotes(events, clock_div), weights(events, clock_div))


def reported_for_run_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, primary_flow_vnd of the detection dates, one date missing."""
    flow = F.col("price") * F.col("volume")
    return (
        trades(table(spark, sf_dir, "events"))
        .filter(F.col("run_date") <= F.lit(REPORTED_UNTIL).cast("date"))
        .groupBy(F.col("run_date").alias("Date"))
        .agg(F.round(F.sum(flow), 2).alias("primary_flow_vnd"))
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ticker, buy, sell, price, value_million."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_linestatus"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    qty = F.col("l_quantity")
    return li.join(orders, li.l_orderkey == orders.o_orderkey).select(
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("l_suppkey").cast("string").alias("ticker"),
        F.when(F.col("l_linestatus") == "O", qty).otherwise(0.0).alias("buy"),
        F.when(F.col("l_linestatus") == "F", qty).otherwise(0.0).alias("sell"),
        safe_div(F.col("l_extendedprice"), qty).alias("price"),
        (F.col("l_extendedprice") / 1e6).alias("value_million"),
    )


def lot_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """similarity, ts_ns, stock, side, num_lot; every row twice, as files of a
    folder overlap."""
    ev = clocked_events(table(spark, sf_dir, "events")).filter(
        F.col("event_type").isin(*TRADE_EVENTS)
    )
    quantity = (F.pmod(F.col("stock_no"), F.lit(20)) + 1).cast("double") * 100.0
    rows = ev.select(
        ((F.pmod(F.col("stock_no"), F.lit(4)) + 1) * 10).cast("int").alias("similarity"),
        "ts_ns",
        "stock",
        F.when(F.col("event_type") == "click", 1).otherwise(-1).alias("side"),
        (F.rint(F.col("volume") / quantity * 1e4) / 1e4).alias("num_lot"),
    ).filter("num_lot > 0")
    return rows.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("copy")


def intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, Symbol, fund_name, four measures, src_seq: detections as stored
    by an intraday run."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")

    def on(kind: str, x: Column) -> Column:
        return F.when(F.col("event_type") == kind, x).otherwise(F.lit(0.0))

    return ev.select(
        F.col("ts").cast("timestamp").alias("Date"),
        F.concat(F.lit("S"), F.pmod(F.col("user_id"), F.lit(STOCKS))).alias("Symbol"),
        F.concat(F.lit("F"), F.pmod(F.col("user_id"), F.lit(3))).alias("fund_name"),
        on("click", k).alias("arbit_ratio"),
        on("click", k * F.col("value")).alias("arbit_value"),
        on("purchase", k).alias("unwind_ratio"),
        on("purchase", k * F.col("value")).alias("unwind_value"),
        F.col("event_id").alias("src_seq"),
    )


def fund_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date, primary_flow: one row per even day of the month."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == "signup")
    day = F.col("ts").cast("date")
    return (
        ev.filter(F.pmod(F.dayofmonth(day), F.lit(2)) == 0)
        .groupBy(day.alias("Date"))
        .agg(F.round(F.sum("value"), 2).alias("primary_flow"))
    )


def raw_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composition files as they are scraped: text dates in two formats, one
    unreadable per month, and columns nobody asked for."""
    day = F.col("o_orderdate").cast("date")
    status = F.col("o_orderstatus")
    total = F.col("o_totalprice")
    per_day = (
        table(spark, sf_dir, "orders")
        .groupBy(day.alias("day"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(status == "O").alias("n_open"),
            F.count_if(status == "F").alias("n_done"),
            # Whole currency units: the sum does not depend on its order.
            F.sum(F.rint(total).cast("bigint")).alias("nav"),
        )
    )
    text = (
        F.when(F.dayofmonth("day") == 13, F.lit("n/a"))
        .when(F.pmod(F.dayofmonth("day"), F.lit(2)) == 0, F.date_format("day", "yyyy/MM/dd"))
        .otherwise(F.date_format("day", "yyyy-MM-dd"))
    )
    return per_day.select(
        F.col("day"),
        text.alias("requested_date"),
        "nav",
        (F.col("n") * 500_000).alias("total_units"),
        ((F.col("n_open") - F.col("n_done")) * 500_000).alias("net_unit_change"),
        (F.rint(F.col("nav") / (F.col("n") * 500_000) * 1e6) / 1e6).alias("nav_per_unit"),
        # A zero divisor now and then.
        F.when(F.dayofmonth("day") == 28, 0).otherwise(500_000).cast("bigint").alias("creation_unit"),
        int_div(F.col("nav"), F.col("n")).alias("equity_value_basket"),
        F.col("n_done").alias("cash_component"),
        F.when(F.col("n_open") > F.col("n_done"), "Yes").otherwise("No").alias("fund_purchase"),
        F.when(F.col("n_open") < F.col("n_done"), "Yes").otherwise("No").alias("fund_redemption"),
        F.lit("E1").alias("etf_code"),
    )


def raw_basket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Basket files, one row per day and stock. The rate columns are missing
    (NULL) on days 1 to 9 of each month."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    comp = raw_composition(spark, sf_dir).select(
        F.col("day").alias("comp_day"), "nav", "nav_per_unit"
    )
    per_stock = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .groupBy(F.col("o_orderdate").cast("date").alias("day"), "l_suppkey")
        .agg(
            F.sum("l_quantity").alias("shares"),
            F.sum(F.rint(F.col("l_extendedprice")).cast("bigint")).cast("double").alias("market_value"),
        )
    )
    # Day totals by aggregation and join: a day may hold very many stocks.
    totals = per_stock.groupBy(F.col("day").alias("total_day")).agg(
        F.sum("market_value").alias("total_market_value")
    )
    has_rates = F.dayofmonth("day") > 9
    return (
        per_stock.join(totals, F.col("day") == F.col("total_day"))
        .join(comp, F.col("day") == F.col("comp_day"), "left")
        .select(
            "day",
            F.date_format("day", "yyyy/MM/dd").alias("data_date"),
            F.concat(F.col("l_suppkey").cast("string"), F.lit(" VN")).alias("stock_code"),
            F.when(F.pmod(F.col("l_suppkey"), F.lit(50)) == 7, 0.0)
            .otherwise(F.col("shares"))
            .alias("shares"),
            "market_value",
            (F.rint(F.col("market_value") / F.col("total_market_value") * 1e8) / 1e6).alias(
                "weight_pct"
            ),
            F.col("nav").alias("net_asset_value"),
            "nav_per_unit",
            "total_market_value",
            F.when(has_rates, 30.0 + F.dayofmonth("day") / 10).alias("usd_to_twd"),
            F.when(has_rates, 25000.0 + F.dayofmonth("day")).alias("usd_to_vnd"),
        )
    )


# ---- fund pages ------------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HOLDINGS = ("VIC VN", "VHM VN", "HPG VN", "MSN VN", "FPT VN")


def fund_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requested_date, html: one page per order day, written from that day's
    orders. By day of the month some pages repeat the previous day's date (5),
    print none (17), have no total row (20), no holdings (25) or no rates (3).
    """
    date = F.col("o_orderdate").cast("date")
    value = F.rint("o_totalprice").cast("bigint")
    status = F.col("o_orderstatus")
    per_day = (
        table(spark, sf_dir, "orders")
        .groupBy(date.alias("d"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(status == "O").alias("n_open"),
            F.count_if(status == "F").alias("n_done"),
            F.sum(value).alias("nav"),
            *[F.count_if(F.col("o_orderpriority") == p).alias(f"c{i}") for i, p in enumerate(PRIORITIES)],
            *[
                F.coalesce(F.sum(F.when(F.col("o_orderpriority") == p, value)), F.lit(0)).alias(f"v{i}")
                for i, p in enumerate(PRIORITIES)
            ],
        )
    )
    dom = F.dayofmonth("d")

    def whole(x: Column) -> Column:
        return F.format_number(x, 0)

    def line(label: str, x: Column) -> Column:
        return F.concat(F.lit(f"<tr><td>{label}</td><td>TWD "), x, F.lit("</td></tr>\n"))

    def cells(*parts: Column) -> Column:
        inner = [F.concat(F.lit("<td> "), p, F.lit("</td>")) for p in parts]
        return F.concat(F.lit("<tr>"), *inner, F.lit("</tr>"))

    def yes_no(c: Column) -> Column:
        return F.when(c, F.lit("Yes")).otherwise(F.lit("No"))

    printed = F.when(dom == 5, F.date_sub("d", 1)).otherwise(F.col("d"))
    head = F.when(
        dom != 17, F.concat(F.lit("<div>Date: "), F.date_format(printed, "yyyy/MM/dd"), F.lit("</div>"))
    ).otherwise("")
    info = [
        line("Amount of Total Advance Subscription", whole(F.col("n") * 1000)),
        line("Net Asset Value", whole(F.col("nav"))),
        line("Total Units Outstanding", whole(F.col("n") * 500_000)),
        F.concat(
            F.lit("<tr><td>Net Unit Change</td><td>"),
            whole((F.col("n_open") - F.col("n_done")) * 500_000),
            F.lit("</td></tr>"),
        ),
        line("NAV Per Unit", F.format_number(F.rint(F.col("nav") / F.col("n") / 500) / 1000, 3)),
        line("Creation/Redemption Unit", whole(F.lit(500_000))),
        line("Equity Value Per Basket", whole(int_div(F.col("nav"), F.col("n")))),
        line("Cash Component Per Basket", whole(F.col("n_done") * 100 - 300)),
        line("Price per Creation Basket", whole(int_div(F.col("nav"), F.col("n")) + 7)),
        F.concat(
            F.lit("<tr><td>Fund Purchase</td><td>"),
            yes_no(F.col("n_open") > F.col("n_done")),
            F.lit("</td></tr><tr><td>Fund Redemption</td><td>"),
            yes_no(F.col("n_open") < F.col("n_done")),
            F.lit("</td></tr>"),
        ),
    ]
    # On some days a holding has a further cell with a table in it.
    note = F.when(F.pmod(dom, F.lit(7)) == 0, "<td><table class='note'><tr><td>new</td></tr></table></td>").otherwise("")
    holdings = [
        cells(
            F.lit(code),
            F.lit(f"Name &amp; {i}"),
            whole(F.col(f"c{i}") * 1000),
            whole(F.col(f"v{i}")),
            F.concat(F.format_number(F.rint(F.col(f"v{i}") / F.col("nav") * 10_000) / 100, 2), F.lit("%")),
        )
        for i, code in enumerate(HOLDINGS)
    ]
    total = F.when(
        dom != 20, cells(F.lit("Total"), F.lit(""), F.lit(""), whole(F.col("nav")), F.lit("100.00%"))
    ).otherwise("")
    late = cells(F.lit("ZZZ VN"), F.lit("late"), F.lit("1"), F.lit("2"), F.lit("3%"))
    noted = [F.concat(F.regexp_replace(h, "</tr>$", ""), note, F.lit("</tr>")) for h in holdings]
    basket = F.when(
        dom != 25,
        F.concat(
            F.lit("<table class='table1'><tr><th>Code</th></tr>"), *noted, total, late, F.lit("</table>")
        ),
    ).otherwise("")
    cash = F.concat(
        F.lit('<table class="table1"><tr><td>Cash</td><td>Holdings</td></tr>'),
        cells(F.lit("Cash (TWD)"), whole(F.col("n") * 11_000)),
        cells(F.lit("Cash (USD)"), whole(F.col("n") * 13_000)),
        cells(F.lit("Cash (TWD) adjusted"), whole(F.col("n") * 12_000)),
        F.when(F.pmod(dom, F.lit(2)) == 0, cells(F.lit("Cash (VND)"), whole(F.col("n") * 17_000))).otherwise(""),
        cells(F.lit("Payables in TWD"), whole(F.col("n_done") * 19_000)),
        F.lit("</table>"),
    )
    rates = F.when(
        dom != 3,
        F.concat(
            F.lit("<p>1 USD = "),
            F.format_number(F.lit(30.0) + dom / 10, 1),
            F.lit(" TWD</p><p>1 USD = "),
            F.format_number(F.lit(25000.5) + dom, 1),
            F.lit(" VND</p>"),
        ),
    ).otherwise("")
    html = F.concat(
        F.lit("<html><head><style>td{width:1px}</style></head><body><!-- Net Asset Value 1 -->"),
        head,
        F.lit("<table class='info'>"),
        *info,
        F.lit("</table>"),
        basket,
        cash,
        rates,
        F.lit("</body></html>"),
    )
    return per_day.select(F.col("d").alias("requested_date"), html.alias("html"))
