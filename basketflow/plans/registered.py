"""The registered queries: one callable (spark, sf_dir) -> DataFrame per key.

Dates leave as text and times as epoch nanoseconds, so results compare
exactly with another engine; money is rounded to cents because the order of a
floating-point sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketflow import fixtures as fx
from basketflow.functions.scalars import half_even, int_div, to_timestamp
from basketflow.operators import basket as ba
from basketflow.operators import buckets as bk
from basketflow.operators import evaluation as ev
from basketflow.operators import segments as sg
from basketflow.operators import snapshots as sn
from basketflow.operators import ticks as tk
from basketflow.params import Calendar, DetectionParams
from basketflow.plans import detect as dt
from basketflow.plans import sweep as sw
from basketflow.plans.weights import weights_from_pages
from basketflow.session import prepare, shared_dir
from basketflow.sources import pages as pg
from basketflow.sources import tables as tb
from basketflow.streaming import live as lv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CALENDAR = Calendar()
# Thresholds that give results on the test tables (40 thinly traded stocks).
PARAMS = DetectionParams(min_unique=3, min_segment=3, core_threshold=4)


def register(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def day(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "yyyy-MM-dd").alias(name or c)


def cents(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return half_even(col, 2).alias(name or c)


# ---- detection -------------------------------------------------------------


@register
def basket_ticks(spark, sf_dir):
    """Trades of basket stocks with a readable time."""
    m = fx.market(spark, sf_dir)
    return tk.basket_only(m.trades, m.weights).select(
        day("run_date"),
        "stock",
        F.unix_micros(to_timestamp(F.col("ts_ns"))).alias("ts_us"),
        "src_seq",
        "price",
        "volume",
    )


def _asof(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    return tk.asof_quotes(tk.basket_only(m.trades, m.weights), tk.basket_only(m.quotes, m.weights))


@register
def asof_quotes(spark, sf_dir):
    """Latest quote at or before each trade, at most five minutes old."""
    return _asof(spark, sf_dir).select(
        day("run_date"), "stock", "ts_ns", "src_seq", "price", "quote_ts_ns", "quote_seq", "bid", "ask"
    )


@register
def csv_ticks(spark, sf_dir):
    """Trades and quotes stored as CSV by date, read back and joined as of each trade. Rows of equal time keep the order
    they have in the files."""
    m, root = fx.market(spark, sf_dir), shared_dir(spark, "ticks")
    stored = {"symbol": F.col("stock"), "ts": F.col("ts_ns")}
    trades = {**stored, "c": F.col("price"), "mv": F.col("volume")}
    quotes = {**stored, "bb0_p": F.col("bid"), "bo0_p": F.col("ask")}
    read = []
    for kind, rows, columns in (("tick", m.trades, trades), ("book", m.quotes, quotes)):
        ordered = rows.repartitionByRange("run_date", "src_seq").sortWithinPartitions("run_date", "src_seq")
        ordered.select("run_date", *[c.alias(n) for n, c in columns.items()]).write.partitionBy("run_date").csv(f"{root}/{kind}", header=True)
        types = {"ts": "bigint", **{n: "double" for n in list(columns)[2:]}}
        read.append(tb.read_tick_csv(spark, f"{root}/{kind}/run_date={{date}}", types))
    ticks, book = tb.as_trades(read[0]), tb.as_quotes(read[1])
    joined = tk.asof_quotes(tk.basket_only(ticks, m.weights), tk.basket_only(book, m.weights))
    return joined.select(day("run_date"), "stock", "ts_ns", "price", "volume", "quote_ts_ns", "bid", "ask")


@register
def trade_side(spark, sf_dir):
    """Trades classified as buys and sells."""
    return tk.trade_side(_asof(spark, sf_dir)).select(
        day("run_date"), "stock", "ts_ns", "src_seq", "price", "bid", "ask", "side"
    )


@register
def trigger_fanout(spark, sf_dir):
    """Every classified trade with each minute whose snapshot holds it."""
    rows = sn.with_trigger_range(tk.trade_side(_asof(spark, sf_dir)), CALENDAR)
    return sn.fan_out(rows, CALENDAR).select(
        day("run_date"), "trigger_min", "stock", "src_seq", "ts_ns"
    )


def _rollup(spark, sf_dir):
    m = fx.market(spark, sf_dir)
    sided = dt.sided_trades(m.trades, m.quotes, m.weights, CALENDAR)
    return sn.second_rollup(sided, m.weights, CALENDAR)


@register
def second_rollup(spark, sf_dir):
    """Volume, value, last time and lots per second, stock and side."""
    return _rollup(spark, sf_dir).select(
        day("run_date"),
        "trigger_min",
        "time_str",
        "stock",
        "side",
        "quantity",
        "matched_vol",
        cents("matched_value"),
        "ts_ns",
        "num_lot",
    )


@register
def block_start(spark, sf_dir):
    """First time of each second, per snapshot and side."""
    return sn.block_start(_rollup(spark, sf_dir)).select(
        day("run_date"), "trigger_min", "side", "time_str", "stock", "quantity", "block_start_ns"
    )


def _similar(spark, sf_dir, params=PARAMS):
    m = fx.market(spark, sf_dir)
    return dt.similar_rows(m.trades, m.quotes, m.weights, params)


@register
def similarity_count(spark, sf_dir):
    """Rows with at least three stocks trading similar lots."""
    return _similar(spark, sf_dir).select(
        day("run_date"),
        "trigger_min",
        "side",
        "time_str",
        "stock",
        "quantity",
        "num_lot",
        "no_similarity_stock",
    )


@register
def bucket_assign(spark, sf_dir):
    """Lot buckets of the similar rows; an edge lot appears twice."""
    table = bk.bucket_literal(spark, PARAMS.buckets)
    return bk.assign_buckets(_similar(spark, sf_dir), table).select(
        day("run_date"), "trigger_min", "side", "time_str", "stock", "num_lot", "bucket_idx", "lot_bucket"
    )


@register
def segments(spark, sf_dir):
    """Gap sessions per snapshot, side and bucket."""
    table = bk.bucket_literal(spark, PARAMS.buckets)
    parts = sg.segments(_similar(spark, sf_dir), table, PARAMS.seconds_early)
    return sg.segment_stats(parts).select(
        day("run_date"),
        "trigger_min",
        "side",
        "bucket_idx",
        "time_str",
        "stock",
        "segment_ids",
        "segment_length",
        "core_strength",
    )


@register
def core_filter(spark, sf_dir):
    """Long segments with a strong core."""
    kept = dt.segment_rows(_similar(spark, sf_dir), PARAMS)
    return sg.core_filter(kept, PARAMS.core_threshold).select(
        day("run_date"), "trigger_min", "time_str", "stock", "side", "segment_ids", "core_strength"
    )


@register
def eligibility(spark, sf_dir):
    """The hold-back with both clocks in local time, where it does drop rows."""
    kept = sg.core_filter(dt.segment_rows(_similar(spark, sf_dir), PARAMS), PARAMS.core_threshold)
    return sg.eligible(kept, live=True, clock_offset_hours=7).select(
        day("run_date"), "trigger_min", "time_str", "stock", "side", "segment_ids", "ts_ns"
    )


@register
def eligibility_closed(spark, sf_dir):
    """The cut-off of a run after hours: 14:30 on the day of the last row, with its seconds.
    The clock is moved so that it falls among the rows."""
    kept = sg.core_filter(dt.segment_rows(_similar(spark, sf_dir), PARAMS), PARAMS.core_threshold)
    return sg.eligible(kept, live=False, clock_offset_hours=12).select(
        day("run_date"), "trigger_min", "time_str", "stock", "side", "segment_ids", "ts_ns"
    )


def _detected(spark, sf_dir, params=PARAMS, clock_div=300):
    m = fx.market(spark, sf_dir, clock_div)
    return dt.detect_flow(m.trades, m.quotes, m.weights, params)


@register
def first_detection(spark, sf_dir):
    """Each second of a stock once, from the first snapshot that found it."""
    rows = dt.eligible_rows(dt.segment_rows(_similar(spark, sf_dir), PARAMS), PARAMS)
    return sg.first_detection(rows).select(
        day("run_date"), "trigger_min", "time_str", "stock", "side", "initial_ts_ns", "ts_ns"
    )


@register
def arbit_unwind(spark, sf_dir):
    """Ratios and values of each detection, split by side."""
    return _detected(spark, sf_dir).select(
        day("run_date"),
        "time_str",
        "stock",
        "side",
        "initial_ts_ns",
        "arbit_ratio",
        "unwind_ratio",
        cents("arbit_value"),
        cents("unwind_value"),
    )


def detection_columns(detected: DataFrame) -> DataFrame:
    return detected.select(
        day("run_date"),
        "time_str",
        "stock",
        "side",
        "quantity",
        "matched_vol",
        cents("matched_value"),
        "ts_ns",
        "num_lot",
        "block_start_ns",
        "no_similarity_stock",
        "segment_ids",
        "lot_bucket",
        "segment_length",
        "initial_ts_ns",
        "arbit_ratio",
        "unwind_ratio",
        cents("arbit_value"),
        cents("unwind_value"),
    )


@register
def detect_flow(spark, sf_dir):
    """The whole detection."""
    return detection_columns(_detected(spark, sf_dir))


@register
def result_sink(spark, sf_dir):
    """Detections stored by date; storing them again replaces them."""
    path, aside = shared_dir(spark, "results"), shared_dir(spark, "results")
    found = dt.result_layout(_detected(spark, sf_dir))
    tb.write_results(found, path)
    tb.write_results(tb.read_results(spark, path, found), aside)
    tb.write_results(tb.read_results(spark, aside, found), path)
    return _stored_columns(tb.read_results(spark, path, found))


@register
def result_csv(spark, sf_dir):
    """Detections stored as CSV files by date and read back."""
    path, found = shared_dir(spark, "results"), dt.result_layout(_detected(spark, sf_dir))
    tb.write_results(found, path, "csv")
    return _stored_columns(tb.read_results(spark, path, found, "csv"))


def _stored_columns(stored: DataFrame) -> DataFrame:
    return stored.select(
        day("run_date"),
        "time_str",
        "stock",
        "side",
        F.unix_micros("ts").alias("ts_us"),
        F.unix_micros("initial_ts").alias("initial_ts_us"),
        "segment_ids",
        cents("arbit_value"),
        cents("unwind_value"),
    )


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole detection on a small table: a slower clock (denser snapshots)
    and thresholds of two."""
    params = DetectionParams(min_unique=2, min_segment=2, core_threshold=2)
    return detection_columns(_detected(prepare(spark), sf_dir, params, clock_div=3000))


@register
def daily_net_flow(spark, sf_dir):
    """Net flow per run date."""
    return dt.daily_net_flow(_detected(spark, sf_dir)).select(day("run_date"), cents("net_flow"))


@register
def lot_buckets(spark, sf_dir):
    """A bucket table for each of many parameter sets."""
    s = F.col("s_suppkey")
    params = fx.table(spark, sf_dir, "supplier").select(
        s.alias("param_id"),
        (0.02 + F.pmod(s * 37, F.lit(79)) / 100.0).alias("start"),
        (F.lit(50) + F.pmod(s * 17, F.lit(51))).cast("double").alias("stop"),
        (F.lit(20) + F.pmod(s * 13, F.lit(41))).cast("int").alias("num"),
        (0.25 + F.pmod(s, F.lit(6)) * 0.05).alias("step"),
        (1.0 + F.pmod(s * 7, F.lit(51)) / 100.0).alias("growth"),
        (F.lit(3) + F.pmod(s, F.lit(7))).cast("double").alias("int_threshold"),
        F.when(F.pmod(s, F.lit(5)) > 0, 0.05 + F.pmod(s * 3, F.lit(10)) * 0.05).alias("first_center"),
    )
    return bk.bucket_table(params, "param_id")


# ---- tables and evaluation -------------------------------------------------


@register
def reported_flow(spark, sf_dir):
    """Net bought value per day, from transactions."""
    return ev.reported_flow(fx.transactions(spark, sf_dir)).select(
        day("Date"), cents("primary_flow_vnd")
    )


@register
def flow_mae(spark, sf_dir):
    """Error of the detected against the reported flow."""
    predicted = dt.daily_net_flow(_detected(spark, sf_dir)).withColumnRenamed("run_date", "Date")
    return ev.flow_mae(predicted, fx.reported_for_run_dates(spark, sf_dir)).select(cents("mae"))


@register
def flow_compare(spark, sf_dir):
    """Predicted and true flow on the dates that have both."""
    predicted = dt.daily_net_flow(_detected(spark, sf_dir)).withColumnRenamed("run_date", "Date")
    dates = fx.trades(fx.table(spark, sf_dir, "events")).select(F.col("run_date").alias("Date"))
    return ev.compare_flows(
        dates.distinct(), predicted, fx.reported_for_run_dates(spark, sf_dir)
    ).select(day("Date"), cents("predicted"), cents("true"))


@register
def daily_traded(spark, sf_dir):
    """Number of traded tickers and total value per day."""
    return ev.daily_traded(fx.transactions(spark, sf_dir)).select(
        day("date"), "n_tickers", cents("total_value")
    )


@register
def describe_daily(spark, sf_dir):
    """Summary of the daily ticker counts."""
    daily = ev.daily_traded(fx.transactions(spark, sf_dir))
    return ev.describe(daily, "n_tickers").select(
        "count", *[half_even(F.col(c).cast("double"), 6).alias(c) for c in
                   ("mean", "std", "min", "q25", "q50", "q75", "max")]
    )


@register
def equal_width_hist(spark, sf_dir):
    """Daily ticker counts in ten bins of equal width."""
    daily = ev.daily_traded(fx.transactions(spark, sf_dir))
    return ev.equal_width_histogram(daily, "n_tickers").select(
        "bin",
        half_even(F.col("bin_left"), 6).alias("bin_left"),
        half_even(F.col("bin_right"), 6).alias("bin_right"),
        "count",
    )


@register
def net_flow_hist(spark, sf_dir):
    """Daily net flows in ten bins of equal width, from a stored table of which two columns are read."""
    path = shared_dir(spark, "flow")
    flows = ev.reported_flow(fx.transactions(spark, sf_dir)).withColumn("primary_flow_vnd", cents("primary_flow_vnd"))
    flows.withColumn("weekend", pg.is_weekend(F.col("Date"))).write.parquet(path)
    return ev.equal_width_histogram(tb.read_primary_flow(spark.read.parquet(path)), "primary_flow_vnd").select(
        "bin", cents("bin_left"), cents("bin_right"), "count"
    )


@register
def numlot_quantiles(spark, sf_dir):
    """Outer quantiles of the lots per similarity."""
    q = ev.lot_quantiles(fx.lot_data(spark, sf_dir))
    return q.select(
        "similarity", "n", *[half_even(F.col(c), 8).alias(c) for c in ("q_low", "q_high")]
    )


@register
def lot_folders(spark, sf_dir):
    """Lots stored in a folder per similarity, read back with it, per similarity."""
    path = shared_dir(spark, "lots")
    fx.lot_data(spark, sf_dir).write.partitionBy("similarity").parquet(path)
    lots = ev.distinct_lots(tb.read_lot_folders(spark, path))
    return lots.groupBy("similarity").agg(
        F.count(F.lit(1)).alias("n"), F.min("num_lot").alias("low"), F.max("num_lot").alias("high")
    )


@register
def numlot_histogram(spark, sf_dir):
    """Log-spaced lot histogram per similarity, with labels."""
    h = ev.labelled(ev.log_histogram(fx.lot_data(spark, sf_dir)))
    return h.select(
        "similarity",
        "bin",
        half_even(F.col("bin_left"), 6).alias("bin_left"),
        half_even(F.col("bin_right"), 6).alias("bin_right"),
        "count",
        "bin_label",
    )


def _hpd(spark, sf_dir):
    return ev.hpd_range(ev.log_histogram(fx.lot_data(spark, sf_dir)), 0.75)


@register
def hpd_range(spark, sf_dir):
    """Shortest run of bins with three quarters of the lots."""
    return _hpd(spark, sf_dir).select(
        "similarity",
        half_even(F.col("lower_bound"), 6).alias("lower_bound"),
        half_even(F.col("upper_bound"), 6).alias("upper_bound"),
        "obs_in_range",
        "total_obs",
    )


@register
def hpd_envelope(spark, sf_dir):
    """Widest bounds over all similarities."""
    return ev.hpd_envelope(_hpd(spark, sf_dir)).select(
        *[half_even(F.col(c), 6).alias(c) for c in ("lower_bound", "upper_bound")]
    )


@register
def detected_daily(spark, sf_dir):
    """Intraday detections summed per day."""
    return ev.detected_daily(fx.intraday(spark, sf_dir)).select(
        day("Date"),
        "Symbol",
        "fund_name",
        *[cents(c) for c in ("arbit_ratio", "unwind_ratio", "arbit_value", "unwind_value", "ab_un_diff")],
    )


@register
def report_compare(spark, sf_dir):
    """Detected against reported flow in a date range."""
    daily = ev.detected_daily(fx.intraday(spark, sf_dir))
    return ev.report_compare(
        daily, fx.fund_report(spark, sf_dir), "2024-01-05", "2024-01-20"
    ).select(day("Date"), cents("pi_detect"), cents("dc_report"))


def _composition(spark, sf_dir):
    return ba.composition(fx.raw_composition(spark, sf_dir).drop("day"))


@register
def composition_clean(spark, sf_dir):
    """Composition with known columns and parsed dates."""
    return _composition(spark, sf_dir).withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))


@register
def csv_union(spark, sf_dir):
    """Compositions written as CSV with different columns, read back as one table of types."""
    path = shared_dir(spark, "csv")
    columns = ["requested_date", "nav", "total_units", "nav_per_unit", "fund_purchase"]
    rows = fx.raw_composition(spark, sf_dir).select("day", *columns)
    even = F.pmod(F.dayofmonth("day"), F.lit(2)) == 0
    tb.write_csv(rows.filter(even).select(*columns), f"{path}/even")
    tb.write_csv(rows.filter(~even).select(*columns[:0:-1], F.lit("a, b").alias("note, more")), f"{path}/odd")
    files = tb.csv_files(spark, f"{path}/even") + tb.csv_files(spark, f"{path}/odd")
    types = {"nav": "bigint", "total_units": "bigint", "nav_per_unit": "double"}
    return tb.read_csv_files(spark, files, types).withColumnRenamed("note, more", "note")


def _joined(spark, sf_dir):
    comp = _composition(spark, sf_dir).select(
        "Date", "nav", "nav_per_unit", "net_unit_change", "creation_unit", "equity_value_basket"
    )
    return ba.join_composition(ba.clean_basket(fx.raw_basket(spark, sf_dir)), comp)


@register
def composition_join(spark, sf_dir):
    """Basket rows with the composition of their day."""
    return _joined(spark, sf_dir).select(
        day("Date"), "stock", "shares", "market_value", "net_unit_change", "creation_unit", "equity_value_basket"
    )


@register
def basket_metrics(spark, sf_dir):
    """Weight, price, basket quantity and primary flow of each basket row."""
    m = ba.basket_metrics(_joined(spark, sf_dir))
    return m.select(
        day("Date"),
        "stock",
        half_even(F.col("weight_pct"), 8).alias("weight_pct"),
        half_even(F.col("price_per_share"), 6).alias("price_per_share"),
        "quantity",
        "net_primary_lot",
        half_even(F.col("primary_flow_vnd"), 0).alias("primary_flow_vnd"),
    )


def _shifted(spark, sf_dir):
    return ba.shifted_weights(ba.basket_metrics(_joined(spark, sf_dir)))


@register
def weight_shift(spark, sf_dir):
    """Volume and weight of the stock's previous day."""
    return _shifted(spark, sf_dir).select(
        day("Date"), "stock", "volume", half_even(F.col("weight"), 8).alias("weight")
    )


@register
def weight_dense(spark, sf_dir):
    """The same for every stock on every date."""
    return ba.dense_weights(_shifted(spark, sf_dir)).select(
        day("Date"), "stock", "volume", half_even(F.col("weight"), 8).alias("weight")
    )


@register
def weight_wide(spark, sf_dir):
    """One row per date with every stock there is, read back as rows."""
    rows = ba.long_from_maps(ba.wide_maps(_shifted(spark, sf_dir)))
    return rows.select(day("Date"), "stock", "volume", half_even(F.col("weight"), 8).alias("weight"))


@register
def wide_csv(spark, sf_dir):
    """The wide table as a CSV file with a header row of stocks and one of measures, read back as rows."""
    path = shared_dir(spark, "wide")
    tb.write_wide_csv(ba.wide_maps(_shifted(spark, sf_dir)), path)
    rows = tb.read_wide_csv(spark, path)
    return rows.select(day("Date"), "stock", "volume", half_even(F.col("weight"), 8).alias("weight"))


# ---- ingestion -------------------------------------------------------------


@register
def page_fields(spark, sf_dir):
    """Composition fields of every fund page."""
    rows = pg.composition_fields(fx.fund_pages(spark, sf_dir))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("requested_date", "data_date")})


@register
def holdings_rows(spark, sf_dir):
    """Holdings of every page with the page-level fields."""
    rows = pg.holdings_rows(fx.fund_pages(spark, sf_dir))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("requested_date", "data_date")})


@register
def cash_labels(spark, sf_dir):
    """The four cash positions of every page."""
    rows = pg.cash_labels(fx.fund_pages(spark, sf_dir))
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("requested_date", "data_date")})


@register
def fx_fill(spark, sf_dir):
    """Missing exchange rates filled from the pages; dates from file names."""
    files = fx.raw_basket(spark, sf_dir).select(
        F.concat(F.lit("E1_"), F.date_format("day", "yyyyMMdd"), F.lit(".csv")).alias("file"),
        "stock_code",
        "usd_to_twd",
        "usd_to_vnd",
    )
    basket = files.withColumn("Date", pg.date_of_file(F.col("file"))).drop("file")
    filled = pg.fill_rates(basket, pg.page_rates(fx.fund_pages(spark, sf_dir)))
    return filled.withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))


@register
def rates_written_back(spark, sf_dir):
    """A basket table stored by month after the pages' rates were written back to the days that lacked them."""
    path = shared_dir(spark, "baskets")
    rows = fx.raw_basket(spark, sf_dir).select(F.col("day").alias("Date"), "stock_code", "usd_to_twd", "usd_to_vnd")
    months = rows.withColumn("data_month", F.date_format("Date", "yyyyMM").cast("int"))
    months.repartition("data_month").write.partitionBy("data_month").parquet(path)
    tb.write_back_rates(pg.page_rates(fx.fund_pages(spark, sf_dir)), path, "data_month")
    stored = spark.read.parquet(path).drop("data_month")
    return stored.withColumn("Date", F.date_format("Date", "yyyy-MM-dd"))


@register
def rate_gaps(spark, sf_dir):
    """Days whose basket lacks the exchange rates."""
    return pg.dates_without_rates(ba.clean_basket(fx.raw_basket(spark, sf_dir))).select(day("Date"))


@register
def pages_to_weights(spark, sf_dir):
    """Fund pages to basket rows, to the previous day's volume and weight."""
    rows = weights_from_pages(fx.fund_pages(spark, sf_dir))
    return rows.select(day("Date"), "stock", "volume", half_even(F.col("weight"), 8).alias("weight"))


@register
def missing_dates(spark, sf_dir):
    """Calendar days whose file is not stored yet, with the weekend mark."""
    days = fx.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("data_date"))
    stored = days.filter(F.pmod(F.dayofmonth("data_date"), F.lit(2)) == 0)
    missing = pg.missing_dates(stored, F.min("data_date"), F.max("data_date"))
    return missing.select(day("data_date"), pg.is_weekend(F.col("data_date")).cast("int").alias("weekend"))


@register
def ingest_status(spark, sf_dir):
    """Requested dates per outcome."""
    verdicts = pg.ingest_status(fx.fund_pages(spark, sf_dir))
    return verdicts.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@register
def first_writer_sink(spark, sf_dir):
    """Pages written once per data date; a second write adds nothing."""
    path = shared_dir(spark, "compositions")
    rows = pg.composition_fields(fx.fund_pages(spark, sf_dir))
    weekdays = rows.filter(~pg.is_weekend(F.col("requested_date")))
    firsts = pg.first_pages(weekdays).select("data_date", "requested_date", "nav")
    tb.append_new_dates(firsts, path)
    tb.append_new_dates(firsts.withColumn("nav", F.lit("changed")), path)
    return tb.read_first_dates(spark, path).select(day("data_date"), day("requested_date"), "nav")


# ---- parameter search ------------------------------------------------------


def _hashed(i: int) -> Column:
    """Uniform numbers another engine can reproduce."""
    return F.pmod(F.col("param_id") * (7919 + 2 * i) + 104_729 * (i + 1), F.lit(10_007)) / 10_007.0


@register
def param_grid(spark, sf_dir):
    """A parameter set per order, over both stages' ranges."""
    ids = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("param_id"))
    both = {**sw.DETECTION_RANGES, **sw.BUCKET_RANGES}
    grid = sw.sample(ids, both, {}, _hashed)
    rounded = [c for c, t in grid.dtypes if t == "double"]
    return grid.withColumns({c: half_even(F.col(c), 9) for c in rounded})


def _trials(spark, sf_dir):
    k = F.col("n_nationkey")

    def pick(*values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(k, F.lit(len(values))).cast("int") + 1)

    params = fx.table(spark, sf_dir, "nation").select(
        k.cast("bigint").alias("param_id"),
        pick(16, 5, 25).alias("seconds_early"),
        pick(0.35, 0.25).alias("tolerance"),
        pick(45, 50, 60).alias("seconds_gap"),
        pick(2, 3, 4, 5, 9).alias("min_unique"),
        pick(2, 3, 4).alias("min_segment"),
        pick(0, 3, 4, 5).alias("core_threshold"),
        (0.02 + k / 100.0).alias("start"),
        (F.lit(50) + k).cast("double").alias("stop"),
        (F.lit(20) + k).cast("int").alias("num"),
        pick(0.25, 0.5).alias("step"),
        (1.0 + k / 50.0).alias("growth"),
        pick(3.0, 5.0, 9.0).alias("int_threshold"),
        pick(0.1, 0.25, 0.5).alias("first_center"),
    )
    m = fx.market(spark, sf_dir)
    evaluated = sw.evaluate(
        m.trades,
        m.quotes,
        m.weights,
        fx.reported_for_run_dates(spark, sf_dir),
        params,
        ["2024-01-01", "2024-01-02", "2024-01-03"],
        first_round=3,
    )
    return sw.trial_metrics(evaluated, params)


@register
def param_sweep(spark, sf_dir):
    """Error of each parameter set that found something on every date."""
    return _trials(spark, sf_dir).select("param_id", cents("mae"))


# Ranges that give results on the test tables.
SEARCH_RANGES = {**sw.DETECTION_RANGES, "min_unique": (2, 5, 1), "min_segment": (2, 4, 1), "core_threshold": (0, 4, 1)}


@register
def two_stage_search(spark, sf_dir):
    """All trials of a guided search: detection parameters, then bucket parameters with the best detection. Each stage learns
    its second batch from its first; a stage shows what it searches."""
    m, path = fx.market(spark, sf_dir), shared_dir(spark, "search")
    sw.two_stage(
        m.trades,
        m.quotes,
        m.weights,
        fx.reported_for_run_dates(spark, sf_dir),
        ["2024-01-01", "2024-01-02", "2024-01-03"],
        path,
        stage1_trials=10,
        stage2_trials=10,
        startup=6,
        batch=4,
        detection_ranges=SEARCH_RANGES,
        uniform=_hashed,
    )
    log = tb.stored_trials(spark, f"{path}/trials")
    shown = [F.when(F.col("stage") == stage, F.col(c)).alias(c) for stage, of in (("stage1", sw.DETECTION_RANGES), ("stage2", sw.BUCKET_RANGES)) for c in of]
    return log.select("stage", "param_id", *shown, "mae")


@register
def sweep_top10(spark, sf_dir):
    """The ten best parameter sets."""
    ranked = ev.top_trials(_trials(spark, sf_dir).withColumn("mae", half_even(F.col("mae"), 2)))
    return ranked.select("param_id", "tolerance", "seconds_gap", "min_unique", "min_segment", "mae")


@register
def best_per_stage(spark, sf_dir):
    """Trials logged, then the best of each of two groups kept."""
    path = shared_dir(spark, "trials")
    trials = _trials(spark, sf_dir).select(
        F.when(F.col("param_id") < 12, "stage1").otherwise("stage2").alias("stage"),
        "param_id",
        cents("mae"),
    )
    tb.append_trials(trials, path)
    return ev.best_per_stage(spark.read.parquet(path))


# ---- streaming -------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    return lv.table_stream(spark, f"{sf_dir}/events.parquet", schema)


@register
def stream_net_flow(spark, sf_dir):
    """Net flow per minute of a tick stream, final minutes only."""
    root = shared_dir(spark, "minute-flow")
    value = F.col("value") * F.col("volume")
    flows = fx.clocked_events(_event_stream(spark, sf_dir)).select(
        to_timestamp(F.col("ts_ns")).alias("ts"),
        F.when(F.col("event_type") == "click", value)
        .when(F.col("event_type") == "purchase", -value)
        .otherwise(0.0)
        .alias("signed_value"),
    )
    query = (
        lv.minute_flow(flows)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{root}/offsets")
        .trigger(availableNow=True)
        .start(f"{root}/out")
    )
    query.awaitTermination()
    out = spark.read.schema("minute timestamp, net_flow double, n bigint").parquet(f"{root}/out")
    return out.select(F.unix_micros("minute").alias("minute_us"), cents("net_flow"), "n")


@register
def stream_detect(spark, sf_dir):
    """The detection run minute by minute on a tick stream of six files, one a micro-batch."""
    folder, table = shared_dir(spark, "events"), fx.table(spark, sf_dir, "events")
    ends = table.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).first()
    for i in range(6):  # files are read in the order of their writing
        at = [ends["first"] + (ends["last"] - ends["first"]) * k / 6 for k in (i, i + 1)]
        part = table.filter((F.col("ts") >= at[0]) & (F.col("ts") < at[1] if i < 5 else F.col("ts") <= ends["last"]))
        part.coalesce(1).write.mode("append").parquet(folder)
    events = lv.parquet_stream(spark, folder, table.schema)
    weights = fx.weights(fx.table(spark, sf_dir, "events"))
    detector = lv.LiveDetector(shared_dir(spark, "live"), weights, PARAMS)
    clocked = fx.clocked_events(events)
    is_trade = F.col("event_type").isin(*fx.TRADE_EVENTS)
    ticks = clocked.filter(is_trade | F.col("event_type").isin(*fx.QUOTE_EVENTS)).select(
        "run_date",
        "stock",
        "ts_ns",
        "src_seq",
        is_trade.alias("is_trade"),
        F.when(is_trade, F.col("value")).alias("price"),
        F.when(is_trade, F.col("volume")).alias("volume"),
        F.when(~is_trade, F.col("value") * 0.999).alias("bid"),
        F.when(~is_trade, F.col("value") * 1.001).alias("ask"),
    )
    detector.start(ticks).awaitTermination()
    detector.flush(spark)
    return detection_columns(detector.detections(spark))
