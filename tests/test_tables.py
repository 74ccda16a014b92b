"""Sources, sinks, evaluation edges and the live stream."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from basketflow import fixtures as fx
from basketflow.functions.scalars import half_even, lenient_date
from basketflow.operators import basket as ba
from basketflow.operators import evaluation as ev
from basketflow.operators import ticks as tk
from basketflow.params import DetectionParams
from basketflow.plans.detect import RESULT, detect_flow, result_layout
from basketflow.plans import sweep as sw
from basketflow.sources import pages as pg
from basketflow.sources import tables as tb
from basketflow.streaming.live import LiveDetector, parquet_stream, tick_rows

SF = "/root/testdata/sf0.001"


def test_csv_union_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text("y,x,z\n3,4,hello\n")
    files = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    rows = tb.read_csv_files(spark, files, {"x": "int", "y": "int"}).orderBy("x").collect()
    assert [(r.x, r.y, r.z) for r in rows] == [(1, 2, None), (4, 3, "hello")]
    assert tb.read_csv_files(spark, [], {"x": "int"}).collect() == []


def test_first_writer_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda v: spark.createDataFrame(v, "data_date date, v int")
    tb.append_new_dates(rows([(date(2024, 1, 1), 1)]), path)
    tb.append_new_dates(rows([(date(2024, 1, 1), 9), (date(2024, 1, 2), 2)]), path)
    assert sorted(r.v for r in tb.read_first_dates(spark, path).collect()) == [1, 2]


def test_two_writers_at_once_leave_one_of_them(spark, tmp_path, monkeypatch):
    """Both look before either has written, so both write the shared day."""
    schema = "etf_code string, data_date date, v int"
    first = [("E", date(2024, 1, 1), 1), ("E", date(2024, 1, 1), 2), (None, date(2024, 1, 3), 3)]
    second = [("E", date(2024, 1, 1), 7), ("E", date(2024, 1, 2), 8), ("F", date(2024, 1, 1), 9)]
    path, best = str(tmp_path / "t"), str(tmp_path / "best")
    seen = tb._exists
    monkeypatch.setattr(tb, "_exists", lambda *_: False)
    for rows in (first, second):
        tb.append_new_dates(spark.createDataFrame(rows, schema), path)
    for param_id, mae in ((1, 3.0), (2, 2.0), (3, 2.0), (4, None)):
        tb.upsert_best(spark.createDataFrame([("stage1", param_id, mae)], "stage string, param_id int, mae double"), best)
    assert spark.read.parquet(path).count() == 6
    assert sorted(r.v for r in tb.read_first_dates(spark, path).collect()) == [1, 2, 3, 8, 9]
    assert [(r.stage, r.param_id, r.mae) for r in tb.read_best(spark, best).collect()] == [("stage1", 2, 2.0)]
    monkeypatch.setattr(tb, "_exists", seen)
    tb.append_new_dates(spark.createDataFrame(second, schema), path)
    tb.upsert_best(spark.createDataFrame([("stage1", 5, 2.0), ("stage2", 6, 1.0), ("stage2", 7, 0.5)], "stage string, param_id int, mae double"), best)
    assert sorted(r.v for r in tb.read_first_dates(spark, path).collect()) == [1, 2, 3, 8, 9]
    assert {(r.stage, r.param_id) for r in tb.read_best(spark, best).collect()} == {("stage1", 2), ("stage2", 7)}


def test_result_sink_replaces_only_its_dates(spark, tmp_path):
    m = fx.market(spark, SF, 3000)
    out = result_layout(detect_flow(m.trades, m.quotes, m.weights, DetectionParams(min_unique=2, min_segment=2, core_threshold=2)))
    path = str(tmp_path / "r")
    tb.write_results(out, path)
    n = spark.read.parquet(path).count()
    tb.write_results(out.filter("run_date = '2024-01-01'"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == n == out.count() and n > 0
    assert set(RESULT) <= set(stored.columns)


def test_rounding_and_dates(spark):
    df = spark.createDataFrame([(0.00005, "2024/02/30"), (0.00015, "2024-02-29"), (0.00025, "2024/02/28")], "x double, d string")
    rows = df.select(half_even(F.col("x"), 4).alias("r"), lenient_date(F.col("d")).alias("d")).collect()
    assert [r.r for r in rows] == [0.0, 0.0001, 0.0002]
    assert [r.d for r in rows] == [None, date(2024, 2, 29), date(2024, 2, 28)]


def test_duplicate_weights_fail(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "A", 1.0, 1.0)] * 2, "Date date, stock string, volume double, weight double")
    with pytest.raises(Exception, match="duplicate weight row"):
        ba.dense_weights(df).collect()


def test_wide_and_back(spark):
    df = spark.createDataFrame(
        [(date(2024, 1, 1), "A", 1.0, 0.5), (date(2024, 1, 2), "B", 2.0, 0.6)],
        "Date date, stock string, volume double, weight double",
    )
    back = ba.long_from_wide(ba.wide_weights(df, ["A", "B"]), ["A", "B"])
    dense = ba.dense_weights(df).select(*back.columns)
    key = lambda r: (r.Date, r.stock)
    assert sorted(back.collect(), key=key) == sorted(dense.collect(), key=key)


def test_mae_edges(spark):
    pred = spark.createDataFrame([(1, 10.0), (2, None), (3, 5.0)], "Date int, net_flow double")
    rep = spark.createDataFrame([(1, 4.0), (2, 1.0)], "Date int, primary_flow_vnd double")
    assert ev.flow_mae(pred, rep).first().mae == 6.0
    assert ev.flow_mae(pred, rep.filter("Date > 5")).first().mae is None


def test_hpd_without_a_run(spark):
    h = spark.createDataFrame([(1, 0, 0.0, 1.0, 0), (1, 1, 1.0, 2.0, 0)], "similarity int, bin int, bin_left double, bin_right double, count long")
    row = ev.hpd_range(h).first()
    assert (row.lower_bound, row.obs_in_range, row.total_obs) == (None, 0, 0)


def test_quantiles_with_negative_and_equal_values(spark):
    values = [-3.0, -0.5, 0.0, 0.0, 2.0, 2.0, 2.0, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    import numpy as np

    row = ev.exact_quantiles(df, "v", {"a": 0.1, "b": 0.5, "c": 0.999}).first()
    for got, p in ((row.a, 0.1), (row.b, 0.5), (row.c, 0.999)):
        assert got == pytest.approx(np.quantile(values, p))


def test_quantiles_of_values_close_together(spark):
    """Many values in a narrow range, and a weight: the ranked values are a small part of all."""
    import numpy as np

    df = spark.range(20_000).selectExpr("id % 2 AS k", "1e6 + (id * 7919 % 20011) / 200110.0 AS v", "1 + id % 3 AS c")
    pdf = df.toPandas()
    got = {r.k: r for r in ev.exact_quantiles(df, "v", {"a": 0.001, "b": 0.5}, ("k",), weight="c").collect()}
    for k in (0, 1):
        part = pdf[pdf.k == k]
        values = np.repeat(part.v.to_numpy(), part.c.to_numpy())
        assert got[k].n == len(values)
        assert got[k].a == pytest.approx(np.quantile(values, 0.001), abs=1e-9)
        assert got[k].b == pytest.approx(np.quantile(values, 0.5), abs=1e-9)


def test_best_keeps_the_stored_one_on_a_tie(spark):
    schema = "stage string, param_id bigint, mae double"
    new = spark.createDataFrame([("s", 1, 2.0), ("s", 2, float("nan")), ("s", 3, None)], schema)
    old = spark.createDataFrame([("s", 9, 2.0)], schema)
    assert [r.param_id for r in ev.best_per_stage(new, old).collect()] == [9]


def test_page_without_total_and_with_separators(spark):
    html = (
        "<table class='table1 wide'><tr><th>h</th></tr><tr><td>VIC VN</td><td>V&amp;C</td><td>1,000</td>"
        "<td>2,000</td><td>3.5%</td></tr><tr><td>short</td></tr></table><p>1 USD = 25,345.5 VND</p>"
    )
    pages = spark.createDataFrame([(date(2024, 1, 1), html)], "requested_date date, html string")
    (r,) = pg.holdings_rows(pages).collect()
    assert (r.stock_name, r.shares, r.weight_pct, r.usd_to_vnd) == ("V&C", "1000", "3.5", 25345.5)
    assert r.total_weight is None and r.usd_to_twd is None and r.data_date == date(2024, 1, 1)


def test_live_equals_batch(spark, tmp_path):
    m = fx.market(spark, SF, 3000)
    params = DetectionParams(min_unique=2, min_segment=2, core_threshold=2)
    ticks = tick_rows(m.trades, m.quotes).cache()
    bounds = ticks.select(F.percentile("ts_ns", F.array(F.lit(0.0), F.lit(0.4), F.lit(0.7), F.lit(1.0))).alias("p")).first().p
    folder = str(tmp_path / "in")
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = ticks.filter((F.col("ts_ns") >= lo if i == 0 else F.col("ts_ns") > lo) & (F.col("ts_ns") <= hi))
        part.coalesce(1).write.mode("append").parquet(folder)
    live = LiveDetector(str(tmp_path / "state"), m.weights, params)
    live.start(parquet_stream(spark, folder, ticks.schema)).awaitTermination()
    live.flush(spark)
    keys = ["run_date", "time_str", "stock", "side", "initial_ts_ns", "segment_ids", "no_similarity_stock"]
    want = detect_flow(m.trades, m.quotes, m.weights, params).select(*keys).collect()
    got = live.detections(spark).select(*keys).collect()
    assert sorted(got) == sorted(want) and want


def test_live_state_stays_small_and_batches_repeat(spark, tmp_path):
    """Over many batches the stored ticks, keys and progress stay within the look-back; a repeated last batch and a stream that
    goes on after a flush change nothing."""
    m = fx.market(spark, SF, 3000)
    params = DetectionParams(min_unique=2, min_segment=2, core_threshold=2)
    ticks = tick_rows(m.trades, m.quotes).cache()
    first_day = ticks.agg(F.min("run_date")).first()[0]
    ticks = ticks.filter(F.col("run_date") == first_day).cache()
    bounds = ticks.select(F.percentile("ts_ns", F.array(*[F.lit(k / 8) for k in range(9)])).alias("p")).first().p
    live, root = LiveDetector(str(tmp_path / "state"), m.weights, params), tmp_path / "state"

    def stored(name):
        return sorted(p.name for p in (root / name).iterdir() if "=" in p.name) if (root / name).exists() else []

    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        part = ticks.filter((F.col("ts_ns") >= lo if i == 0 else F.col("ts_ns") > lo) & (F.col("ts_ns") <= hi))
        live.process(part, i)
        if i == 4:
            live.flush(spark)
            assert (root / "flushed").exists()
        if i in (5, 7):
            live.process(part, i)
        newest, closed, last = live._progress(spark, i + 1)
        assert last == i and len(stored("progress")) <= 2 and not (i != 4 and (root / "flushed").exists())
        kept = [int(p.split("=")[1]) for p in stored("ticks")]
        assert len(kept) <= 2 + (hi - lo) // live.slot_ns + 2
    live.flush(spark)
    keys = ["run_date", "time_str", "stock", "side", "initial_ts_ns", "segment_ids", "no_similarity_stock"]
    want = detect_flow(*[t.filter(F.col("run_date") == first_day) for t in (m.trades, m.quotes, m.weights)], params).select(*keys).collect()
    got = live.detections(spark).select(*keys).collect()
    assert sorted(got) == sorted(want) and want


def test_two_stage_search_logs_and_resumes(spark, tmp_path, monkeypatch):
    ranges = {**sw.DETECTION_RANGES, "min_unique": (2, 3, 1), "min_segment": (2, 3, 1), "core_threshold": (0, 2, 1)}
    monkeypatch.setattr(sw, "DETECTION_RANGES", ranges)
    m = fx.market(spark, SF, 3000)
    args = (m.trades, m.quotes, m.weights, fx.reported_for_run_dates(spark, SF), ["2024-01-01", "2024-01-02"], str(tmp_path))
    best = {r.stage: r for r in sw.two_stage(*args, stage1_trials=3, stage2_trials=2).collect()}
    assert set(best) == {"stage1", "stage2"}
    assert all(best["stage2"][c] == best["stage1"][c] for c in ranges)
    logged = spark.read.parquet(str(tmp_path / "trials")).count()
    sw.two_stage(*args, stage1_trials=3, stage2_trials=2)
    spark.catalog.clearCache()
    assert spark.read.parquet(str(tmp_path / "trials")).count() == logged
    tb.upsert_best(spark.createDataFrame([("stage1", 1, 2.0)], "stage string, param_id int, mae double"), str(tmp_path / "best"))
    tb.upsert_best(spark.createDataFrame([("stage2", 4, 1.0)], "stage string, param_id int, mae double"), str(tmp_path / "best"))
    assert spark.read.parquet(str(tmp_path / "best")).count() == 2
    tb.upsert_best(spark.createDataFrame([("stage1", 9, 5.0)], "stage string, param_id int, mae double"), str(tmp_path / "best"))
    assert {(r.stage, r.param_id, r.mae) for r in spark.read.parquet(str(tmp_path / "best")).collect()} == {("stage1", 1, 2.0), ("stage2", 4, 1.0)}


def test_readers_give_the_engine_columns(spark, tmp_path):
    raw = spark.createDataFrame(
        [("A", 1, 2.0, 3.0, "2024-01-01"), ("B", 2, 2.5, 4.0, "2024-01-02")],
        "symbol string, ts bigint, c double, mv double, run_date string",
    )
    raw.write.partitionBy("run_date").parquet(str(tmp_path / "ticks"))
    (row,) = tb.as_trades(tb.read_ticks(spark, str(tmp_path / "ticks"), ["2024-01-02"])).collect()
    assert (row.run_date, row.stock, row.ts_ns, row.price, row.volume) == (date(2024, 1, 2), "B", 2, 2.5, 4.0)
    book = raw.select("symbol", "ts", F.col("c").alias("bb0_p"), F.col("mv").alias("bo0_p"), "run_date")
    book.write.partitionBy("run_date").parquet(str(tmp_path / "book"))
    quotes = tb.as_quotes(tb.read_ticks(spark, str(tmp_path / "book"))).orderBy("ts_ns").collect()
    assert [(q.bid, q.ask) for q in quotes] == [(2.0, 3.0), (2.5, 4.0)]
    w = spark.createDataFrame([("2024-01-01", "A", 100.0, 0.1)], "Date string, stock string, volume double, weight double")
    assert tb.as_weights(w).first().run_date == date(2024, 1, 1)


def test_funds_keep_their_own_days(spark, tmp_path):
    path = str(tmp_path / "funds")

    def rows(fund, value):
        return spark.createDataFrame([(fund, date(2024, 1, 1), value)], "etf_code string, data_date date, v int")

    for fund, value in (("E1", 1), ("E2", 2), ("E1", 9)):
        tb.append_new_dates(rows(fund, value), path)
    assert {(r.etf_code, r.v) for r in spark.read.parquet(path).collect()} == {("E1", 1), ("E2", 2)}


def test_all_stocks_become_columns(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), s, 1.0, 0.5) for s in "CAB"], "Date date, stock string, volume double, weight double")
    assert ba.wide_weights(df).columns == ["Date", "A_volume", "A_weight", "B_volume", "B_weight", "C_volume", "C_weight"]
    with pytest.raises(ValueError, match="more than 2"):
        ba.all_stocks(df, 2)
    with pytest.raises(Exception, match="duplicate weight row"):
        ba.wide_weights(df.unionByName(df)).collect()


def test_weight_wide_of_very_many_stocks(spark, monkeypatch):
    from basketflow.plans import registered

    rows = spark.range(2500).selectExpr("date'2024-01-01' AS Date", "concat('S', id) AS stock", "CAST(id AS double) AS volume", "id / 7 AS weight")
    rows = rows.unionByName(rows.where("stock IN ('S3', 'S2400')").withColumn("Date", F.expr("date'2024-01-02'")))
    monkeypatch.setattr(registered, "_shifted", lambda spark, sf_dir: rows)
    wide, dense = (sorted(map(tuple, registered.QUERIES[q](spark, "").collect()), key=lambda r: r[:2]) for q in ("weight_wide", "weight_dense"))
    assert len(wide) == 5000 and wide == dense
    with pytest.raises(Exception, match="duplicate weight row"):
        ba.wide_maps(rows.unionByName(rows)).collect()


def test_nested_table_and_entities(spark):
    from basketflow.functions.text import elements_of_class, visible_text

    html = '<table class="layout"><tr><td><table class="x table1"><tr><td>V&#233;&nbsp;N&rsquo;x &#x41;&amp;B</td></tr></table></td></tr></table>'
    row = spark.createDataFrame([(html,)], "h string").select(elements_of_class(F.col("h"), "table", "table1").alias("t"), visible_text(F.col("h")).alias("x")).first()
    assert len(row.t) == 1 and row.t[0].startswith('<table class="x table1">')
    assert row.x == "V\u00e9 N\u2019x A&B"


@pytest.mark.parametrize(
    "html,want",
    [
        ("<td>a</td><td>b</td>", ["<td>a</td>", "<td>b</td>"]),
        ("x<TD a='1'>a<td >b</td >c</TD>y", ["<TD a='1'>a<td >b</td >c</TD>", "<td >b</td >"]),
        ("</td><td>a</td></td><td>b", ["<td>a</td>", "<td>b"]),
        ("<td>a<td>b</td>", ["<td>a<td>b</td>", "<td>b</td>"]),
        ("<tdx>a</tdx><td/>", ["<td/>"]),
        ("", []),
        ("plain", []),
        (None, None),
    ],
)
def test_elements_are_balanced(spark, html, want):
    from basketflow.functions.text import elements

    assert spark.createDataFrame([(html,)], "h string").select(elements(F.col("h"), "td")).first()[0] == want


def test_holdings_with_inner_tables(spark):
    """Inner tables in a cell neither end the table nor the row; inside comments tags are none."""
    from basketflow.sources.pages import holdings_rows

    inner = "<table><tr><td>1</td><td>2</td></tr></table>"
    rows = "".join(f"<tr><td>{c} VN</td><td>n{c}</td><td>1,000</td><td>5</td><td>9%</td><td>{inner}</td></tr>" for c in ("VIC", "VHM"))
    html = f"<!-- <table class='table1'> --><table class='a table1'><tr><th>Code</th></tr>{rows}<tr><td>Total</td><td></td><td></td><td>7</td><td>100%</td></tr></table>"
    df = spark.createDataFrame([(date(2024, 1, 2), html)], "requested_date date, html string")
    got = holdings_rows(df).select("stock_code", "stock_name", "shares", "weight_pct", "total_market_value").collect()
    assert sorted(map(tuple, got)) == [("VHM VN", "nVHM", "1000", "9", "7"), ("VIC VN", "nVIC", "1000", "9", "7")]


def test_folder_table_as_stream(spark, tmp_path):
    from basketflow.streaming.live import table_stream

    spark.range(20).repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "one"))
    (part,) = (tmp_path / "one").glob("part-*")
    (tmp_path / "flat").mkdir()
    part.rename(tmp_path / "flat" / "events.parquet")
    for name, n in ((".", 20), ("flat", 5)):
        out = str(tmp_path / f"out{n}")
        stream = table_stream(spark, str((tmp_path / name).resolve() / "events.parquet"), "id long")
        stream.writeStream.format("parquet").option("checkpointLocation", out + "-c").trigger(availableNow=True).start(out).awaitTermination()
        assert spark.read.parquet(out).count() == n


def test_csv_ticks_keep_the_order_of_equal_times(spark, tmp_path):
    """A file that Spark cuts into many blocks; all quotes have one time, so that only their order decides."""
    lines = ["other,symbol,ts,bb0_p,bo0_p"] + [f"x,A,7,{i},{i + 1}" for i in range(20000)] + ["x,A,7,19.5,"]
    (tmp_path / "book").mkdir()
    (tmp_path / "book" / "2024-01-01.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "book" / "2024-01-02.csv").write_text("other,symbol,ts,bb0_p,bo0_p\nx,A,7,n/a,2\n")
    (tmp_path / "tick").mkdir()
    (tmp_path / "tick" / "2024-01-01.csv").write_text("symbol,ts,c,mv\nA,8,1.5,10\n")
    types = {"ts": "bigint", "bb0_p": "double", "bo0_p": "double"}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        first = tb.read_tick_csv(spark, str(tmp_path / "book/{date}.csv"), types, ["2024-01-01"])
        assert first.rdd.getNumPartitions() > 5
        placed = first.orderBy("src_seq").select("bb0_p").collect()
        assert [r.bb0_p for r in placed] == [*map(float, range(20000)), 19.5]
        ticks = tb.read_tick_csv(spark, str(tmp_path / "tick/{date}.csv"), {"ts": "bigint", "c": "double", "mv": "double"})
        (row,) = tk.asof_quotes(tb.as_trades(ticks), tb.as_quotes(first)).collect()
        assert (row.run_date, row.bid, row.ask) == (date(2024, 1, 1), 19.5, None)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    both = tb.read_tick_csv(spark, str(tmp_path / "book/{date}.csv"), types)
    (late,) = both.filter("run_date = '2024-01-02'").collect()
    assert (late.stock, late.bb0_p, late.bo0_p) == ("A", None, 2.0) and both.count() == 20002
    (tmp_path / "book" / "2024-01-03.csv").write_text("symbol,other,ts,bb0_p,bo0_p\nA,x,7,1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tb.read_tick_csv(spark, str(tmp_path / "book/{date}.csv"), types, ["2024-01-01", "2024-01-03"]).collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tb.read_tick_csv(spark, str(tmp_path / "book/{date}.csv"), types, ["2024-01-09"]).collect()


def test_rates_are_written_back_to_their_days_only(spark, tmp_path):
    path = tmp_path / "baskets"
    rows = [(date(2024, 1, 1), "A", None, None), (date(2024, 1, 1), "B", None, None), (date(2024, 1, 2), "A", 30.0, 25000.0), (date(2024, 1, 3), "A", None, None)]
    spark.createDataFrame(rows, "Date date, stock_code string, usd_to_twd double, usd_to_vnd double").write.partitionBy("Date").parquet(str(path))
    rates = spark.createDataFrame(
        [(date(2024, 1, 1), 31.0, None), (date(2024, 1, 2), 99.0, 99.0), (date(2024, 1, 3), None, None)],
        "requested_date date, usd_to_twd double, usd_to_vnd double",
    )

    def files():
        return {d: sorted((p.name, p.stat().st_mtime_ns) for p in (path / f"Date=2024-01-0{d}").glob("part-*")) for d in (1, 2, 3)}

    before = files()
    for _ in range(2):
        tb.write_back_rates(rates, str(path))
        got = spark.read.parquet(str(path)).select("Date", "stock_code", "usd_to_twd", "usd_to_vnd").collect()
        assert sorted((r.Date.day, r.stock_code, r.usd_to_twd, r.usd_to_vnd) for r in got) == [(1, "A", 31.0, None), (1, "B", 31.0, None), (2, "A", 30.0, 25000.0), (3, "A", None, None)]
        after = files()
        assert after[1] != before[1] and (after[2], after[3]) == (before[2], before[3])


def test_csv_results_are_replaced_by_date(spark, tmp_path):
    m = fx.market(spark, SF, 3000)
    out = result_layout(detect_flow(m.trades, m.quotes, m.weights, DetectionParams(min_unique=2, min_segment=2, core_threshold=2)))
    for form in ("csv", "parquet"):
        path = str(tmp_path / form)
        tb.write_results(out, path, form)
        tb.write_results(out.filter("run_date = '2024-01-01'"), path, form)
        stored = tb.read_results(spark, path, out, form)
        assert stored.dtypes == out.dtypes
        assert sorted(map(str, stored.collect())) == sorted(map(str, out.collect())) != []


def test_wide_csv_has_two_headers(spark, tmp_path):
    rows = [(date(2024, 1, d), s, float(d), d / 7) for d, s in ((1, "A"), (1, 'B,"x"'), (2, "C"), (3, "A"))]
    df = spark.createDataFrame(rows + [(date(2024, 1, 2), "A", None, None)], "Date date, stock string, volume double, weight double")
    path = str(tmp_path / "wide")
    tb.write_wide_csv(ba.wide_maps(df), path)
    text = [line for p in sorted((tmp_path / "wide").glob("part-*")) for line in p.read_text().splitlines()]
    assert text[:2] == [',A,A,"B,""x""","B,""x""",C,C', "Date,volume,weight,volume,weight,volume,weight"]
    assert [line.split(",")[0] for line in text[2:]] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert text[3].split(",")[1:5] == [""] * 4
    key = lambda r: r[:2]
    want = sorted(map(tuple, ba.dense_weights(df).select("Date", "stock", "volume", "weight").collect()), key=key)
    assert sorted(map(tuple, tb.read_wide_csv(spark, path).collect()), key=key) == want and len(want) == 9
    # Columns in another order, measures apart.
    (tmp_path / "other.csv").write_text(",B,A,A\nDate,weight,weight,volume\n2024-01-01,0.5,,3\n")
    got = sorted(map(tuple, tb.read_wide_csv(spark, str(tmp_path / "other.csv")).collect()), key=key)
    assert got == [(date(2024, 1, 1), "A", 3.0, None), (date(2024, 1, 1), "B", None, 0.5)]
    tb.write_wide_csv(ba.wide_maps(df.limit(0)), path)
    assert tb.read_wide_csv(spark, path).collect() == []


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dense_weights_neither_join_nor_sort_the_grid(spark):
    """Rows of no date, of no stock, gaps on all sides. No exchange or join has the days of a stock."""
    d = [date(2024, 1, i) for i in range(1, 6)]
    rows = [(d[1], "A", 1.0, 0.1), (d[3], "A", 2.0, 0.2), (d[0], "B", 3.0, None), (None, "C", 4.0, 0.4), (None, "C", 4.0, 0.4)]
    rows += [(None, "A", 5.0, 0.5), (d[4], None, 6.0, 0.6), (d[4], None, 7.0, 0.7), (d[0], None, 8.0, 0.8)]
    df = spark.createDataFrame(rows, "Date date, stock string, volume double, weight double").repartition(3)
    known = {(r[0], r[1]): r[2:] for r in rows if r[0] and r[1]}
    want = [(day, s, *known.get((day, s), (None, None))) for day in (d[0], d[1], d[3], d[4]) for s in ("A", "B", "C", None)]
    got = ba.dense_weights(df)
    assert got.columns == ["Date", "stock", "volume", "weight"]
    key = lambda r: (r[0], r[1] or "")
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    wide = sorted(map(tuple, ba.long_from_maps(ba.wide_maps(df)).collect()), key=key)
    assert wide == sorted((r for r in want if r[1]), key=key)
    for made in (ba.dense_weights, ba.wide_maps):
        assert made(df.limit(0)).collect() == []
        assert "SortMergeJoin" not in plan_of(made(df))
    with pytest.raises(Exception, match="duplicate weight row: B"):
        ba.dense_weights(df.unionByName(df.filter("stock = 'B'"))).collect()


def test_wide_csv_of_odd_lines(spark, tmp_path):
    """Short and long lines, two lines of a date, two columns of a stock's measure, names with marks, no rows of a date shuffled."""
    (tmp_path / "odd.csv").write_text(
        ',A,A,"B,""x""",A,C\nDate,volume,weight,weight,volume,other\n'
        "2024-01-01,1,0.1,0.2,3,9\n2024-01-02,5,x\n2024-01-03,1,,2,,,,7\n"
        '2024-01-04,1,2,3,,\n"2024-01-04",4,,1,2,\n'
    )
    got = {(str(r[0]), r[1]): tuple(r[2:]) for r in tb.read_wide_csv(spark, str(tmp_path / "odd.csv")).collect()}
    b = 'B,"x"'
    assert got == {
        ("2024-01-01", "A"): (3.0, 0.1), ("2024-01-01", b): (None, 0.2), ("2024-01-01", "C"): (None, None),
        ("2024-01-02", "A"): (5.0, None), ("2024-01-02", b): (None, None),
        ("2024-01-03", "A"): (1.0, None), ("2024-01-03", b): (None, 2.0), ("2024-01-03", "C"): (None, None), ("2024-01-03", None): (None, None),
        ("2024-01-04", "A"): (4.0, 2.0), ("2024-01-04", b): (None, 3.0), ("2024-01-04", "C"): (None, None),
    }


def test_wide_csv_is_made_once(spark, tmp_path):
    """The wide rows are computed by one pass, not again for the headers and the order."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(date(2024, 1, i), "A", 1.0, 0.5) for i in range(1, 8)], "Date date, stock string, volume double, weight double")
    wide = ba.wide_maps(df).mapInArrow(counted, "Date date, stocks map<string, struct<volume: double, weight: double>>")
    tb.write_wide_csv(wide, str(tmp_path / "wide"))
    assert seen.value == 7
    assert tb.read_wide_csv(spark, str(tmp_path / "wide")).count() == 7


def test_lenient_dates(spark):
    texts = ["2024-01-02", " 2024/01/02 ", "2024/1/2", "2024-01/02", "n/a", "", None, "2024-13-01", "2024/13/01"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(lenient_date(F.col("t"))).collect()
    assert [str(r[0]) for r in rows] == ["2024-01-02", "2024-01-02", *["None"] * 7]
