"""The parameter search: counts from one join, dates in rounds, guided batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketflow import fixtures as fx
from basketflow.operators import similarity as si
from basketflow.params import Calendar
from basketflow.plans import sweep as sw
from test_detection import blocks

SF = "/root/testdata/sf0.001"
CALENDAR = Calendar()


@pytest.mark.parametrize("seed", [3, 4])
def test_stairs_give_the_counts_of_every_smaller_set(spark, seed):
    """One join at the widest set serves all others, ends and ties included; its rows do not depend on their number."""
    masked = si.snapshot_masks(blocks(spark, 160, seed, 300)).cache()
    near = si.neighbour_stairs(masked, 0.5, 60).cache()
    assert near.count() == masked.count()
    sets = [(0.0, 1), (0.1, 7), (0.25, 30), (0.3633, 45), (0.5, 60)]
    table = spark.createDataFrame(sets, "tolerance double, seconds_gap int")
    rows = near.join(F.broadcast(table))
    got = si.counts_within(rows, F.col("tolerance"), F.col("seconds_gap"), CALENDAR, "run_date", "tolerance", "seconds_gap")
    for tolerance, gap in sets:
        want = si.neighbour_counts(masked, tolerance, gap, CALENDAR)
        mine = got.filter((F.col("tolerance") == tolerance) & (F.col("seconds_gap") == gap)).select(*want.columns)
        assert mine.exceptAll(want).count() == 0 and want.exceptAll(mine).count() == 0


def sets_of(spark, rows):
    ids = spark.createDataFrame(rows, "param_id long, min_unique int")
    params = sw.sample(ids, {}, {**{k: v for k, v in DETECTION.items() if k != "min_unique"}, **sw.STAGE1_BUCKETS}, sw.hashed_uniform(1), "min_unique")
    return params


DETECTION = {"seconds_early": 16, "tolerance": 0.35, "seconds_gap": 60, "min_unique": 2, "min_segment": 2, "core_threshold": 0}


def test_a_set_that_finds_nothing_leaves_before_the_next_round(spark):
    m = fx.market(spark, SF, 3000)
    dates = [str(r[0]) for r in m.weights.select("run_date").distinct().orderBy("run_date").collect()][:2] + ["2099-01-01"]
    params = sets_of(spark, [(1, 2), (2, 500)])
    prepared = sw.prepare_rows(m.trades, m.quotes, m.weights, dates, 0.35, 60)
    reported = fx.reported_for_run_dates(spark, SF)
    rows = {(r.param_id, str(r.run_date)): r.net_flow for r in sw.evaluate_prepared(prepared, reported, params, dates).collect()}
    real = dates[:2]
    assert (2, real[0]) in rows and rows[2, real[0]] is None and (2, real[1]) not in rows
    assert all((1, d) in rows for d in real) and not any(d == "2099-01-01" for _, d in rows)
    whole = sw.evaluate_prepared(prepared, reported, params, dates, first_round=3)
    assert {(r.param_id, str(r.run_date)): r.net_flow for r in whole.filter("param_id = 1").collect()} == {k: v for k, v in rows.items() if k[0] == 1}
    same = [sw.trial_metrics(e, params).select("param_id", "mae").collect() for e in (sw.evaluate_prepared(prepared, reported, params, dates), whole)]
    assert same[0] == same[1]


def test_date_rounds():
    assert sw.date_rounds(["d3", "d1", "d2", "d1", "d4"]) == [["d1"], ["d2", "d3"], ["d4"]]
    assert sw.date_rounds(["d1", "d2", "d3"], 3) == [["d1", "d2", "d3"]] and sw.date_rounds([]) == []


def errors(params):
    """A known error with its least value at 0.2, 7 and 55; sets far off find nothing."""
    mae = F.abs(F.col("tolerance") - 0.2) * 40 + F.abs(F.col("min_unique") - 7) + F.abs(F.col("stop") - 55) / 3
    return params.withColumn("mae", F.when(mae < 25, mae))


RANGES = {"tolerance": (0.12, 0.35, 0), "min_unique": (2, 24, 1), "stop": (50, 100, 1)}


@pytest.mark.parametrize("seed", [1, 42])
def test_guided_batches_are_better_than_even_draws(spark, tmp_path, seed):
    log = str(tmp_path / "log")

    def best():
        return spark.read.parquet(log).agg(F.min("mae")).first()[0]

    sw.search_stage(log, "s", RANGES, {}, 24, errors, spark, startup=12, batch=6, seed=seed)
    rows = spark.read.parquet(log)
    assert sorted(r.param_id for r in rows.select("param_id").collect()) == list(range(24))
    even = sw.sample(spark.range(24).withColumnRenamed("id", "param_id"), RANGES, {}, sw.hashed_uniform(seed))
    assert best() < errors(even).agg(F.min("mae")).first()[0]
    # The later batches are better on the whole, and within the ranges and steps.
    late = rows.filter("param_id >= 12")
    assert late.agg(F.avg("mae")).first()[0] < rows.filter("param_id < 12").agg(F.avg("mae")).first()[0]
    assert late.filter("tolerance NOT BETWEEN 0.12 AND 0.35 OR stop NOT BETWEEN 50 AND 100 OR stop <> rint(stop)").count() == 0


def test_a_search_goes_on_where_it_was(spark, tmp_path):
    whole, cut = str(tmp_path / "whole"), str(tmp_path / "cut")
    sw.search_stage(whole, "s", RANGES, {}, 14, errors, spark, startup=6, batch=4)
    calls = []

    def counted(params):
        calls.append(params.count())
        return errors(params)

    sw.search_stage(cut, "s", RANGES, {}, 10, errors, spark, startup=6, batch=4)
    sw.search_stage(cut, "s", RANGES, {}, 14, counted, spark, startup=6, batch=4)
    assert calls == [4]
    spark.catalog.clearCache()
    assert sorted(spark.read.parquet(cut).collect()) == sorted(spark.read.parquet(whole).collect())


def test_a_search_without_any_result_draws_evenly_on(spark, tmp_path):
    log = str(tmp_path / "log")
    sw.search_stage(log, "s", RANGES, {}, 8, lambda p: p.withColumn("mae", F.lit(None).cast("double")), spark, startup=4, batch=4)
    assert spark.read.parquet(log).filter("mae IS NULL").count() == 8


def test_steps_of_a_row_grow_with_records_not_with_pairs(spark):
    """Of a stock's similar rows only those nearer in lots than all before them are kept, however many rows ask at once."""
    n = 600
    # One stock asks in one second, another follows with ever more distant lots, then with one nearer: two steps a row.
    rows = [(0, "A", 100.0, 0)] + [(1 + k // 12, "B", 101.0 + k / 100, 1 + k % 12) for k in range(n)] + [(55, "B", 100.5, 0)]
    masked = spark.createDataFrame(
        [("d", 1, s, 0, stock, 1.0 + q, 1.0, 1.0, s * 10**9, lot, s * 10**9, 1) for s, stock, lot, q in rows],
        "run_date string, side int, sec long, time_str int, stock string, quantity double, matched_vol double, matched_value double,"
        " ts_ns long, num_lot double, block_start_ns long, mask long",
    )
    near = si.neighbour_stairs(masked, 0.5, 60)
    kept = near.filter("stock = 'A'").select(F.explode(F.arrays_zip("near.stock", "near.after_ns", "near.lot")).alias("s")).select("s.*").collect()
    per_stock = {}
    for r in kept:
        per_stock.setdefault(r.stock, []).append((r.after_ns // 10**9, r.lot))
    assert sorted(per_stock.values()) == [[(0, 100.0)], [(1, 101.0), (55, 100.5)]]
    assert near.count() == masked.count()


@pytest.mark.parametrize("pairs, at_once", [(1, 1), (50, 3)])
def test_stairs_in_small_parts_give_equal_steps(spark, monkeypatch, pairs, at_once):
    """Parts of any size give all rows with the same steps; rows without lots or keys meet none."""
    masked = si.snapshot_masks(blocks(spark, 60, 5, 300))
    bare = masked.limit(1).withColumn("num_lot", F.lit(None).cast("double")).withColumn("stock", F.lit("bare"))
    masked = masked.unionByName(bare).unionByName(bare.withColumn("side", F.lit(None).cast("int"))).cache()
    whole = si.neighbour_stairs(masked, 0.4, 60).cache()
    (cell,) = masked.filter("side = 1").withColumns({"asks": F.lit(True), "in_cell": F.lit(True)}).toArrow().combine_chunks().to_batches()

    def steps_of():
        parts = list(si._stairs(cell, 0.4, 60 * 10**9))
        return [np.concatenate(x).tolist() for x in ([p for p, _ in parts], *zip(*[s for _, s in parts]))]

    want = steps_of()
    for name, value in (("MOST_PAIRS", pairs), ("ROWS_AT_ONCE", at_once)):
        monkeypatch.setattr(si, name, value)
    assert steps_of() == want and len(want[0]) == cell.num_rows
    assert whole.count() == masked.count() and whole.filter("(num_lot IS NULL OR side IS NULL) AND size(near.stock) > 0").count() == 0
