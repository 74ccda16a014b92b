"""Parameter search as one job: the parameter id is a grouping key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketflow.functions.scalars import half_even
from basketflow.operators.buckets import buckets_of_lot, with_lot_buckets
from basketflow.operators.evaluation import best_per_stage
from basketflow.operators.segments import (
    arbit_unwind,
    core_filter,
    eligible,
    first_detection,
    long_segments,
    segment_stats,
    segments,
    shift_time,
)
from basketflow.operators.similarity import counts_within, neighbour_stairs, similarity_blocks, snapshot_masks
from basketflow.operators.ticks import usable_weights
from basketflow.params import Calendar, DetectionParams
from basketflow.plans.detect import daily_net_flow, rollup_rows
from basketflow.session import shared_dir

# Search ranges (low, high, step); step 0 is continuous.
DETECTION_RANGES = {
    "seconds_early": (5, 25, 1),
    "tolerance": (0.12, 0.35, 0),
    "seconds_gap": (45, 60, 1),
    "min_unique": (7, 24, 1),
    "min_segment": (6, 25, 1),
    "core_threshold": (8, 20, 1),
}
BUCKET_RANGES = {
    "start": (0.02, 0.8, 0),
    "stop": (50, 100, 1),
    "num": (20, 60, 1),
    "step": (0.25, 0.5, 0.05),
    "growth": (1.0, 1.5, 0),
    "int_threshold": (3, 9, 1),
    "first_center": (0.05, 0.5, 0.05),
}
# Bucket shape while the detection parameters vary.
STAGE1_BUCKETS = {
    "start": 0.15,
    "stop": 89,
    "num": 25,
    "step": 0.25,
    "growth": 1.13,
    "int_threshold": 4,
    "first_center": 0.20,
}
INTEGERS = {
    "seconds_early",
    "seconds_gap",
    "min_unique",
    "min_segment",
    "core_threshold",
    "num",
}


def scaled(u: Column, low: float, high: float, step: float) -> Column:
    """A uniform number in [0, 1) onto a range; stepped ranges include both
    ends with equal weight."""
    if not step:
        return F.lit(float(low)) + u * F.lit(float(high) - float(low))
    n = round((high - low) / step) + 1
    return F.lit(float(low)) + F.floor(u * F.lit(n)) * F.lit(float(step))


def sample(ids: DataFrame, ranges: dict, fixed: dict, uniform: Callable[[int], Column], *keep: str) -> DataFrame:
    """Parameter rows for the given `param_id`s. `uniform(i)` is the source of
    the i-th parameter's numbers. Values have nine decimals at most."""
    cols = []
    for i, (name, (low, high, step)) in enumerate(ranges.items()):
        value = scaled(uniform(i), low, high, step)
        cols.append((value.cast("int") if name in INTEGERS else half_even(value.cast("double"), 9)).alias(name))
    for name, value in fixed.items():
        kind = "int" if name in INTEGERS else "double"
        cols.append(F.lit(value).cast(kind).alias(name))
    return ids.select("param_id", *keep, *cols)


def random_params(spark: SparkSession, stage: int, trials: int, fixed: dict, seed: int = 42) -> DataFrame:
    """Seeded random trials of one stage; `fixed` holds the other stage's.

    The numbers are hashes of (trial, seed, parameter): a trial keeps its
    values when a lost task is repeated or the search resumes on a cluster of
    another size.
    """
    ranges = DETECTION_RANGES if stage == 1 else BUCKET_RANGES
    ids = spark.range(trials).withColumnRenamed("id", "param_id")
    return sample(ids, ranges, fixed, hashed_uniform(seed))


@dataclass(frozen=True)
class Prepared:
    """What all trials share: roll-up rows with their neighbours' stairs, a folder per date, and the dates that have weights."""

    near: DataFrame
    weighted: DataFrame
    calendar: Calendar


def prepare_rows(
    trades: DataFrame,
    quotes: DataFrame,
    weights: DataFrame,
    run_dates: list[str],
    most_tolerance: float,
    most_gap: int,
    calendar: Calendar | None = None,
) -> Prepared:
    """The part of the chain that depends on no parameter, once and written to the shared folder, for all sets up to the given
    tolerance and gap."""
    calendar = calendar or Calendar()
    spark = trades.sparkSession
    # Reaches the scans, so only the partitions of these dates are read.
    asked = F.col("run_date").isin(*[F.lit(d).cast("date") for d in sorted(set(run_dates))])
    trades, quotes, weights = trades.filter(asked), quotes.filter(asked), weights.filter(asked)
    masked = snapshot_masks(rollup_rows(trades, quotes, weights, calendar))
    near = neighbour_stairs(masked, most_tolerance, most_gap)
    path = shared_dir(spark, "near")
    near.write.partitionBy("run_date").parquet(path)
    weighted = usable_weights(weights).select("run_date").distinct()
    return Prepared(spark.read.schema(near.schema).parquet(path), weighted, calendar)


def date_rounds(run_dates: list[str], first: int = 1) -> list[list[str]]:
    """The dates in order, in groups of `first` dates, twice and four times as many, and so on."""
    dates, out = sorted(set(run_dates)), []
    while dates:
        out.append(dates[: first << len(out)])
        dates = dates[len(out[-1]) :]
    return out


def flows_of(prepared: Prepared, params: DataFrame, run_dates: list[str], early_in_clustering: bool = False) -> DataFrame:
    """(param_id, run_date, net_flow) of each set on each of the dates that has weights; NULL where nothing was found."""
    base = DetectionParams(calendar=prepared.calendar)
    days = [F.lit(d).cast("date") for d in run_dates]
    evals = with_lot_buckets(params).withColumn("run_date", F.explode(F.array(*days)))
    kinds = ("run_date", "tolerance", "seconds_gap")

    # Counts are shared by the sets that agree on both parameters, and kept if any of them may need them.
    least = evals.groupBy(*kinds).agg(F.min("min_unique").alias("least"))
    rows = prepared.near.filter(F.col("run_date").isin(*days)).join(least, "run_date")
    own = ("param_id", "min_unique", "min_segment", "core_threshold", "seconds_early", "buckets")
    asked = evals.select(*kinds, *own)

    def for_sets(counted: DataFrame) -> DataFrame:
        # Buckets are looked up once a row and set, not once a snapshot.
        wanted = similarity_blocks(counted, "least").join(asked, list(kinds))
        wanted = similarity_blocks(wanted, "min_unique").withColumn("n_buckets", F.size("buckets"))
        return wanted.withColumn("buckets", buckets_of_lot(F.col("buckets")))

    keep = (*kinds, *own, "n_buckets")
    counted = counts_within(rows, F.col("tolerance"), F.col("seconds_gap"), prepared.calendar, *keep, before_fan_out=for_sets)
    similar = similarity_blocks(counted, "min_unique")
    keys = ("param_id", "run_date")
    early = "seconds_early" if early_in_clustering else base.seconds_early
    found = segment_stats(segments(similar, F.col("buckets"), early, keys, F.col("n_buckets")), keys)
    kept = core_filter(long_segments(found, "min_segment"), "core_threshold")
    timed = shift_time(
        eligible(kept, utc_offset_hours=prepared.calendar.utc_offset_hours, keys=keys), base.shift_seconds
    )
    flows = daily_net_flow(arbit_unwind(first_detection(timed, keys)), *keys)
    return evals.select(*keys).join(prepared.weighted, "run_date", "left_semi").join(flows, list(keys), "left").select(*keys, "net_flow")


def evaluate_prepared(prepared: Prepared, reported: DataFrame, params: DataFrame, run_dates: list[str], early_in_clustering: bool = False, first_round: int = 1) -> DataFrame:
    """Net flow per parameter set and run date, beside the reported flow.

    Dates are evaluated in the rounds of `date_rounds`. A set that finds nothing on a date is pruned, so it takes no part
    in the rounds after it: its later dates have no rows.
    """
    spark = params.sparkSession
    rounds, every = date_rounds(run_dates, first_round), None
    for i, dates in enumerate(rounds):
        flows = flows_of(prepared, params, dates, early_in_clustering)
        if i + 1 < len(rounds):
            path = shared_dir(spark, "flows")
            flows.write.parquet(path)
            flows = spark.read.schema(flows.schema).parquet(path)
            params = params.join(flows.filter("net_flow IS NULL").select("param_id").distinct(), "param_id", "left_anti")
        every = flows if every is None else every.unionByName(flows)
    if every is None:
        raise ValueError("no dates to evaluate")
    return every.join(reported.withColumnRenamed("Date", "run_date"), "run_date", "left")


def evaluate(
    trades: DataFrame,
    quotes: DataFrame,
    weights: DataFrame,
    reported: DataFrame,
    params: DataFrame,
    run_dates: list[str],
    calendar: Calendar | None = None,
    early_in_clustering: bool = False,
    first_round: int = 1,
) -> DataFrame:
    """`evaluate_prepared` on rows prepared for just these sets."""
    most = params.agg(F.max("tolerance").alias("tolerance"), F.max("seconds_gap").alias("gap")).first()
    prepared = prepare_rows(trades, quotes, weights, run_dates, most["tolerance"] or 0.0, most["gap"] or 1, calendar)
    return evaluate_prepared(prepared, reported, params, run_dates, early_in_clustering, first_round)


def trial_metrics(evaluated: DataFrame, params: DataFrame) -> DataFrame:
    """Mean absolute error per parameter set. A set with an empty date is
    pruned; dates without a reported flow do not count."""
    error = F.abs(F.col("net_flow") - F.col("primary_flow_vnd"))
    per_set = evaluated.groupBy("param_id").agg(
        F.count_if(F.col("net_flow").isNull()).alias("n_empty"), F.avg(error).alias("mae")
    )
    return params.join(per_set.filter("n_empty = 0").drop("n_empty"), "param_id")


#: Shares and sizes of the guided search.
GOOD_SHARE = 0.25
BINS = 5
CANDIDATES = 24


def hashed_uniform(seed: int) -> Callable[[int], Column]:
    """Numbers in [0, 1) from a hash of (`param_id`, seed, i): the same when a lost task is repeated or a search resumes."""
    return lambda i: F.pmod(F.xxhash64("param_id", F.lit(seed), F.lit(i)), F.lit(2**52)) / F.lit(float(2**52))


def _bin(value: Column, low: float, high: float) -> Column:
    share = (value - F.lit(float(low))) / F.lit(float(high) - float(low)) * F.lit(float(BINS))
    return F.least(F.greatest(F.floor(share), F.lit(0)), F.lit(BINS - 1)).cast("int")


def _long(rows: DataFrame, ranges: dict, *keep: str) -> DataFrame:
    """One row per set and parameter, with the bin of its value."""
    cells = [F.struct(F.lit(name).alias("name"), _bin(F.col(name), low, high).alias("bin")) for name, (low, high, _) in ranges.items()]
    return rows.select(*keep, F.explode(F.array(*cells)).alias("cell")).select(*keep, "cell.name", "cell.bin")


def ranked_trials(history: DataFrame) -> DataFrame:
    """`history` with `place` by error and `good`: the best quarter of the trials that have one. Trials are few (a search's
    budget), so one task ranks them."""
    n = F.count(F.lit(1)).over(W.partitionBy())
    place = F.row_number().over(W.partitionBy().orderBy(F.col("mae").asc_nulls_last(), "param_id"))
    return history.withColumn("place", place).withColumn("good", F.col("mae").isNotNull() & (F.col("place") <= F.greatest(F.ceil(n * GOOD_SHARE), F.lit(1))))


def densities(ranked: DataFrame, ranges: dict) -> DataFrame:
    """(name, bin, gain): the logarithm of how much more frequent a parameter's bin is among good trials than among the others,
    each count with one added."""
    cells = [F.struct(F.lit(name).alias("name"), F.lit(b).alias("bin")) for name in ranges for b in range(BINS)]
    totals = ranked.agg(F.count_if("good").alias("goods"), F.count_if(~F.col("good")).alias("bads"))
    grid = totals.select("goods", "bads", F.explode(F.array(*cells)).alias("cell")).select("goods", "bads", "cell.name", "cell.bin")
    counts = _long(ranked, ranges, "good").groupBy("name", "bin").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    g, b = F.coalesce("g", F.lit(0)) + F.lit(1.0), F.coalesce("b", F.lit(0)) + F.lit(1.0)
    gain = F.ln(g / (F.col("goods") + F.lit(float(BINS)))) - F.ln(b / (F.col("bads") + F.lit(float(BINS))))
    return grid.join(counts, ["name", "bin"], "left").select("name", "bin", gain.alias("gain"))


def suggest(
    history: DataFrame,
    ranges: dict,
    fixed: dict,
    batch: int,
    first_id: int,
    seed: int = 42,
    uniform: Callable[[int], Column] | None = None,
) -> DataFrame:
    """The next `batch` parameter rows, with ids from `first_id`, learned from the trials so far (param_id, the ranges' parameters, mae).

    Candidates are drawn, half of them from the whole ranges and half near good trials; each scores the sum of its bins' gains,
    and the best go. All numbers are hashes of the candidates' ids, which follow from `first_id`.
    """
    spark = history.sparkSession
    uniform = uniform or hashed_uniform(seed)
    ranked = ranked_trials(history)
    goods = ranked.filter("good").select(F.col("place").alias("pick"), *[F.col(c).alias(f"near_{c}") for c in ranges])
    n_good = goods.count()
    start = first_id * CANDIDATES
    ids = spark.range(start, start + batch * CANDIDATES).withColumnRenamed("id", "param_id")
    # Places of good trials are 1, 2, ...: an even candidate gets none.
    pick = F.when((F.col("param_id") % 2 == 1) & F.lit(n_good > 0), F.floor(uniform(len(ranges)) * F.lit(n_good)) + 1)
    drawn = sample(ids.withColumn("pick", pick), ranges, fixed, uniform, "pick").join(goods, "pick", "left")
    for i, (name, (low, high, step)) in enumerate(ranges.items()):
        moved = F.col(f"near_{name}") + (uniform(i) - 0.5) * F.lit(2.0 * (float(high) - float(low)) / BINS)
        moved = F.least(F.greatest(moved, F.lit(float(low))), F.lit(float(high)))
        if step:
            moved = F.lit(float(low)) + F.rint((moved - F.lit(float(low))) / F.lit(float(step))) * F.lit(float(step))
        moved = moved.cast("int") if name in INTEGERS else half_even(moved, 9)
        drawn = drawn.withColumn(name, F.coalesce(moved, F.col(name)))
    drawn = drawn.select("param_id", *ranges, *fixed)
    scores = _long(drawn, ranges, "param_id").join(densities(ranked, ranges), ["name", "bin"]).groupBy("param_id").agg(half_even(F.sum("gain"), 9).alias("score"))
    best = drawn.join(scores, "param_id").orderBy(F.desc("score"), "param_id").limit(batch)
    place = F.row_number().over(W.partitionBy().orderBy(F.desc("score"), "param_id"))
    return best.withColumn("param_id", F.lit(first_id - 1).cast("bigint") + place).select("param_id", *ranges, *fixed)


def search_stage(
    log: str,
    stage: str,
    ranges: dict,
    fixed: dict,
    trials: int,
    errors: Callable[[DataFrame], DataFrame],
    spark: SparkSession,
    startup: int = 25,
    batch: int = 11,
    seed: int = 42,
    uniform: Callable[[int], Column] | None = None,
) -> None:
    """Trials 0 to `trials` - 1 of a stage, appended to `log`: the first `startup` are drawn evenly, the others in batches by
    `suggest` from all before them. `errors` adds `mae` to parameter rows (NULL where a set is pruned).

    A batch is one append with all its trials, and follows from those before it: a search that was ended goes on where it was.
    """
    from basketflow.sources.tables import append_trials, stored_trials

    cuts = [0, min(startup, trials)]
    while cuts[-1] < trials:
        cuts.append(min(trials, cuts[-1] + batch))
    for lo, hi in zip(cuts, cuts[1:]):
        logged = stored_trials(spark, log)
        done = None if logged is None else logged.filter(F.col("stage") == stage)
        if done is not None and done.filter(F.col("param_id") >= lo).limit(1).count():
            continue
        if lo == 0:
            ids = spark.range(hi).withColumnRenamed("id", "param_id")
            params = sample(ids, ranges, fixed, uniform or hashed_uniform(seed))
        else:
            params = suggest(done, ranges, fixed, hi - lo, lo, seed, uniform)
        result = errors(params).withColumn("stage", F.lit(stage))
        # Equal trials must tie: their sums may differ in the last digits.
        append_trials(result.withColumn("mae", half_even(F.col("mae"), 2)).coalesce(1), log)


def two_stage(
    trades: DataFrame,
    quotes: DataFrame,
    weights: DataFrame,
    reported: DataFrame,
    run_dates: list[str],
    out_dir: str,
    stage1_trials: int = 80,
    stage2_trials: int = 60,
    seed: int = 42,
    calendar: Calendar | None = None,
    startup: int = 25,
    batch: int = 11,
    detection_ranges: dict | None = None,
    uniform: Callable[[int], Column] | None = None,
) -> DataFrame:
    """Search detection parameters on a fixed bucket table, freeze the best, then search bucket parameters. All trials go to
    `out_dir/trials`; what stands there is not run again. Returns the best row per stage."""
    spark = trades.sparkSession
    log = f"{out_dir}/trials"
    ranges = detection_ranges or DETECTION_RANGES
    prepared = prepare_rows(trades, quotes, weights, run_dates, ranges["tolerance"][1], ranges["seconds_gap"][1], calendar)

    def errors(params: DataFrame) -> DataFrame:
        # Suggested sets are used by every round: they are not to be drawn anew.
        path = shared_dir(spark, "sets")
        params.write.parquet(path)
        params = spark.read.schema(params.schema).parquet(path)
        metrics = trial_metrics(evaluate_prepared(prepared, reported, params, run_dates), params)
        return params.join(metrics.select("param_id", "mae"), "param_id", "left")

    fixed = dict(STAGE1_BUCKETS)
    for stage, searched, trials in (("stage1", ranges, stage1_trials), ("stage2", BUCKET_RANGES, stage2_trials)):
        search_stage(log, stage, searched, fixed, trials, errors, spark, startup, batch, seed, uniform)
        best = best_per_stage(spark.read.parquet(log).filter(F.col("stage") == stage)).first()
        if best is None:
            break
        fixed = {k: best[k] for k in ranges}
    return best_per_stage(spark.read.parquet(log))
