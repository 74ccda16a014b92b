"""Reported flow, errors, and the statistics of lots and days."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def reported_flow(transactions: DataFrame) -> DataFrame:
    """Bought minus sold value per day."""
    net = F.col("buy") * F.col("price") - F.col("sell") * F.col("price")
    return transactions.groupBy(F.col("date").alias("Date")).agg(
        F.sum(net).alias("primary_flow_vnd")
    )


def daily_traded(transactions: DataFrame) -> DataFrame:
    """Traded tickers and total value per day."""
    return transactions.groupBy("date").agg(
        F.count("ticker").alias("n_tickers"),
        (F.sum("value_million") * 1e6).alias("total_value"),
    )


def absolute_errors(predicted: DataFrame, reported: DataFrame) -> DataFrame:
    """Errors on the days that have a reported flow."""
    joined = predicted.join(reported, "Date", "left").na.drop(subset=["primary_flow_vnd"])
    return joined.withColumn(
        "abs_error", F.abs(F.col("net_flow") - F.col("primary_flow_vnd"))
    )


def flow_mae(predicted: DataFrame, reported: DataFrame, *keys: str) -> DataFrame:
    """Mean absolute error; NULL predictions are skipped, no overlap gives NULL."""
    return absolute_errors(predicted, reported).groupBy(*keys).agg(F.avg("abs_error").alias("mae"))


def compare_flows(dates: DataFrame, predicted: DataFrame, reported: DataFrame) -> DataFrame:
    """Predicted and true flow of listed dates, where both exist."""
    return (
        dates.select("Date")
        .join(predicted.select("Date", F.col("net_flow").alias("predicted")), "Date", "left")
        .join(reported.select("Date", F.col("primary_flow_vnd").alias("true")), "Date", "left")
        .na.drop("any")
    )


def detected_daily(intraday: DataFrame) -> DataFrame:
    """Intraday detections per day: last symbol and fund, summed measures."""
    last = F.struct("Date", "src_seq")
    sums = ("arbit_ratio", "unwind_ratio", "arbit_value", "unwind_value")
    return (
        intraday.groupBy(F.col("Date").cast("date").alias("day"))
        .agg(
            F.max_by("Symbol", last).alias("Symbol"),
            F.max_by("fund_name", last).alias("fund_name"),
            *[F.sum(c).alias(c) for c in sums],
        )
        .withColumnRenamed("day", "Date")
        .withColumn("ab_un_diff", F.col("arbit_value") - F.col("unwind_value"))
    )


def report_compare(daily: DataFrame, report: DataFrame, first: str, last: str) -> DataFrame:
    """Detected and reported flow in a closed date range, absent values as 0."""
    return (
        daily.select("Date", F.col("ab_un_diff").alias("pi_detect"))
        .join(report.select("Date", F.col("primary_flow").alias("dc_report")), "Date", "left")
        .filter(F.col("Date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        .na.fill(0.0, subset=["pi_detect", "dc_report"])
    )


# ---- exact quantiles -------------------------------------------------------


#: Ranges that the distinct values of a key are cut into, evenly by number.
STRIPES = 128


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    keys: tuple[str, ...] = (),
    weight: str | None = None,
    stripes: int = STRIPES,
) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per entry of
    `probs` plus the count `n`. `weight` names a column that tells how often a
    row counts.

    Equal values are counted first, on the map side. Approximate quantiles of
    the distinct values cut them into stripes of about equal size, wherever the
    values lie. Stripe totals (at most `stripes` rows per key) give the rank at
    which every stripe starts; only values in the few stripes that hold an
    asked rank are then ranked, within their stripe.
    """
    anchor = F.lit(0).alias("_all")
    keys_ = list(keys) or ["_all"]
    src = df.filter(F.col(value).isNotNull())
    src = src if keys else src.select("*", anchor)
    times = F.sum(weight) if weight else F.count(F.lit(1))
    counts = src.groupBy(*keys_, F.col(value).cast("double").alias("v")).agg(times.alias("c"))
    cuts = counts.groupBy(*keys_).agg(
        F.percentile_approx("v", [k / stripes for k in range(1, stripes)], 10_000).alias("cuts")
    )
    counts = counts.join(cuts, keys_).select(
        *keys_, "v", "c", F.size(F.filter("cuts", lambda cut: cut < F.col("v"))).alias("stripe")
    )
    per_key = W.partitionBy(*keys_)
    starts = (
        counts.groupBy(*keys_, "stripe")
        .agg(F.sum("c").alias("sc"))
        .withColumn(
            "start",
            F.sum("sc").over(
                per_key.orderBy("stripe").rowsBetween(W.unboundedPreceding, W.currentRow)
            )
            - F.col("sc"),
        )
        .withColumn("n", F.sum("sc").over(per_key))
    )
    asked = F.lit(False)
    for p in probs.values():
        for rank in (F.floor(F.lit(p) * (F.col("n") - 1)), F.ceil(F.lit(p) * (F.col("n") - 1))):
            asked = asked | ((F.col("start") <= rank) & (rank < F.col("start") + F.col("sc")))
    within = (
        W.partitionBy(*keys_, "stripe").orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    ranked = counts.join(starts.filter(asked).drop("sc"), [*keys_, "stripe"]).withColumn(
        "upto", F.col("start") + F.sum("c").over(within)
    )
    ranked = ranked.withColumn("first", F.col("upto") - F.col("c"))

    aggs, results = [], []
    for name, p in probs.items():
        at = F.lit(p) * (F.col("n") - 1)
        for tag, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("first") <= rank) & (rank < F.col("upto"))
            aggs.append(F.max(F.when(hit, F.col("v"))).alias(f"{name}_{tag}"))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        results.append((lo + (hi - lo) * (at - F.floor(at))).alias(name))
    return ranked.groupBy(*keys_, "n").agg(*aggs).select(*keys, "n", *results)


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, std, min, quartiles, max in one row."""
    plain = df.agg(
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).withColumn("_k", F.lit(1))
    quart = exact_quantiles(df, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).withColumn(
        "_k", F.lit(1)
    )
    return plain.join(quart, "_k").select(
        F.col("n").alias("count"), "mean", "std", "min", "q25", "q50", "q75", "max"
    )


# ---- histograms ------------------------------------------------------------


def equal_width_histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Counts in bins of equal width from the smallest to the largest value,
    which itself belongs to the last bin. Empty bins have count 0."""
    x = F.col(value).cast("double")
    ends = df.agg(F.min(x).alias("low"), F.max(x).alias("high")).withColumn("_k", F.lit(1))
    width = (F.col("high") - F.col("low")) / bins
    counts = (
        df.select(x.alias("x"), F.lit(1).alias("_k"))
        .join(ends, "_k")
        .withColumn(
            "bin",
            F.least(
                F.coalesce(F.floor(F.try_divide(F.col("x") - F.col("low"), width)), F.lit(0)),
                F.lit(bins - 1),
            ).cast("int"),
        )
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    frame = ends.select(
        "low", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    )
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("low") + F.col("bin") * F.col("w")).alias("bin_left"),
        (F.col("low") + (F.col("bin") + 1) * F.col("w")).alias("bin_right"),
        F.coalesce("c", F.lit(0)).cast("bigint").alias("count"),
    )


def distinct_lots(lots: DataFrame) -> DataFrame:
    return lots.dropDuplicates(["similarity", "ts_ns", "stock", "side", "num_lot"])


def lot_counts(lots: DataFrame) -> DataFrame:
    """How often each lot size occurs per similarity: all that quantiles and
    histograms need of the data, and much smaller than it."""
    return distinct_lots(lots).groupBy("similarity", "num_lot").agg(F.count(F.lit(1)).alias("c"))


def lot_quantiles(lots: DataFrame, low: float = 0.001, high: float = 0.999) -> DataFrame:
    return exact_quantiles(
        lot_counts(lots), "num_lot", {"q_low": low, "q_high": high}, ("similarity",), weight="c"
    )


def log_histogram(lots: DataFrame, edges: int = 10) -> DataFrame:
    """Log-spaced, right-closed bins over the lots between the outer quantiles;
    the smallest value itself is outside. Bins without lots have count 0."""
    trimmed = (
        lot_counts(lots)
        .join(lot_quantiles(lots), "similarity")
        .filter(F.col("num_lot").between(F.col("q_low"), F.col("q_high")))
    )
    ends = trimmed.groupBy("similarity").agg(
        F.min("num_lot").alias("low"), F.max("num_lot").alias("high")
    )
    n = edges - 1
    step = (F.ln("high") - F.ln("low")) / n

    def inner(i: Column) -> Column:
        return F.exp(F.ln("low") + i * step)

    edge_list = F.concat(
        F.array("low"), F.transform(F.sequence(F.lit(1), F.lit(n - 1)), inner), F.array("high")
    )
    bounds = ends.select("similarity", edge_list.alias("edges"))
    # Right-closed: the bin number is how many edges lie below the value.
    below = F.size(F.filter("edges", lambda e: e < F.col("num_lot")))
    counts = (
        trimmed.join(bounds, "similarity")
        .select("similarity", (below - 1).alias("bin"), "c")
        .filter("bin >= 0")
        .groupBy("similarity", "bin")
        .agg(F.sum("c").alias("c"))
    )
    frame = bounds.select("similarity", F.posexplode("edges").alias("bin", "bin_left"), "edges").filter(
        F.col("bin") < n
    )
    frame = frame.select(
        "similarity", "bin", "bin_left", F.element_at("edges", F.col("bin") + 2).alias("bin_right")
    )
    return frame.join(counts, ["similarity", "bin"], "left").select(
        "similarity", "bin", "bin_left", "bin_right", F.coalesce("c", F.lit(0)).alias("count")
    )


def three_digits(x: Column) -> Column:
    """A positive number with three significant digits, without trailing
    zeros, and in scientific form below 0.0001 and from 1000 on."""
    exponent = F.regexp_extract(F.format_string("%.2e", x), r"e([+-]\d+)$", 1).cast("int")
    rounded = F.format_string("%.2e", x).cast("double")
    plain = F.format_string("%.6f", rounded)
    plain = F.regexp_replace(plain, r"\.?0+$", "")
    sci = F.regexp_replace(F.format_string("%.2e", x), r"\.?0+e", "e")
    return F.when((exponent < -4) | (exponent >= 3), sci).otherwise(plain)


def labelled(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn(
        "bin_label",
        F.concat(
            F.lit("("),
            three_digits(F.col("bin_left")),
            F.lit(", "),
            three_digits(F.col("bin_right")),
            F.lit("]"),
        ),
    )


def hpd_range(histogram: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Narrowest run of bins holding at least `threshold` of the observations,
    one row per similarity; ties go to the lowest start. No such run gives
    NULL bounds and 0 observations.

    Prefix sums turn a run into two numbers; a start needs only its first
    sufficient end, found in the handful of bins of its own similarity.
    """
    upto = W.partitionBy("similarity").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    bins = histogram.withColumn("cum", F.sum("count").over(upto)).withColumn(
        "total", F.sum("count").over(W.partitionBy("similarity"))
    )
    starts = bins.select(
        "similarity",
        "total",
        F.col("bin").alias("i"),
        F.col("bin_left").alias("lower"),
        (F.col("cum") - F.col("count")).alias("before"),
    )
    ends = bins.select(
        F.col("similarity").alias("s2"),
        F.col("bin").alias("j"),
        F.col("bin_right").alias("upper"),
        F.col("cum").alias("through"),
    )
    obs = F.col("through") - F.col("before")
    enough = (F.col("total") > 0) & (F.try_divide(obs, F.col("total")) >= threshold)
    runs = starts.join(ends, (F.col("similarity") == F.col("s2")) & (F.col("i") <= F.col("j")))
    run = F.struct(
        (F.col("upper") - F.col("lower")).alias("width"),
        "i",
        "j",
        "lower",
        "upper",
        obs.alias("obs"),
    )
    best = runs.groupBy("similarity").agg(
        F.min(F.when(enough, run)).alias("best"), F.max("total").alias("total_obs")
    )
    return best.select(
        "similarity",
        F.col("best.lower").alias("lower_bound"),
        F.col("best.upper").alias("upper_bound"),
        F.coalesce("best.obs", F.lit(0)).alias("obs_in_range"),
        "total_obs",
    )


def hpd_envelope(ranges: DataFrame) -> DataFrame:
    return ranges.agg(
        F.min("lower_bound").alias("lower_bound"), F.max("upper_bound").alias("upper_bound")
    )


def top_trials(trials: DataFrame, n: int = 10) -> DataFrame:
    """The best configurations, smallest error first."""
    return trials.orderBy(F.col("mae").asc_nulls_last(), "param_id").limit(n)


def best_per_stage(trials: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Lowest error per stage, NULL and NaN ignored; on a tie what is stored
    stays, then the lowest parameter id wins."""
    every = trials.withColumn("_age", F.lit(1))
    if stored is not None:
        every = every.unionByName(stored.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    every = every.filter(F.col("mae").isNotNull() & ~F.isnan("mae"))
    w = W.partitionBy("stage").orderBy("mae", "_age", "param_id")
    return every.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_age")
