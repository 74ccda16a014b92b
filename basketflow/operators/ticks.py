"""From raw trades and quotes to classified trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.functions.scalars import int_div
from basketflow.params import MINUTE_NS, Calendar


def usable_weights(weights: DataFrame) -> DataFrame:
    """Weights of a day; a row with any NULL is unusable."""
    return weights.na.drop("any")


def basket_only(ticks: DataFrame, weights: DataFrame) -> DataFrame:
    """Keep the stocks the basket of that day holds.

    No hint: Spark broadcasts the key list when its size is below the
    threshold and shuffles otherwise.
    """
    held = usable_weights(weights).select("run_date", "stock").distinct()
    return ticks.join(held, ["run_date", "stock"], "left_semi")


def asof_quotes(
    trades: DataFrame,
    quotes: DataFrame,
    max_age_minutes: int = 5,
    bin_minutes: int = 20,
) -> DataFrame:
    """Attach to every trade the latest quote of its stock that is not younger
    than the trade and at most `max_age_minutes` older.

    `trades`: run_date, stock, ts_ns, src_seq, price, volume.
    `quotes`: run_date, stock, ts_ns, src_seq, bid, ask.

    One stock may hold a large share of all ticks, so the work is split by
    (run_date, stock, time bin). A quote near the end of its bin is also sent
    to the next one, which makes every bin self-contained because no older
    quote can be used. Quotes sort before trades at equal time, and of several
    quotes at one time the last by `src_seq` counts; the whole quote row is
    taken, NULL prices included.
    """
    if bin_minutes < max_age_minutes:
        raise ValueError("bin_minutes must not be below max_age_minutes")
    bin_ns, age_ns = bin_minutes * MINUTE_NS, max_age_minutes * MINUTE_NS
    own_bin = int_div(F.col("ts_ns"), bin_ns)
    reaches_next = F.pmod(F.col("ts_ns"), F.lit(bin_ns)) >= F.lit(bin_ns - age_ns)
    quote = F.struct(
        F.col("ts_ns").alias("quote_ts_ns"), F.col("src_seq").alias("quote_seq"), "bid", "ask"
    )
    q = quotes.select(
        "run_date",
        "stock",
        F.explode(
            F.when(reaches_next, F.array(own_bin, own_bin + 1)).otherwise(F.array(own_bin))
        ).alias("bin"),
        "ts_ns",
        "src_seq",
        F.lit(False).alias("is_trade"),
        F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("double").alias("volume"),
        quote.alias("quote"),
    )
    t = trades.select(
        "run_date",
        "stock",
        own_bin.alias("bin"),
        "ts_ns",
        "src_seq",
        F.lit(True).alias("is_trade"),
        "price",
        "volume",
    )
    upto_here = (
        W.partitionBy("run_date", "stock", "bin")
        .orderBy("ts_ns", "is_trade", "src_seq")
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    merged = q.unionByName(t, allowMissingColumns=True).withColumn(
        "quote", F.last("quote", ignorenulls=True).over(upto_here)
    )
    fresh = F.col("quote.quote_ts_ns") >= F.col("ts_ns") - F.lit(age_ns)
    kept = F.when(fresh, F.col("quote"))
    return merged.filter("is_trade").select(
        "run_date",
        "stock",
        "bin",
        "ts_ns",
        "src_seq",
        "price",
        "volume",
        *[kept[c].alias(c) for c in ("quote_ts_ns", "quote_seq", "bid", "ask")],
    )


def side_of(price: Column, bid: Column, ask: Column) -> Column:
    """-1 at or below the bid, else 1 at or above the ask, else NULL. The bid
    is tested first: on a crossed quote -1 wins."""
    return F.when(price <= bid, F.lit(-1)).when(price >= ask, F.lit(1)).cast("int")


def trade_side(trades: DataFrame) -> DataFrame:
    """Classify the trades and drop those without a side."""
    return trades.withColumn("side", side_of(F.col("price"), F.col("bid"), F.col("ask"))).filter(
        F.col("side").isNotNull()
    )


def in_calendar(trigger_min: Column, calendar: Calendar) -> Column:
    """Is this epoch minute a trigger? Hours are local."""
    local = trigger_min + F.lit(calendar.utc_offset_hours * 60)
    inside = F.pmod(int_div(local, 60), F.lit(24)).isin(*calendar.hours)
    if calendar.after_minute is not None:
        inside = inside & (trigger_min > calendar.after_minute)
    if calendar.upto_minute is not None:
        inside = inside & (trigger_min <= calendar.upto_minute)
    return inside
