"""Composition and basket tables, and the weight tables made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basketflow.functions.scalars import lenient_date, safe_div

# Column names and renames (here to JOIN_KEYS) that must match the files.
COMPOSITION = (
    "total_advance_subscription",
    "nav",
    "total_units",
    "net_unit_change",
    "nav_per_unit",
    "creation_unit",
    "equity_value_basket",
    "cash_component",
    "fund_purchase",
    "fund_redemption",
    "Date",
)
BASKET = (
    "Date",
    "stock",
    "shares",
    "market_value",
    "weight_pct",
    "total_market_value",
    "total_weight",
    "total_outstanding_units",
    "nav",
    "nav_per_unit",
    "usd_to_twd",
    "usd_to_vnd",
    "cash_twd",
    "cash_usd",
    "cash_vnd",
    "payables_twd",
)
BASKET_NAMES = {
    "data_date": "Date",
    "stock_code": "stock",
    "total_units": "total_outstanding_units",
    "net_asset_value": "nav",
}
JOIN_KEYS = ("Date", "nav", "nav_per_unit")


def present(df: DataFrame, wanted: tuple[str, ...]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def _date(df: DataFrame) -> DataFrame:
    if "Date" in df.columns and dict(df.dtypes)["Date"] == "string":
        return df.withColumn("Date", lenient_date(F.col("Date")))
    return df


def composition(raw: DataFrame) -> DataFrame:
    """Rename, keep the known columns that exist, parse the date leniently."""
    df = raw.withColumnsRenamed({"requested_date": "Date"})
    return _date(df.select(*present(df, COMPOSITION)))


def clean_basket(raw: DataFrame) -> DataFrame:
    """The same for the basket; the stock is the first word of its code."""
    df = raw.withColumnsRenamed(BASKET_NAMES)
    df = _date(df.select(*present(df, BASKET)))
    if "stock" in df.columns:
        df = df.withColumn("stock", F.substring_index("stock", " ", 1))
    return df


def join_composition(basket: DataFrame, comp: DataFrame) -> DataFrame:
    """Left join on the keys both sides have. The composition has one row per
    day, so it is broadcast when small and shuffled otherwise; NAV figures
    compare as decimals."""
    keys = [k for k in JOIN_KEYS if k in basket.columns and k in comp.columns]
    if not keys:
        return basket

    def comparable(side: str, k: str):
        col = F.col(f"{side}.{k}")
        return col if k == "Date" else col.cast("decimal(38,6)")

    on = [comparable("b", k) == comparable("c", k) for k in keys]
    extra = [F.col(f"c.{c}") for c in comp.columns if c not in keys]
    shared = [c for c in comp.columns if c in basket.columns and c not in keys]
    if shared:
        raise ValueError(f"columns on both sides: {shared}")
    return basket.alias("b").join(comp.alias("c"), on, "left").select("b.*", *extra)


def basket_metrics(joined: DataFrame) -> DataFrame:
    """Derived columns, each where its inputs exist. Zero divisors give NULL;
    the quantity is floored, then rounded half-even to hundreds."""
    have = set(joined.columns)
    df = joined

    def derive(name: str, needs: set[str], value) -> None:
        nonlocal df
        if needs <= have:
            df = df.withColumn(name, value())
            have.add(name)

    c = F.col
    derive("weight_pct", {"weight_pct"}, lambda: c("weight_pct") / 100.0)
    derive(
        "allocated_value",
        {"weight_pct", "equity_value_basket"},
        lambda: c("weight_pct") * c("equity_value_basket"),
    )
    derive(
        "price_per_share",
        {"market_value", "shares"},
        lambda: safe_div(c("market_value"), c("shares")),
    )
    derive(
        "quantity",
        {"allocated_value", "price_per_share"},
        lambda: F.rint(
            F.floor(safe_div(c("allocated_value"), c("price_per_share"))).cast("double") / 100.0
        )
        * 100.0,
    )
    derive(
        "net_primary_lot",
        {"net_unit_change", "creation_unit"},
        lambda: safe_div(c("net_unit_change").cast("double"), c("creation_unit").cast("double")),
    )
    derive(
        "primary_flow_vnd",
        {"net_primary_lot", "equity_value_basket", "usd_to_twd", "usd_to_vnd"},
        lambda: safe_div(c("net_primary_lot") * c("equity_value_basket"), c("usd_to_twd"))
        * c("usd_to_vnd"),
    )
    return df


def shifted_weights(metrics: DataFrame) -> DataFrame:
    """Date, stock and the stock's previous volume and weight. The history of
    one stock has one row per day."""
    df = metrics.withColumnsRenamed({"quantity": "volume", "weight_pct": "weight"})
    w = W.partitionBy("stock").orderBy("Date")
    return df.select(
        "Date", "stock", *[F.lag(c).over(w).alias(c) for c in present(df, ("volume", "weight"))]
    )


def assert_unique(shifted: DataFrame) -> DataFrame:
    """Fail the job on a second row for a (Date, stock)."""
    rows = F.count(F.lit(1)).alias("n")
    twice = F.raise_error(F.concat(F.lit("duplicate weight row: "), F.col("stock")))
    values = present(shifted, ("volume", "weight"))
    return (
        shifted.groupBy("Date", "stock")
        .agg(rows, *[F.first(c).alias(c) for c in values])
        .select("Date", "stock", *[F.when(F.col("n") == 1, F.col(c)).otherwise(twice).alias(c) for c in values])
    )


def _unique_by_stock(shifted: DataFrame, *more: Column) -> DataFrame:
    """The rows as the windows of `shifted_weights` leave them, by stock and in order of
    date. A second row for a (Date, stock) fails the job; values without a stock are NULL."""
    w = W.partitionBy("stock").orderBy("Date")
    twice = F.raise_error(F.concat(F.lit("duplicate weight row: "), F.col("stock")))
    checked = shifted.withColumn("_twice", F.lag("Date").over(w) == F.col("Date"))
    values = [
        F.when(F.col("stock").isNotNull(), F.when(F.col("_twice"), twice).otherwise(F.col(c))).alias(c)
        for c in present(shifted, ("volume", "weight"))
    ]
    return checked.select("Date", "stock", *values, *more)


def _days(shifted: DataFrame) -> DataFrame:
    """One row with the array of all days."""
    days = shifted.select("Date").filter("Date IS NOT NULL").distinct()
    return days.agg(F.array_sort(F.collect_list("Date")).alias("dates"))


def dense_weights(shifted: DataFrame) -> DataFrame:
    """Every stock on every date; absent pairs have NULL values.

    The result is the full grid by definition. It is neither joined nor sorted:
    a row gives its own day and the days up to the stock's next row, the
    stock's first row also those before it. The calendar, one row with an array
    of days, is all that is broadcast.
    """
    calendar = _days(shifted)
    places = calendar.select(F.posexplode("dates").alias("_place", "Date"))
    w = W.partitionBy("stock").orderBy("Date")
    # Rows without a date stand before all others: they only show that there is the stock.
    place = F.coalesce("_place", F.lit(0))
    begin = F.when(F.row_number().over(w) == 1, F.lit(0)).otherwise(place)
    placed = shifted.join(F.broadcast(places), "Date", "left")
    rows = _unique_by_stock(placed, begin.alias("_begin"), F.lead(place).over(w).alias("_end"))
    upto = F.coalesce("_end", F.size("dates"))
    days = F.slice("dates", F.col("_begin") + 1, upto - F.col("_begin"))
    values = present(shifted, ("volume", "weight"))
    return (
        rows.crossJoin(F.broadcast(calendar))
        .withColumn("_day", F.explode(days))
        .select(F.col("_day").alias("Date"), "stock", *[F.when(F.col("_day") == F.col("Date"), F.col(c)).alias(c) for c in values])
    )


def all_stocks(shifted: DataFrame, most: int = 2000) -> list[str]:
    """The stocks that a wide table gets columns for, in order. More than `most`
    are an error: `wide_maps` holds any number."""
    found = shifted.select("stock").where("stock IS NOT NULL").distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} stocks")
    return sorted(r.stock for r in found)


def wide_weights(shifted: DataFrame, stocks: list[str] | None = None) -> DataFrame:
    """One row per date, a `volume` and a `weight` column per stock: those listed,
    else all there are. A second row for a date and stock is an error."""
    stocks = all_stocks(shifted) if stocks is None else stocks
    return (
        assert_unique(shifted)
        .groupBy("Date")
        .pivot("stock", stocks)
        .agg(F.first("volume").alias("volume"), F.first("weight").alias("weight"))
    )


def wide_maps(shifted: DataFrame) -> DataFrame:
    """One row per date with a map from every stock there is to its volume and
    weight, however many stocks there are. A second row for a date and stock is
    an error.

    Only rows that exist are shuffled by date; each date adds the stocks it lacks
    from the list of all."""
    entry = F.struct("stock", F.struct("volume", "weight").alias("at"))
    rows = _unique_by_stock(shifted).filter("Date IS NOT NULL")
    by_date = rows.groupBy("Date").agg(F.collect_list(F.when(F.col("stock").isNotNull(), entry)).alias("held"))
    every = shifted.select("stock").filter("stock IS NOT NULL").distinct().agg(F.collect_list("stock").alias("every"))
    nothing = F.struct(*[F.lit(None).cast(shifted.schema[c].dataType).alias(c) for c in ("volume", "weight")])
    lacking = F.transform(F.array_except("every", "held.stock"), lambda s: F.struct(s.alias("stock"), nothing.alias("at")))
    return by_date.crossJoin(F.broadcast(every)).select(
        "Date", F.map_from_entries(F.concat("held", lacking)).alias("stocks")
    )


def long_from_maps(wide: DataFrame) -> DataFrame:
    """Back to one row per date and stock."""
    rows = wide.select("Date", F.explode("stocks").alias("stock", "at"))
    return rows.select("Date", "stock", "at.volume", "at.weight")


def long_from_wide(wide: DataFrame, stocks: list[str]) -> DataFrame:
    """Back to one row per date and stock."""
    parts = F.array(
        *[
            F.struct(
                F.lit(s).alias("stock"),
                F.col(f"`{s}_volume`").alias("volume"),
                F.col(f"`{s}_weight`").alias("weight"),
            )
            for s in stocks
        ]
    )
    return wide.select("Date", F.inline(parts))
