"""Fund pages to tables. `pages`: requested_date DATE, html STRING.

Extraction is a projection of one page row; only the holdings explode. Pages
stay where they are, nothing is shuffled except for the duplicate check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketflow.functions import page_fields as pf
from basketflow.functions.scalars import lenient_date
from basketflow.functions.text import (
    capture,
    contains_all,
    elements,
    elements_of_class,
    no_commas,
    visible_text,
)


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later projections refer to many times. As the output
    of a generator they are computed once per row instead of being pasted into
    every expression that uses them."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def _with_text(pages: DataFrame) -> DataFrame:
    return _computed(pages, text=visible_text(F.col("html")))


def _data_date() -> Column:
    """Date printed on the page, else the requested one."""
    return F.coalesce(lenient_date(capture(F.col("text"), pf.DATE_PATTERN)), F.col("requested_date"))


def _request(df: DataFrame) -> list[str]:
    """What names a request: the fund, if the table holds several, and the date."""
    return [c for c in ("etf_code", "requested_date") if c in df.columns]


def _stored_as(df: DataFrame) -> list[str]:
    """What names a stored day: the fund, if the table holds several, and the data date."""
    return [c for c in ("etf_code", "data_date") if c in df.columns]


def composition_fields(pages: DataFrame) -> DataFrame:
    """One row per page: nine numbers as text, two flags, the data date."""
    text = F.col("text")
    numbers = [no_commas(capture(text, p)).alias(c) for c, p in pf.COMPOSITION_PATTERNS.items()]
    flags = [
        F.when(F.contains(text, F.lit(mark)), "Yes").otherwise("No").alias(c)
        for c, mark in pf.COMPOSITION_FLAGS.items()
    ]
    return _with_text(pages).select(
        *_request(pages), _data_date().alias("data_date"), *numbers, *flags
    )


def nav_fields() -> list[Column]:
    return [no_commas(capture(F.col("text"), p)).alias(c) for c, p in pf.NAV_PATTERNS.items()]


def rate_fields() -> list[Column]:
    """Exchange rates; thousands separators are accepted."""
    return [
        no_commas(capture(F.col("text"), p)).try_cast("double").alias(c)
        for c, p in pf.RATE_PATTERNS.items()
    ]


def page_rates(pages: DataFrame) -> DataFrame:
    return _with_text(pages).select(*_request(pages), _data_date().alias("data_date"), *rate_fields())


def _cell_rows(table: Column) -> Column:
    """Texts of the cells of every row but the first."""
    every = elements(table, "tr")
    rows = F.slice(every, 2, F.size(every))
    return F.transform(rows, lambda r: F.transform(elements(r, "td"), visible_text))


def _holding_struct(cells: Column) -> Column:
    return F.struct(
        cells[0].alias("stock_code"),
        cells[1].alias("stock_name"),
        no_commas(cells[2]).alias("shares"),
        no_commas(cells[3]).alias("market_value"),
        F.replace(cells[4], F.lit("%"), F.lit("")).alias("weight_pct"),
    )


def _assets(pages: DataFrame) -> DataFrame:
    """Adds `holdings` (array of structs), `total` (cells of the total row) and
    `cash_rows` to the page row."""
    def holdings_table(t: Column) -> Column:
        return F.contains(t, F.lit(pf.HOLDINGS_MARK))

    def cash_table(t: Column) -> Column:
        return contains_all(t, pf.CASH_MARKS) & ~holdings_table(t)

    df = _computed(
        _with_text(pages), tables=elements_of_class(F.col("html"), "table", pf.TABLE_CLASS)
    )
    df = _computed(
        df.drop("html"),
        basket_table=F.get(F.filter("tables", holdings_table), F.lit(0)),
        money_table=F.get(F.filter("tables", cash_table), F.lit(0)),
    )
    df = _computed(
        df.drop("tables"),
        rows=_cell_rows(F.col("basket_table")),
        cash_rows=_cell_rows(F.col("money_table")),
    )
    df = _computed(
        df.withColumn("rows", F.filter("rows", lambda c: F.size(c) >= 5)).withColumn(
            "cash_rows", F.filter("cash_rows", lambda c: F.size(c) >= 2)
        ),
        total_at=F.array_position(
            F.transform(
                F.filter("rows", lambda c: F.size(c) >= 5),
                lambda c: F.contains(c[0], F.lit(pf.TOTAL_MARK)),
            ),
            True,
        ),
    )

    def before_total(cells: Column, i: Column) -> Column:
        open_ended = F.coalesce(F.col("total_at"), F.lit(0)) == 0
        return (open_ended | (i + 1 < F.col("total_at"))) & F.contains(cells[0], F.lit(pf.STOCK_MARK))

    return df.withColumns(
        {
            "holdings": F.transform(F.filter("rows", before_total), _holding_struct),
            "total": F.when(
                F.col("total_at") > 0, F.get("rows", (F.col("total_at") - 1).cast("int"))
            ),
        }
    )


def _last_value(fragments: tuple[str, ...], taken: list[tuple[str, ...]]) -> Column:
    def matches(cells: Column) -> Column:
        hit = contains_all(cells[0], fragments)
        for other in taken:
            hit = hit & ~contains_all(cells[0], other)
        return hit

    return no_commas(
        F.element_at(F.concat(F.array(F.lit(None).cast("string")),
                              F.transform(F.filter("cash_rows", matches), lambda c: c[1])), -1)
    )


def cash_fields() -> list[Column]:
    """The last row whose label matches wins; a label counts for the first
    column it matches."""
    out, taken = [], []
    for fragments, column in pf.CASH_LABELS:
        out.append(_last_value(fragments, list(taken)).alias(column))
        taken.append(fragments)
    return out


def cash_labels(pages: DataFrame) -> DataFrame:
    return _assets(pages).select(*_request(pages), _data_date().alias("data_date"), *cash_fields())


def holdings_rows(pages: DataFrame) -> DataFrame:
    """One row per holding, page-level fields next to it."""
    page_level = _assets(pages).select(
        *_request(pages),
        _data_date().alias("data_date"),
        *nav_fields(),
        *rate_fields(),
        no_commas(F.get("total", F.lit(3))).alias("total_market_value"),
        F.replace(F.get("total", F.lit(4)), F.lit("%"), F.lit("")).alias("total_weight"),
        *cash_fields(),
        "holdings",
    )
    return page_level.select("*", F.inline("holdings")).drop("holdings")


#: Columns of the page tables that stay text; every other text column is a number.
TEXT_COLUMNS = frozenset({"etf_code", "stock_code", "stock_name", "fund_purchase", "fund_redemption"})


def typed(rows: DataFrame) -> DataFrame:
    """The scraped numbers as doubles; what is no number gives NULL."""
    numbers = [c for c, t in rows.dtypes if t == "string" and c not in TEXT_COLUMNS]
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numbers})


def first_requests(rows: DataFrame) -> DataFrame:
    """Per fund and data date the earliest requested date. Aggregated on the map
    side, so a data date that very many pages repeat does no harm."""
    return rows.groupBy(*_stored_as(rows)).agg(F.min("requested_date").alias("requested_date"))


def first_pages(rows: DataFrame) -> DataFrame:
    """Keep the rows of the page that was requested first."""
    return rows.join(first_requests(rows), [*_stored_as(rows), "requested_date"], "left_semi")


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def ingest_status(pages: DataFrame) -> DataFrame:
    """Verdict per requested date: skipped (weekend), failed (no holdings),
    duplicate (an earlier request had the same data date), success."""
    verdicts = _assets(pages).select(
        *_request(pages),
        _data_date().alias("data_date"),
        is_weekend(F.col("requested_date")).alias("weekend"),
        (F.coalesce(F.size("holdings"), F.lit(0)) == 0).alias("empty"),
    )
    firsts = first_requests(verdicts.filter("NOT weekend AND NOT empty")).withColumn(
        "is_first", F.lit(True)
    )
    return verdicts.join(firsts, [*_stored_as(verdicts), "requested_date"], "left").select(
        *_request(pages),
        "data_date",
        F.when(F.col("weekend"), "skipped")
        .when(F.col("empty"), "failed")
        .when(F.col("is_first"), "success")
        .otherwise("duplicate")
        .alias("status"),
    )


def missing_dates(stored: DataFrame, first: Column, last: Column) -> DataFrame:
    """Calendar days without a stored file. `stored`: data_date."""
    span = stored.agg(first.alias("a"), last.alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("data_date"))
    return days.join(stored.select("data_date").distinct(), "data_date", "left_anti")


def date_of_file(name: Column) -> Column:
    """Date in a file name such as `code_20240923.csv`."""
    return F.to_date(F.regexp_extract(name, r"_(\d{8})\.csv$", 1), "yyyyMMdd")


def fill_rates(basket: DataFrame, rates: DataFrame) -> DataFrame:
    """Rates for the days that lack them, from the page requested for the day
    (one row per day)."""
    r = rates.select(
        F.col("requested_date").alias("Date"),
        F.col("usd_to_twd").alias("page_twd"),
        F.col("usd_to_vnd").alias("page_vnd"),
    ).filter("page_twd IS NOT NULL OR page_vnd IS NOT NULL")
    lacks = F.col("usd_to_twd").isNull()
    found = F.col("page_twd").isNotNull() | F.col("page_vnd").isNotNull()
    return (
        basket.join(r, "Date", "left")
        .withColumn("usd_to_vnd", F.when(lacks & found, F.col("page_vnd")).otherwise(F.col("usd_to_vnd")))
        .withColumn("usd_to_twd", F.when(lacks & found, F.col("page_twd")).otherwise(F.col("usd_to_twd")))
        .drop("page_twd", "page_vnd")
    )


def dates_without_rates(basket: DataFrame) -> DataFrame:
    return basket.filter("usd_to_twd IS NULL").select("Date").distinct()
