"""Readers and writers for ticks, weights, scraped files and results."""

from __future__ import annotations

import csv
import re
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from basketflow.operators.evaluation import best_per_stage
from basketflow.session import shared_dir
from basketflow.sources.pages import fill_rates


def read_csv_files(spark: SparkSession, files: list[str], types: dict[str, str]) -> DataFrame:
    """Union by name of CSV files whose columns differ.

    Files with the same header are read in one scan; only the header lines
    come to the driver. A column absent from a file is NULL there; columns
    without an entry in `types` stay text. Without files the table is empty
    and has the columns of `types`.
    """
    if not files:
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in types.items()) or "`value` string")
    head = (
        spark.read.text(files, wholetext=False)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
        .filter("at = 0")
        .withColumn("pos", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("value", "pos").alias("header"))
        .groupBy("header")
        .agg(F.collect_list("file").alias("files"))
    )
    frames = []
    for row in head.collect():
        names = [n.strip() for n in next(csv.reader([row.header.lstrip("\ufeff")]))]
        schema = ", ".join(f"`{n}` {types.get(n, 'string')}" for n in names)
        frames.append(spark.read.csv(sorted(row.files), header=True, schema=schema))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_ticks(spark: SparkSession, root: str, run_dates: list[str] | None = None) -> DataFrame:
    """Tick or quote table partitioned by `run_date`; `symbol` becomes `stock`.
    The date filter prunes partitions."""
    df = spark.read.parquet(root)
    if "src_seq" not in df.columns:
        # The order within the file decides between rows of equal time.
        df = df.withColumn("src_seq", F.col("_metadata.row_index"))
    df = df.withColumnsRenamed({"symbol": "stock"})
    if run_dates:
        df = df.filter(F.col("run_date").isin(*run_dates))
    return df.withColumn("run_date", F.col("run_date").cast("date"))


def read_tick_csv(spark: SparkSession, template: str, types: dict[str, str], run_dates: list[str] | None = None) -> DataFrame:
    """Ticks or quotes of one CSV file (or folder of files) a date. `{date}` in `template` stands for the date as
    yyyy-MM-dd, as in `/data/tick/{date}.csv`. `symbol` becomes `stock`.

    Only the files of `run_dates` are listed, and a date without a file is an error. Columns are found by the header,
    which must be the same in all files (an error otherwise); those of `types` are kept, and a value that its type
    cannot hold is NULL. `src_seq` is the place in the date's files (file, block, row), so rows of equal time keep
    their order however Spark splits a file.
    """
    paths = [template.replace("{date}", d) for d in run_dates] if run_dates else template.replace("{date}", "*")
    around = [re.escape(part) for part in template.rsplit("/", 1)[-1].split("{date}")]
    day = F.regexp_extract("_metadata.file_path", rf"/{around[0]}(\d{{4}}-\d{{2}}-\d{{2}}){around[1]}(/[^/]*)?$", 1)
    place = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    raw = spark.read.csv(paths, header=True, enforceSchema=False)
    return raw.select(
        F.to_date(day).alias("run_date"),
        F.col("symbol").alias("stock"),
        place.alias("src_seq"),
        *[F.col(c).try_cast(t).alias(c) for c, t in types.items()],
    )


def as_trades(raw: DataFrame) -> DataFrame:
    """Engine columns of a raw tick table (`ts`, `c`, `mv`)."""
    return raw.select(
        "run_date",
        "stock",
        F.col("ts").alias("ts_ns"),
        F.col("src_seq") if "src_seq" in raw.columns else F.col("ts").alias("src_seq"),
        F.col("c").alias("price"),
        F.col("mv").alias("volume"),
    )


def as_quotes(raw: DataFrame) -> DataFrame:
    """Engine columns of a raw order-book table (`ts`, `bb0_p`, `bo0_p`)."""
    return raw.select(
        "run_date",
        "stock",
        F.col("ts").alias("ts_ns"),
        F.col("src_seq") if "src_seq" in raw.columns else F.col("ts").alias("src_seq"),
        F.col("bb0_p").alias("bid"),
        F.col("bo0_p").alias("ask"),
    )


def as_weights(raw: DataFrame) -> DataFrame:
    """Engine columns of a long weight table (`Date`, `stock`, `volume`, `weight`)."""
    return raw.select(
        F.col("Date").cast("date").alias("run_date"),
        "stock",
        F.col("volume").cast("double").alias("quantity"),
        F.col("weight").cast("double").alias("weight"),
    )


def read_lot_folders(spark: SparkSession, root: str) -> DataFrame:
    """Lots below `root`, one folder `similarity=NN` each; the folder's number is a column."""
    return spark.read.parquet(root).withColumn("similarity", F.col("similarity").cast("int"))


def csv_files(spark: SparkSession, folder: str) -> list[str]:
    """The CSV files of a folder. Only names are read: no column asks for the content."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder)
    return sorted(listed.inputFiles())


def read_primary_flow(df: DataFrame) -> DataFrame:
    return df.select(F.col("Date").cast("date").alias("Date"), "primary_flow_vnd")


# Tasks that write one month.
SINK_TASKS = 8

# Text of a time with all the digits Spark keeps.
RESULT_TIMES = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def write_results(detections: DataFrame, path: str, form: str = "parquet") -> None:
    """One partition per run date, as Parquet or CSV; only the dates in the frame are replaced."""
    writer = (
        detections.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_date")
        .format(form)
    )
    if form == "csv":
        writer = writer.options(header=True, timestampFormat=RESULT_TIMES)
    writer.save(path)


def read_results(spark: SparkSession, path: str, like: DataFrame, form: str = "parquet") -> DataFrame:
    """Stored results with the columns of `like`. A day without detections has no folder, so the schema does not come
    from the files."""
    # The partition column follows those of the files.
    held = like.select(*[c for c in like.columns if c != "run_date"], "run_date")
    reader = spark.read.schema(held.schema).format(form)
    if form == "csv":
        reader = reader.options(header=True, enforceSchema=False, timestampFormat=RESULT_TIMES)
    return reader.load(path).select(*like.columns)


def write_back_rates(rates: DataFrame, path: str, by: str = "Date") -> None:
    """Fill the exchange rates into a basket table that is partitioned by `by` (`Date` or a column that follows from it,
    such as its month). Only partitions with a day that lacks rates and that `rates` (one row per requested day) knows
    are rewritten; the files of all others stay as they are. The new rows are written aside before they replace the old,
    and running a lost job again completes it: the rates of a filled day are not touched again."""
    spark = rates.sparkSession
    stored = spark.read.parquet(path)
    known = rates.filter("usd_to_twd IS NOT NULL OR usd_to_vnd IS NOT NULL").select(F.col("requested_date").alias("Date"))
    lacking = stored.filter("usd_to_twd IS NULL").select(by, "Date").distinct().join(known, "Date", "left_semi")
    filled = fill_rates(stored.join(lacking.select(by).distinct(), by, "left_semi"), rates)
    aside = shared_dir(spark, "rates")
    filled.write.parquet(aside)
    again = spark.read.schema(filled.schema).parquet(aside).repartition(by, F.pmod(F.xxhash64("Date"), F.lit(SINK_TASKS)))
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).schema
        return True
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise


# Columns that tell which write a row came with: when it began, by its driver's clock, and its own id.
WRITER = ("written_at", "writer")


def _signed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"written_at": F.lit(time.time_ns()), "writer": F.lit(uuid.uuid4().hex)})


def _day_keys(rows: DataFrame) -> list[str]:
    return [c for c in ("etf_code", "data_date") if c in rows.columns]


def append_new_dates(rows: DataFrame, path: str) -> None:
    """First writer wins: only the days (of a fund, with an `etf_code`) that the
    table does not hold yet are added. Partitioned by month: a directory per day
    would leave one tiny file for each; a month's days are written by several
    tasks.

    Rows carry their writer. Two writers at once may both add a day, as neither
    sees the other; `read_first_dates` then gives the rows of one of them."""
    spark = rows.sparkSession
    if _exists(spark, path):
        keys = _day_keys(rows)
        months = rows.select(F.date_format("data_date", "yyyyMM").cast("int").alias("data_month")).distinct()
        stored = spark.read.parquet(path).join(months, "data_month", "left_semi").select(*keys).distinct()
        rows = rows.join(stored, keys, "left_anti")
    month = _signed(rows).withColumn("data_month", F.date_format("data_date", "yyyyMM"))
    month.repartition("data_month", F.pmod(F.xxhash64("data_date"), F.lit(SINK_TASKS))).write.mode("append").partitionBy("data_month").parquet(path)


def read_first_dates(spark: SparkSession, path: str) -> DataFrame:
    """What `append_new_dates` stored: of a day's writers the first, with all rows it gave for that day.

    Only days and writers are grouped; those that came late are nearly always none, and leave by an anti-join."""
    stored = spark.read.parquet(path)
    keys = _day_keys(stored)
    writers = stored.select(*keys, *WRITER).distinct()
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*WRITER))
    late = writers.withColumn("_place", place).filter("_place > 1").drop("_place")
    return stored.join(late, [*keys, *WRITER], "left_anti").drop(*WRITER)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def _quoted(name: Column) -> Column:
    """A cell of CSV text."""
    marked = F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(name.rlike('[",]'), marked).otherwise(name)


def write_wide_csv(wide: DataFrame, path: str) -> None:
    """A row per date and a column per stock and measure, as CSV text with two header rows: stocks, then measures.

    `wide` is that of `wide_maps`, for any number of stocks. The rows are in order of date over the files of the folder,
    the headers first. Names hold no line breaks.

    Lines are made once, to a scratch table, and put in order from there: the sort reads its input twice.
    """
    spark = wide.sparkSession
    rows = wide.select("Date", F.sort_array(F.map_entries("stocks")).alias("cells"))

    def cell(c: Column) -> Column:
        return F.concat_ws(",", *[F.coalesce(c["value"][m].cast("string"), F.lit("")) for m in WIDE_MEASURES])

    values = F.concat_ws(",", F.array(F.col("Date").cast("string")), F.transform("cells", cell))
    # Every date has every stock: the headers come from any one of them. The first row of each task brings its stocks.
    leads = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    scratch = shared_dir(spark, "lines")
    made = rows.select("Date", values.alias("value"), F.when(leads, F.transform("cells", lambda c: c["key"])).alias("names"))
    made.write.parquet(scratch)
    stored = spark.read.schema(made.schema).parquet(scratch)
    one = stored.filter("names IS NOT NULL").limit(1)
    names = F.flatten(F.transform("names", lambda n: F.array_repeat(_quoted(n), len(WIDE_MEASURES))))
    measures = F.flatten(F.transform("names", lambda n: F.array(*[F.lit(m) for m in WIDE_MEASURES])))
    no_date = F.lit(None).cast("date").alias("Date")
    lines = (
        one.select(F.lit(0).alias("kind"), no_date, F.concat_ws(",", F.array(F.lit("")), names).alias("value"))
        .unionByName(one.select(F.lit(1).alias("kind"), no_date, F.concat_ws(",", F.array(F.lit("Date")), measures).alias("value")))
        .unionByName(stored.select(F.lit(2).alias("kind"), "Date", "value"))
    )
    lines.orderBy("kind", "Date").select("value").write.mode("overwrite").text(path)


# The measures of a stock in the wide file.
WIDE_MEASURES = ("volume", "weight")


def _cells(line: Column) -> Column:
    """The cells of a line of CSV text; the pattern is for lines that hold a quotation mark."""
    # One more comma, so that every cell ends with one.
    found = F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit('("(?:[^"]|"")*"|[^,]*),'), 1)
    plain = F.transform(found, lambda c: F.when(c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), plain).otherwise(F.split(line, ","))


def read_wide_csv(spark: SparkSession, path: str) -> DataFrame:
    """The rows (Date, stock, volume, weight) of a wide file with two header rows, in whatever order its columns are.
    Only the two header lines meet in one task.

    A line gives its rows by the places that the headers name for each stock. Only rows of lines with the same date are grouped.
    """
    place = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    lines = spark.read.text(path).select(place.alias("place"), "value")
    heads = (
        lines.orderBy("place")
        .limit(2)
        .select("place", _cells(F.col("value")).alias("cells"))
        .agg(F.min_by("cells", "place").alias("stocks"), F.max_by("cells", "place").alias("measures"), F.max("place").alias("upto"))
        .withColumn("width", F.greatest(F.size("stocks"), F.size("measures")))
    )
    # A stock's columns, counted from 1: its first one, and those of each measure.
    named = heads.select(F.posexplode(F.slice(F.arrays_zip("stocks", "measures"), 2, F.col("width"))).alias("i", "at"))
    at = (F.col("i") + 2).alias("at")
    of = [F.collect_list(F.when(F.col("at.measures") == m, at)).alias(m) for m in WIDE_MEASURES]
    columns = named.groupBy(F.col("at.stocks").alias("stock")).agg(F.min(at).alias("first"), *of)
    heads = heads.select("upto", "width").crossJoin(columns.agg(F.collect_list(F.struct("stock", "first", *WIDE_MEASURES)).alias("columns")))
    start = F.when(F.contains("value", F.lit('"')), _cells(F.col("value"))[0]).otherwise(F.substring_index("value", ",", 1))
    body = (
        lines.crossJoin(F.broadcast(heads))
        .filter(F.col("place") > F.col("upto"))
        .select(start.cast("date").alias("Date"), "value", "width", "columns")
    )
    again = body.groupBy("Date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("Date").alias("again"))

    def rows_of(kind: str) -> DataFrame:
        some = body.join(F.broadcast(again), F.col("Date").eqNullSafe(F.col("again")), kind).withColumn("cells", _cells(F.col("value")))
        # A short line has no stock that begins more than one cell behind its end; what a long line has too much is of no stock.
        n = F.size("cells")
        none = F.struct(F.lit(None).cast("string").alias("stock"), F.lit(0).alias("first"), *[F.array().cast("array<int>").alias(m) for m in WIDE_MEASURES])
        held = (
            F.when(n + 1 < F.col("width"), F.filter("columns", lambda s: s["first"] <= n + 1))
            .when((n > F.col("width")) & ~F.exists("columns", lambda s: s["stock"].isNull()), F.concat("columns", F.array(none)))
            .otherwise(F.col("columns"))
        )

        def number(i: Column) -> Column:
            # An empty cell is left out before the cast, which costs an exception for each.
            return F.nullif(F.get("cells", i - 1), F.lit("")).try_cast("double")

        def largest(places: Column) -> Column:
            return F.when(F.size(places) > 1, F.array_max(F.transform(places, number))).otherwise(number(F.get(places, F.lit(0))))

        # Made within the line: cells that went along with every row would be copied for each.
        made = F.transform(held, lambda s: F.struct(s["stock"].alias("stock"), *[largest(s[m]).alias(m) for m in WIDE_MEASURES]))
        return some.select("Date", F.inline(made))

    repeated = rows_of("left_semi").groupBy("Date", "stock").agg(*[F.max(m).alias(m) for m in WIDE_MEASURES])
    return rows_of("left_anti").unionByName(repeated)


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)


def stored_trials(spark: SparkSession, path: str) -> DataFrame | None:
    return spark.read.parquet(path) if _exists(spark, path) else None


def upsert_best(best: DataFrame, path: str) -> None:
    """Keep the better of the stored and the given row of each stage, the stored
    one on a tie. A row is added where it beats those that are there, and nothing
    is overwritten: writers at once cannot lose each other's rows, and `read_best`
    takes the best of all."""
    spark = best.sparkSession
    best = best_per_stage(best)
    if _exists(spark, path):
        least = spark.read.parquet(path).groupBy("stage").agg(F.min("mae").alias("_least"))
        best = best.join(least, "stage", "left").filter("_least IS NULL OR mae < _least").drop("_least")
    _signed(best).write.mode("append").partitionBy("stage").parquet(path)


def read_best(spark: SparkSession, path: str) -> DataFrame:
    """The best row of each stage that `upsert_best` stored; of equal ones the first written."""
    w = W.partitionBy("stage").orderBy("mae", *WRITER)
    stored = spark.read.parquet(path)
    return stored.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", *WRITER)
