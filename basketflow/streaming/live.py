"""Detection and running totals on a stream of ticks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketflow.functions.scalars import int_div
from basketflow.params import MINUTE_NS, NS, DetectionParams
from basketflow.plans.detect import detect_flow

KEY = ["run_date", "time_str", "stock", "initial_ts_ns", "ts_ns"]
# Batch number of what `flush` writes; later than any batch of a stream.
FLUSH = 2**31 - 1
TICK_TYPES = (
    "run_date date, stock string, ts_ns bigint, src_seq bigint, is_trade boolean, "
    "price double, volume double, bid double, ask double"
)
TICK_COLUMNS = [
    "run_date",
    "stock",
    "ts_ns",
    "src_seq",
    "is_trade",
    "price",
    "volume",
    "bid",
    "ask",
]


def parquet_stream(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files: int = 1) -> DataFrame:
    """Files of a folder as a stream, oldest first."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files)
        .parquet(folder)
    )


def table_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files."""
    found = spark.read.parquet(path).inputFiles()
    folder, name = path.rstrip("/").rsplit("/", 1)
    is_file = len(found) == 1 and found[0].rstrip("/").endswith(f"/{name}")
    return parquet_stream(spark, folder if is_file else path, schema, name if is_file else "*", files)


def minute_flow(flows: DataFrame, delay: str = "45 seconds", width: str = "1 minute") -> DataFrame:
    """Net flow per minute of a stream with `ts` and `signed_value`; a minute
    is final once the watermark has passed it."""
    return (
        flows.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(F.sum("signed_value").alias("net_flow"), F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("minute"), "net_flow", "n")
    )


def tick_rows(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Trades and quotes as one tick table."""
    t = trades.withColumn("is_trade", F.lit(True))
    q = quotes.withColumn("is_trade", F.lit(False))
    return t.unionByName(q, allowMissingColumns=True).select(*TICK_COLUMNS)


class LiveDetector:
    """Runs the batch detection for every minute that has just closed.

    A minute T closes when the newest tick is at least `shift_seconds` younger.
    Each micro-batch stores its ticks, runs the minutes that closed and stores
    what no earlier minute has found. Everything is written below `root` under
    the batch's number and replaced when the batch is repeated, so a restarted
    stream neither loses nor repeats a detection.

    What a batch reads stays small however long the stream runs: ticks and the
    keys of recent detections lie in slots as long as the look-back, progress
    is one row a batch, and once a batch is done all that neither it nor a
    later one can need is removed. Detections are only added to.
    """

    def __init__(self, root: str, weights: DataFrame, params: DetectionParams):
        self.root, self.weights, self.params = root, weights, params
        self.slot_ns = params.calendar.lookback_minutes * MINUTE_NS

    # -- tables below root

    def _read(self, name: str, spark: SparkSession, before: int) -> DataFrame | None:
        """Rows of the batches before the given one."""
        try:
            df = spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        except Exception as exc:
            # No folder yet, or only batches without rows.
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise
        return df.filter(F.col("batch") < before)

    def _write(self, df: DataFrame, name: str, batch: int, *by: str) -> None:
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{self.root}/{name}/batch={batch}")

    def _write_slots(self, df: DataFrame, name: str, batch: int, time: str) -> None:
        """Rows by slot of their time and batch; a repeated batch replaces its own."""
        slotted = df.withColumns({"slot": int_div(F.col(time), self.slot_ns), "batch": F.lit(batch)})
        slotted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(f"{self.root}/{name}")

    def _folder(self, spark: SparkSession, name: str):
        """Hadoop's path of a folder below root, and its file system."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _remove(self, spark: SparkSession, name: str) -> None:
        path, fs = self._folder(spark, name)
        fs.delete(path, True)

    def _expire(self, spark: SparkSession, name: str, key: str, before: int) -> None:
        """Remove the partitions `key=n` of a table with n below the given one."""
        path, fs = self._folder(spark, name)
        if not fs.exists(path):
            return
        for status in fs.listStatus(path):
            label, _, number = status.getPath().getName().partition("=")
            if label == key and number.lstrip("-").isdigit() and int(number) < before:
                fs.delete(status.getPath(), True)

    def _progress(self, spark: SparkSession, batch: int) -> tuple[int | None, int | None, int]:
        """Newest tick, last closed minute and number of the last batch so far."""
        seen = self._read("progress", spark, batch)
        row = seen.agg(F.max("newest_ns"), F.max("closed"), F.max("batch")).first() if seen is not None else None
        return (row[0], row[1], row[2]) if row and row[2] is not None else (None, None, -1)

    # -- processing

    def _forget_flush(self, spark: SparkSession) -> None:
        """Remove what a flush wrote: the stream goes on and closes those minutes again."""
        path, fs = self._folder(spark, "flushed")
        if fs.exists(path):
            self._remove(spark, f"detections/batch={FLUSH}")
            fs.delete(path, True)

    def process(self, ticks: DataFrame, batch: int) -> None:
        spark = ticks.sparkSession
        self._forget_flush(spark)
        self._write_slots(ticks.select(*TICK_COLUMNS), "ticks", batch, "ts_ns")
        stored = self._read("ticks", spark, batch + 1)
        ends = (None,) if stored is None else stored.filter(F.col("batch") == batch).agg(F.min("ts_ns"), F.max("ts_ns")).first()
        if ends[0] is None:
            return
        newest, closed, last = self._progress(spark, batch)
        newest = max(newest or 0, ends[1])
        start = closed if closed is not None else ends[0] // MINUTE_NS - 1
        upto = max(start, (newest - self.params.shift_seconds * NS) // MINUTE_NS)
        if upto > start:
            found = self._detect(spark, batch, start, upto)
            self._write(found, "detections", batch, "run_date")
            written = spark.read.schema(found.schema).parquet(f"{self.root}/detections/batch={batch}")
            self._write_slots(written.select(*KEY), "recent", batch, "initial_ts_ns")
        state = spark.createDataFrame([(newest, upto)], "newest_ns bigint, closed bigint").coalesce(1)
        self._write(state, "progress", batch)
        # A repeated batch starts where this one did, so its own look-back stays.
        for name in ("ticks", "recent"):
            self._expire(spark, name, "slot", self._low(start) // self.slot_ns)
        self._expire(spark, "progress", "batch", last)

    def flush(self, spark: SparkSession) -> None:
        """Close the minutes that are still open once the stream has ended. If it
        goes on after all, the next batch removes what this wrote."""
        newest, closed, _ = self._progress(spark, FLUSH)
        if newest is None:
            return
        last = -(-newest // MINUTE_NS) + self.params.calendar.lookback_minutes
        if last > closed:
            # The mark comes first: results without it would stay for ever.
            spark.createDataFrame([(closed,)], "closed bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/flushed")
            self._write(self._detect(spark, FLUSH, closed, last), "detections", FLUSH, "run_date")

    def _low(self, start: int) -> int:
        """The earliest time in the snapshots of the minutes after `start`."""
        return (start + 1 - self.params.calendar.lookback_minutes) * MINUTE_NS

    def _detect(self, spark: SparkSession, batch: int, start: int, upto: int) -> DataFrame:
        low, high = self._low(start), upto * MINUTE_NS
        ticks = self._read("ticks", spark, batch + 1).filter(
            F.col("slot").between(low // self.slot_ns, high // self.slot_ns) & F.col("ts_ns").between(low, high)
        )
        calendar = replace(self.params.calendar, after_minute=start, upto_minute=upto)
        found = detect_flow(
            ticks.filter("is_trade").select("run_date", "stock", "ts_ns", "src_seq", "price", "volume"),
            ticks.filter("NOT is_trade").select("run_date", "stock", "ts_ns", "src_seq", "bid", "ask"),
            self.weights,
            replace(self.params, calendar=calendar),
        )
        earlier = self._read("recent", spark, batch)
        if earlier is None:
            return found
        recent = earlier.filter((F.col("slot") >= low // self.slot_ns) & (F.col("initial_ts_ns") >= low)).select(*KEY)
        return found.join(recent, KEY, "left_anti")

    def start(self, ticks: DataFrame) -> StreamingQuery:
        return (
            ticks.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.root}/offsets")
            .trigger(availableNow=True)
            .start()
        )

    def detections(self, spark: SparkSession) -> DataFrame:
        found = self._read("detections", spark, 2**31)
        if found is not None:
            return found.drop("batch")
        ticks = spark.createDataFrame([], TICK_TYPES)
        return detect_flow(
            ticks.select("run_date", "stock", "ts_ns", "src_seq", "price", "volume"),
            ticks.select("run_date", "stock", "ts_ns", "src_seq", "bid", "ask"),
            self.weights,
            self.params,
        )
