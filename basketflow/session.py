"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Runtime settings every plan relies on. AQE and ANSI keep Spark 4's defaults.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
}


def build_session(
    app_name: str = "basketflow",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or get) a session. On a cluster leave `master` and
    `shuffle_partitions` unset: spark-submit supplies the former, and AQE
    coalesces whatever the cluster configures for the latter."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the cluster's `spark.checkpoint.dir`, or below the
    warehouse where that is not set. Both are folders that all executors reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return os.path.join(root, f"{purpose}-{uuid.uuid4().hex[:12]}")
