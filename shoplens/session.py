"""Spark session defaults shared by the library, the tests and the bench."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC wall clock (the reference normalises all
# timestamps to UTC-naive), adaptive execution for skew and partition sizing,
# Arrow for the few pandas-backed operators.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shoplens") -> SparkSession:
    """Build (or reuse) a session with the library defaults.

    ``master``/``shuffle_partitions`` are only applied when given, so on a
    cluster the submit-time configuration wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in DEFAULT_CONF.items():
        if key not in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset, a
    local session (tests) gets a fresh scratch folder; on a cluster that is an
    error, since a machine's own folder is not seen by the others.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="shoplens-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # noqa: BLE001 - some deployments refuse runtime core settings
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def bound_batches(spark: SparkSession, max_bytes: int = 4 << 20) -> None:
    """Cap the Arrow batches that the session's tasks exchange with Python at about ``max_bytes`` each.

    By default a batch is 10 000 rows or 64 MB. Of long texts that is tens of MB,
    held more than once by the JVM and by Python in every running task.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(max_bytes))


def cut_lineage(df):
    """Materialise ``df`` into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df):
    """Give CPU-heavy per-row work at least one partition per core.

    Small inputs (few parquet row groups) would otherwise run on a few cores;
    large inputs already have far more partitions than cores and are left
    untouched (no extra shuffle).
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df
