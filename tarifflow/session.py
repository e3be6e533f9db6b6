"""Session settings the jobs are written for.

None of them is needed for right results; all but the last two groups are Spark
defaults, spelled out because the plans rely on them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Joins against a hot key: split the skewed side at run time, even if that
    # costs one more shuffle.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Checkpoints go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Late rows of every trigger are counted, not of the last hundred alone.
    "spark.sql.streaming.numRecentProgressUpdates": "100000",
    # Naive page times must not move with the machine's zone.
    "spark.sql.session.timeZone": "UTC",
    # Diffs carry two capped texts per row: keep an Arrow batch near 100 MB.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Per-provider stream state holds texts: keep it on disk, not on the heap.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def last_key_wins(spark: SparkSession) -> None:
    """A JSON object that repeats a key keeps the last value, as most readers do; Spark
    would take the whole text for malformed."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def build(app: str = "tarifflow", **extra: str) -> SparkSession:
    """A session with these settings; master, memory and ``spark.checkpoint.dir``
    (a folder all executors share) come from the submit command."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
