"""Structured Streaming forms of the change, freshness and trace jobs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..functions import text
from ..operators.history import History
from ..operators.ordered import shared_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_folder(spark: SparkSession, folder: str, schema, glob: str = "*", files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream.

    Without ``files_per_trigger`` a trigger takes all files that are there, so rows of a
    stored folder never come late, whatever the number and order of its files.  Set it
    to bound a batch where files arrive in order of time.
    """
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


# --- changes on arrival ----------------------------------------------------------


def stream_changes(attempts: DataFrame, history: History) -> DataStreamWriter:
    """Writer that adds every trigger's attempts to ``history`` and keeps its changes there.

    What an attempt is compared with lies in the history's tables, not in a task: a
    provider's rows of one trigger are put in order by range partitions, so a provider may
    have any share of them, and texts are read by hash for pairs that differ.  A trigger
    that is run again, after a failure or with a new checkpoint, changes nothing.
    ``history.changes()`` gives, trigger by trigger,

    * ``flag``: an attempt whose hash differs from the previous attempt's,
    * ``pair``: a changed price line,
    * ``late``: an attempt older than one of an earlier trigger.  It changes no state and
      is reported, not lost.
    """

    def add(rows: DataFrame, batch: int) -> None:
        history.add(rows, batch)
        history.keep_changes(batch)

    return attempts.writeStream.foreachBatch(add)


def stream_history(attempts: DataFrame, history: History) -> DataStreamWriter:
    """Writer that only merges: state tables as after a run over all attempts so far."""
    return attempts.writeStream.foreachBatch(lambda rows, batch: history.add(rows, batch))


def run_into(writer: DataStreamWriter, checkpoint: str) -> None:
    """Everything available now; ``checkpoint`` remembers what has been read."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# --- freshness and trace counts ------------------------------------------------------


class _KeepFirst(StatefulProcessor):
    """Keeps the time of the provider's last kept request until its life ends."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "last BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Two numbers a row: order within a trigger is ours to make.
        parts = [(frame["us"].to_numpy(np.int64), frame["event_id"].to_numpy(np.int64)) for frame in rows]
        us, event = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((event, us))
        us, event = us[order], event[order]
        before = self.last.get()[0] if self.last.exists() else None
        at = 0 if before is None else int(np.searchsorted(us, before))
        kept, last = [], before
        late = slice(0, at)
        while True:
            # The next one kept is the first that its predecessor does not cover.
            at = at if last is None else int(np.searchsorted(us, last + self.life))
            if at >= len(us):
                break
            kept.append(at)
            last = int(us[at])
        if last != before:
            if before is not None:
                self.handle.deleteTimer(self._end(before))
            self.last.update((last,))
            self.handle.registerTimer(self._end(last))
        for part, is_late in ((np.array(kept, np.int64), False), (np.arange(len(us))[late], True)):
            for start in range(0, len(part), 10_000):
                some = part[start : start + 10_000]
                yield pd.DataFrame({"provider": key[0], "event_id": event[some], "us": us[some], "late": is_late})

    def _end(self, last: int) -> int:
        """Milliseconds from which no request of the provider is covered any more."""
        return -(-(last + self.life) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_dedup(requests: DataFrame, ttl_hours: int = text.CACHE_TTL_HOURS, lateness: str = "24 hours") -> DataFrame:
    """Requests that no kept request of the same provider precedes by less than the TTL:
    provider, event_id, ts, late.

    The state is the time of the provider's last kept request; a timer clears it when the
    watermark, which trails the newest request by ``lateness``, has passed the end of its
    life.  Rows are taken in (ts, event_id) order within a trigger, so for input that arrives
    in order of time the result does not depend on the trigger size.  A request older than
    the last kept one comes back with ``late`` set and changes no state; one older than the
    watermark is dropped, which :func:`run_available` reports as an error.
    """
    rows = requests.select("provider", "event_id", F.unix_micros("ts").alias("us"), F.col("ts").alias("at"))
    out = rows.withWatermark("at", lateness).groupBy("provider").transformWithStateInPandas(
        _KeepFirst(int(ttl_hours) * 3_600_000_000),
        "provider STRING, event_id BIGINT, us BIGINT, late BOOLEAN",
        "append",
        "EventTime",
    )
    return out.select("provider", "event_id", F.timestamp_micros("us").alias("ts"), "late")


def stream_stage_counts(trace: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Events per stage in tumbling windows; rows later than the watermark are
    not counted."""
    return (
        trace.withWatermark("ts", lateness)
        .groupBy(F.window("ts", width), "stage")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "stage", "events")
    )


@contextmanager
def state_on_disk(spark: SparkSession):
    """State functions with timers need the RocksDB store; the session's own choice comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is not None:
            spark.conf.set(_STORE, before)


class LateRows(RuntimeError):
    """Rows came behind the watermark and are not in the result."""


def run_available(
    stream: DataFrame, output_mode: str = "append", allow_late: bool = False, progress: Callable[[list], None] | None = None
) -> DataFrame:
    """Run a stream over everything available now, into a new table in the shared
    checkpoint folder, and return that table.

    Rows that a watermark dropped make it fail with :class:`LateRows`, unless
    ``allow_late``: nothing is left out in silence.  ``progress`` gets the triggers' reports.
    """
    spark = stream.sparkSession
    base = shared_path(spark, "stream")
    with state_on_disk(spark):
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/table")
            .option("checkpointLocation", f"{base}/state")
            .outputMode(output_mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    if progress is not None:
        progress(query.recentProgress)
    # Counts of the latest triggers (spark.sql.streaming.numRecentProgressUpdates of them).
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    if dropped and not allow_late:
        raise LateRows(f"{dropped} rows came behind the watermark; table so far: {base}/table")
    return spark.read.schema(stream.schema).parquet(f"{base}/table")
