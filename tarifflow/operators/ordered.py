"""Ordered per-key computations that survive hot keys.

``lag``, row numbers and running maxima over ``PARTITION BY key ORDER BY t`` put
a whole key into one task.  That is fine for almost every provider and fatal for
one that owns a third of the rows.  :class:`OrderedScan` therefore treats keys by
their measured size:

* keys up to ``split_rows`` rows use the plain window function (one shuffle);
* larger keys are range-partitioned on (key, order) into even chunks.  Each chunk
  is computed by itself, one summary row per (key, chunk) is combined over the
  chunks before it, and the carried value is added back.

Hot keys are looked for in two steps on the key columns only: rows are counted in a
fixed number of buckets of key hashes, which moves a few bytes per bucket and task, and
keys by name only within buckets that hold more than ``split_rows`` rows.
Chunk numbers are stored with the rows by a reliable ``checkpoint()``, so a lost
executor cannot change them half way.  The order columns must identify a row
within its key, otherwise ties would be resolved differently on each attempt.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SPLIT_ROWS = 1_000_000
# Carry and hot-key tables (narrow rows) up to this size are broadcast; beyond it
# the join is left to the optimizer.
BROADCAST_ROWS = 200_000
# Buckets of key hashes that rows are counted in before keys are.
HASH_BUCKETS = 1 << 14
_CHUNK = "_chunk"
_GLOBAL = "_all"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; pick one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="run-")
    context.setCheckpointDir(configured)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the folder all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    For results that several later steps read: unlike a row checkpoint, the files
    are columnar, so a step that needs three narrow columns reads no texts.  They are
    packed with zstd: texts and hexadecimal hashes take half of what snappy leaves.
    """
    path = shared_path(df.sparkSession, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of few files out to all cores before costly row-wise work.

    A table with at least two partitions per core is left alone, so on large
    inputs this adds no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if _partitions(df) < 2 * cores else df


class OrderedScan:
    """Running computations over rows ordered within a key.

    Every method returns a new scan with one more column; :meth:`frame` gives the
    finished DataFrame.  ``keys`` may be empty, which means one global order.
    ``cold`` says that no key can be hot, so that ``df`` is not read to find out.
    """

    def __init__(
        self,
        df: DataFrame,
        keys: Sequence[str],
        order: Sequence[str],
        *,
        descending: bool = False,
        split_rows: int = SPLIT_ROWS,
        cold: bool = False,
    ):
        self.keys = list(keys) or [_GLOBAL]
        self.order_names = list(order)
        self.descending = descending
        if not keys:
            df = df.withColumn(_GLOBAL, F.lit(0))
        sizes = None if cold else self._sizes(df, split_rows)
        n_hot, rows = (0, 0) if sizes is None else sizes.agg(F.count(F.lit(1)), F.sum("_n")).first()
        self._settled, self._n_hot = True, n_hot
        if n_hot == 0:
            self.cold, self.hot = df, None
            return
        hot = sizes.select(*[F.col(k).alias(f"_hot_{k}") for k in self.keys])
        # A null key may be the hot one.
        same = self._same("_hot_")
        if n_hot <= BROADCAST_ROWS:
            hot = F.broadcast(hot)
        self.cold = df.join(hot, same, "left_anti")
        # A fixed number of ranges, which adaptive execution does not merge.
        chunks = max(2, 2 * rows // split_rows)
        ranged = df.join(hot, same, "left_semi").repartitionByRange(chunks, *self.keys, *self._order())
        self.hot = durable(ranged.withColumn(_CHUNK, F.spark_partition_id()))

    # -- building blocks -------------------------------------------------------

    def _sizes(self, df: DataFrame, split_rows: int) -> DataFrame | None:
        """Keys of more than ``split_rows`` rows with their number; none if no bucket of
        hashes, and so no key, has that many."""
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(HASH_BUCKETS))
        counts = df.select(*self.keys, bucket.alias("_bucket"))
        full = counts.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_rows).select("_bucket").collect()
        if not full:
            return None
        named = counts.where(F.col("_bucket").isin([r[0] for r in full])).groupBy(*self.keys)
        return durable(named.agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > split_rows))

    def _same(self, prefix: str, extra: Sequence[str] = ()) -> Column:
        """Null-safe equality of the keys with their renamed copies."""
        return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in (*self.keys, *extra)])

    def _order(self) -> list[Column]:
        return [F.col(c).desc() if self.descending else F.col(c).asc() for c in self.order_names]

    def _with(self, cold: DataFrame, hot: DataFrame | None, settled: bool) -> "OrderedScan":
        scan = object.__new__(OrderedScan)
        scan.keys, scan.order_names, scan.descending = self.keys, self.order_names, self.descending
        scan.cold, scan.hot, scan._settled, scan._n_hot = cold, hot, settled, self._n_hot
        return scan

    def _scan(
        self,
        name: str,
        local: Callable[[Window], Column],
        summary: Column,
        combine: Callable[[Window], Column],
        merge: Callable[[Column, Column], Column],
    ) -> "OrderedScan":
        plain = Window.partitionBy(*self.keys).orderBy(*self._order())
        cold = self.cold.withColumn(name, local(plain))
        if self.hot is None:
            return self._with(cold, None, True)
        # Rows and their summaries both read the chunks: without this, each
        # further scan would double the work of the ones before it.
        chunks = self.hot if self._settled else durable(self.hot)
        chunk_keys = [*self.keys, _CHUNK]
        # Ranges ascend with the declared order, so chunk numbers do as well.
        before = Window.partitionBy(*self.keys).orderBy(_CHUNK)
        carry = (
            chunks.groupBy(*chunk_keys)
            .agg(summary.alias("_summary"))
            .withColumn("_carry", combine(before))
            .select(*[F.col(k).alias(f"_c_{k}") for k in chunk_keys], "_carry")
        )
        # Ranges are contiguous, so there are at most (hot keys + ranges) summaries.
        if self._n_hot + _partitions(chunks) <= BROADCAST_ROWS:
            carry = F.broadcast(carry)
        inside = Window.partitionBy(*chunk_keys).orderBy(*self._order())
        hot = (
            chunks.join(carry, self._same("_c_", [_CHUNK]))
            .withColumn(name, merge(local(inside), F.col("_carry")))
            .drop("_carry", *[f"_c_{k}" for k in chunk_keys])
        )
        return self._with(cold, hot, False)

    def _position(self) -> Column:
        return F.struct(*self.order_names)

    def _last(self, value: Column) -> Column:
        pick = F.min_by if self.descending else F.max_by
        return pick(value, self._position())

    # -- operators ----------------------------------------------------------------

    def lag(self, name: str, *columns: str) -> "OrderedScan":
        """Struct of ``columns`` from the row before; null on the first row."""
        value = F.struct(*columns)
        return self._scan(
            name,
            lambda w: F.lag(value).over(w),
            self._last(value),
            lambda w: F.lag("_summary").over(w),
            lambda inside, carried: F.coalesce(inside, carried),
        )

    def running_sum(self, name: str, value: Column) -> "OrderedScan":
        return self._running(name, value, F.sum, lambda a, b: F.coalesce(a + F.coalesce(b, F.lit(0)), b))

    def running_max(self, name: str, value: Column) -> "OrderedScan":
        return self._running(name, value, F.max, F.greatest)

    def running_min(self, name: str, value: Column) -> "OrderedScan":
        return self._running(name, value, F.min, F.least)

    def whole_max(self, name: str, value: Column) -> "OrderedScan":
        """The largest value of the whole key, on each of its rows."""

        def whole(w):
            return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        return self._scan(
            name,
            lambda w: F.max(value).over(whole(w)),
            F.max(value),
            lambda w: F.max("_summary").over(whole(w)),
            lambda inside, carried: carried,
        )

    def whole(self, name: str, **values: tuple[Callable[[Column], Column], Column]) -> "OrderedScan":
        """Struct of largest or smallest values of the whole key, on each of its rows:
        ``whole("w", last=(F.max, x), first=(F.min, x))``, in one step."""

        def each(of: Callable[[str, Callable, Column], Column]) -> Column:
            return F.struct(*[of(n, f, v).alias(n) for n, (f, v) in values.items()])

        def over(w):
            return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        return self._scan(
            name,
            lambda w: each(lambda n, f, v: f(v).over(over(w))),
            each(lambda n, f, v: f(v)),
            lambda w: each(lambda n, f, v: f(f"_summary.{n}").over(over(w))),
            lambda inside, carried: carried,
        )

    def _running(self, name, value, aggregate, merge) -> "OrderedScan":
        def upto(w):
            return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)

        def strictly_before(w):
            return w.rowsBetween(Window.unboundedPreceding, -1)

        return self._scan(
            name,
            lambda w: aggregate(value).over(upto(w)),
            aggregate(value),
            lambda w: aggregate("_summary").over(strictly_before(w)),
            merge,
        )

    def with_column(self, name: str, value: Column) -> "OrderedScan":
        """Row-wise column, usable by the scans that follow."""
        return self._with(
            self.cold.withColumn(name, value),
            None if self.hot is None else self.hot.withColumn(name, value),
            self._settled,
        )

    def frame(self) -> DataFrame:
        parts = [self.cold] if self.hot is None else [self.cold, self.hot.drop(_CHUNK)]
        return reduce(DataFrame.unionByName, parts).drop(_GLOBAL)


def _partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()
