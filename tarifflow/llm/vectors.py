"""Rows of vectors dealt to shards, and every query row brought to every shard.

Used by the searches over embeddings.  A shard is a bounded piece of the table
(``SHARD_BYTES`` of components), held by one task at a time.  Query rows go to all
shards, cut into slices, so neither a shard nor a task grows with the table.
"""

from __future__ import annotations

import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

# Bytes of components (4 or 8 each) in a shard: about 8,000 vectors of 64 floats.
SHARD_BYTES = 2 << 20
# Query rows that meet one shard in one task.
SLICE_ROWS = 4_096
# Shards and slices beyond this number share partitions; each is still handled alone.
MOST_PARTITIONS = 20_000


def usable(vector: Column) -> Column:
    """Not null, not empty, and free of null and non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def dealt(df: DataFrame, id_col: str, vector: str, keep: Callable[[Column], Column], shard_bytes: int = SHARD_BYTES, **more: Column) -> tuple[DataFrame, int]:
    """(rows, shards): ``row`` (one number per row, also for rows alike in all columns),
    ``id``, ``vec``, the columns of ``more``, and ``shard``.

    Written once below ``spark.checkpoint.dir``, so numbers and shards stay as they are
    when an executor is lost.  A hash of the row number deals, whatever the ids are.
    """
    kind = df.schema[vector].dataType.elementType.typeName()
    vec = F.col(vector) if kind in ("float", "double") else F.col(vector).cast("array<double>")
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), vec.alias("vec"), *[c.alias(n) for n, c in more.items()])
    rows = stage(rows.where(keep(F.col("vec"))))
    parts = rows.agg(F.sum(F.size("vec").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(parts * (4 if kind == "float" else 8) / shard_bytes))
    return rows.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")), shards


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def by_dimension(table: pa.Table, vector: str = "vec") -> Iterator[tuple[int, pa.Table]]:
    """The rows of each vector length: only vectors of one length can be compared."""
    sizes = pa.compute.list_value_length(table.column(vector))
    for dim in pa.compute.unique(sizes).to_pylist():
        yield dim, table.filter(pa.compute.equal(sizes, dim))


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as arrays:
        return dict(arrays)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches, each of one key; keys come in order."""
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if len(keys):
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield int(keys[a]), batch.slice(a, b - a)


def indexed(rows: DataFrame, shards: int, build: Callable[[int, int, pa.Table], bytes | None]) -> DataFrame:
    """One row (shard, dim, data) per shard and vector length: ``build(shard, dim, its rows)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(shard: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for dim, table in by_dimension(pa.Table.from_batches(parts)):
                if (data := build(shard, dim, table)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([dim], pa.int32()), pa.array([data], pa.large_binary())], names=["shard", "dim", "data"])

        at, parts = None, []
        for shard, part in _runs(batches, "shard"):
            if shard != at and parts:
                yield from done(at, parts)
                parts = []
            at = shard
            parts.append(part)
        if parts:
            yield from done(at, parts)

    partitions = min(shards, MOST_PARTITIONS)
    laid = rows.repartitionById(partitions, F.pmod("shard", F.lit(partitions))).sortWithinPartitions("shard")
    return stage(laid.mapInArrow(run, "shard int, dim int, data binary"))


def searched(
    index: DataFrame,
    shards: int,
    queries: DataFrame,
    open_index: Callable[[dict[str, np.ndarray]], object],
    search: Callable[[object, pa.Table], Iterator[pa.RecordBatch]],
    schema: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``search(index, query rows)`` for all pairs of an index row and query rows of its length.

    Index rows and query rows of the same (shard, slice) meet in one partition, index
    rows first, and are read as a stream: a task holds one shard and one batch of queries.
    """
    columns = [c for c in queries.columns if c != "shard"]
    slices = max(1, math.ceil(queries.count() / slice_rows))
    mine = F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(slices)).cast("int")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in queries.schema.fields}
    dim = F.size("vec").cast("int").alias("dim")
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    asked = queries.select(*columns, mine.alias("_slice"), dim, F.lit(None).cast("binary").alias("data"), shard.alias("shard"))
    held = index.select(*[empty[c].alias(c) for c in columns], F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), "dim", "data", "shard")
    both = asked.unionByName(held).withColumn("_key", F.col("shard") * F.lit(slices).cast("long") + F.col("_slice")).drop("shard", "_slice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, {}
        for key, part in _runs(batches, "_key"):
            if key != at:
                at, known = key, {}
            part = pa.Table.from_batches([part])
            is_index = pa.compute.is_valid(part.column("data"))
            for row in part.filter(is_index).select(["dim", "data"]).to_pylist():
                known[row["dim"]] = open_index(unpacked(row["data"]))
            for dim, some in by_dimension(part.filter(pa.compute.invert(is_index)).drop_columns(["data"])):
                if dim in known:
                    yield from search(known[dim], some)

    partitions = min(shards * slices, MOST_PARTITIONS)
    laid = both.repartitionById(partitions, F.pmod("_key", F.lit(partitions)).cast("int")).sortWithinPartitions("_key", F.col("data").isNull(), "row")
    return laid.mapInArrow(run, schema)
