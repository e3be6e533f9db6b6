"""Near duplicates by SimHash and pigeonhole blocks.

Every text gets a 64-bit fingerprint of its word shingles.  Two fingerprints that
differ in at most ``distance`` bits agree in at least ``blocks - distance`` of any
``blocks`` bit ranges, so fingerprints are joined on each choice of that many ranges
and only rows that share a key are compared.  The number of ranges grows with the
number of distinct fingerprints to keep keys selective; every choice finds the same
pairs.  A key that many fingerprints share is split again over the bits outside it, by
the same rule, until its bucket is small.

Buckets hold distinct fingerprints, so thousands of copies are one entry.  A bucket
returns at most one link per entry (a spanning forest of its close pairs), never all
pairs.  Components are found over fingerprints by repeated star contraction with each
round written to the shared folder; documents only meet the finished table.

Defined cases: null is an empty text; a text without words has fingerprint zero and
is linked like any other; null ids are allowed, the smallest non-null id names the
component; repeated rows share a fingerprint and so a component.  Columns are carried
along, those named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import LOWER, UPPER, bloom_hits, bloom_of, set_aside, skew_join, stage

WORDS = 3
DISTANCE = 3
SEED = 42
BUCKET_ROWS = 2_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def lower_words(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_LOWER).split()


def fingerprint(raw: bytes | None, words: int = WORDS) -> int:
    """SimHash of a text's word shingles, repeats included, as an unsigned integer."""
    from xxhash import xxh64_intdigest

    parts = lower_words(raw)
    if not parts:
        return 0
    if len(parts) <= words:
        hashes = [xxh64_intdigest(b" ".join(parts), SEED)]
    else:
        text = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = [xxh64_intdigest(text[a:b], SEED) for a, b in spans]
    ones = np.zeros(64, np.int64)
    array = np.array(hashes, dtype="<u8")
    for at in range(0, len(array), 1 << 16):
        part = array[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(array), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, words: int = WORDS, *, text: str = "text", name: str = "_print") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(v.as_py(), words) for v in batch.column(batch.num_columns - 1)], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints, pa.int64())], names=[*batch.schema.names[:-1], name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.withColumn("_raw", F.col(text).cast("binary")).mapInArrow(run, schema)


def ranges_for(prints: int, distance: int = DISTANCE) -> int:
    """Least number of ranges whose keys have more values than there are fingerprints."""
    blocks = distance + 1
    while (64 * (blocks - distance)) // blocks < max(1, prints).bit_length() + 1 and comb(blocks, distance) < 200:
        blocks += 1
    return blocks


def _masks(free: list[int], blocks: int, distance: int) -> list[int]:
    """Masks of the bits in each choice of ``blocks - distance`` of ``blocks`` ranges of ``free``."""
    parts = [p for p in np.array_split(np.array(free), min(blocks, len(free))) if len(p)]
    keep = max(0, len(parts) - distance)
    return [sum(1 << int(b) for p in chosen for b in p) for chosen in combinations(parts, keep)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(rows: DataFrame, masks: list[int]) -> DataFrame:
    """A row per mask: the bits fixed so far (``mask``) and their values (``bits``)."""
    each = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return rows.withColumn("mask", each).withColumn("bits", F.col("print").bitwiseAND(F.col("mask")))


def _forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join exactly the fingerprints joined by chains of close pairs."""
    root = np.arange(len(prints))
    links = []
    unsigned = prints.view(np.uint64)
    for i in range(1, len(prints)):
        near = np.flatnonzero(np.bitwise_count(unsigned[:i] ^ unsigned[i]) <= distance)
        for r in np.unique(root[near]):
            links.append((int(prints[r]), int(prints[i])))
            root[root == r] = i
    return links


def links(prints: DataFrame, distance: int = DISTANCE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (``a``, ``b``) between distinct fingerprints (column ``print``)."""
    free = list(range(64))
    rows = _keyed(prints.select("print"), _masks(free, ranges_for(prints.count(), distance), distance))
    found = []
    while True:
        rows = stage(rows)
        sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        large = stage(sizes.where(F.col("n") > bucket_rows).select("mask", "bits", F.expr("bit_count(mask)").alias("fixed")))
        # A bucket whose free bits allow no more rows than the bound needs no split.
        small = rows.join(sizes.where(F.col("n") <= bucket_rows).select("mask", "bits"), ["mask", "bits"], "left_semi")
        found.append(_within(small, distance))
        if large.isEmpty():
            break
        rows = _split(rows.join(large.select("mask", "bits"), ["mask", "bits"], "left_semi"), distance)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def _split(rows: DataFrame, distance: int) -> DataFrame:
    """Large buckets keyed by more bits: per mask, the choices of its free bits."""
    masks = [r[0] for r in rows.select("mask").distinct().collect()]  # at most the number of choices
    table = []
    for m in masks:
        free = [b for b in range(64) if not m >> b & 1]
        table += [(m, _signed((m & (1 << 64) - 1) | extra)) for extra in _masks(free, distance + 3, distance)]
    finer = rows.sparkSession.createDataFrame(table, "mask long, finer long")
    rows = rows.join(F.broadcast(finer), "mask").select("print", F.col("finer").alias("mask"))
    return rows.withColumn("bits", F.col("print").bitwiseAND(F.col("mask"))).distinct()


def _within(rows: DataFrame, distance: int) -> DataFrame:
    """Spanning links of the close pairs in each bucket (mask, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> list[tuple[int, int]]:
            return _forest(np.array(held, np.int64), distance) if len(held) > 1 else []

        for batch in batches:
            out = []
            masks, bits, prints = (batch.column(i).to_pylist() for i in range(3))
            for k, p in zip(zip(masks, bits, strict=True), prints, strict=True):
                if k != key:
                    out += done()
                    key, held = k, []
                held.append(p)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
        out = done()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    rows = rows.select("mask", "bits", "print").repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return rows.mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) of every node with a link; root is the smallest node reached.

    Large-star and small-star steps alternate until the links are stars.  Every step
    groups by node with partial minima, so a hub is pre-aggregated before the shuffle.
    """
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = stage(small.where("u <> v").distinct())
        # Stars: no node is both a leaf and a centre, and each leaf has one centre.
        chained = after.select("u").intersect(after.select("v")).isEmpty()
        single = after.groupBy("u").count().where("count > 1").isEmpty()
        edges = after
        if chained and single:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def classes_of(prints: DataFrame, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Per distinct ``print``: its documents ``n``, ``component_id``, ``root`` and ``members``
    (documents of the component), from rows (``id``, ``print``); ``linked`` finds the links."""
    classes = stage(prints.groupBy("print").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least")))
    roots = components(linked(classes))
    joined = classes.join(roots, classes["print"] == roots["node"], "left")
    joined = stage(joined.withColumn("root", F.coalesce("root", "print")).select("print", "n", "least", "root"))
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("members"), F.count(F.lit(1)).alias("_prints"))
    rows = joined.count()
    return stage(skew_join(joined, named, "root", "_prints", rows, F.col("print")).drop("_prints", "least"))


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``fingerprint`` (16 hex digits) and ``component_id``."""
    printed = with_fingerprints(docs.select(id_col, text), words, text=text).drop(text)
    printed = stage(printed.select(F.col(id_col).alias("id"), F.col("_print").alias("print")))
    table = classes_of(printed, lambda prints: links(prints, distance)).select("print", "n", "component_id")
    out = skew_join(printed, table, "print", "n", printed.count(), F.col("id"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay: of each component one row with the smallest id, with all its columns.

    Only texts whose fingerprint has company are shuffled.
    """
    inner, names, own = set_aside(docs)
    printed = stage(with_fingerprints(inner, words, text=names[text]))
    doc = F.col(names[id_col])
    prints = printed.select(doc.alias("id"), F.col("_print").alias("print"))
    table = classes_of(prints, lambda classes: links(classes, distance))
    shared = stage(table.where("members > 1"))
    marked = bloom_hits(printed, [F.col("_print")], stage(bloom_of(shared.select("print"))), "_shared")
    rest = marked.where("_shared").withColumnRenamed("_print", "print")
    rest = skew_join(rest, shared, "print", "n", printed.count(), doc)
    alone = rest.where("root is null").select(own)
    rest = rest.where(F.col("root").isNotNull() & doc.eqNullSafe(F.col("component_id")))
    # Rows of the same id: the same one on every run.
    order = Window.partitionBy("root").orderBy(F.xxhash64(names[text]), F.xxhash64(*names.values()))
    first = rest.withColumn("_no", F.row_number().over(order)).where("_no = 1").select(own)
    return marked.where("not _shared").select(own).unionByName(alone).unionByName(first)
