"""Removing byte strings that occur more than once, by a sparse enhanced suffix array.

A byte goes if it lies in a string of SPAN bytes that also starts somewhere else.

1. Anchors.  Each window of SPAN bytes elects one of its GRAM-byte strings, by a hash
   of the bytes alone, so equal windows elect equal anchors at the same place in them.
   Consecutive windows share anchors: a text has about one per 75 bytes.  The suffixes
   at anchors are the sparse suffix array.
2. Counting.  One job counts anchors by the hash of their gram, pre-aggregated.  Grams
   that occur once cannot belong to a repeat and are never looked at again.
3. Regions.  The windows that elect an anchor span its region (at most 2 * SPAN bytes).
   Where the same region occurs twice all of it goes.
4. Intervals.  For grams whose regions differ, the suffixes from the anchor are sorted,
   a stack scan over their common prefixes walks the tree of common-prefix intervals,
   and each interval is tested for the left extensions of its members: those sorted
   next to each other from the right end of their left contexts reach farthest.  A pair
   whose common left extension and common prefix make SPAN bytes is a repeat; as every
   member meets its nearest neighbours in each interval, all occurrences are found
   without comparing all pairs.
5. A gram with more than LARGE different regions is not held in one task: its windows
   are hashed and counted across the cluster, which finds the same bytes.

Defined cases: null is an empty text; texts shorter than SPAN lose nothing; ids may be
null or repeated; repeated rows are occurrences of their own, so all of them lose the
shared bytes.  Columns are carried along, those named as the results are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bloom_hits, bloom_of, clashing, skew_join, stage

SPAN = 200
GRAM = 50
LARGE = 10_000
# Bytes hashed at a time; longer texts are cut into overlapping parts.
CHUNK = 1 << 20
RESULTS = ("kept", "spans", "n_bytes", "n_removed")
_BLOCKS = 1 << 16
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Anchors:
    """Anchors of many texts at once; one instance per task keeps the tables of powers."""

    def __init__(self, span: int = SPAN, gram: int = GRAM):
        self.span, self.gram = span, gram
        self.up, self.down = _powers(CHUNK + 2 * span)

    def _elect(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(gram hash by place, elected place by window start)."""
        n, k = len(data), self.gram
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        # High bits rank, low bits are the place: of equal grams the leftmost wins.
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        width, need = 1, self.span - k + 1
        while 2 * width <= need:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if need > width:
            least = np.minimum(least[: -(need - width)], least[need - width :])
        return h, (least & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For texts laid end to end in ``data``: per anchor its text, gram hash, place,
        and first and last window (places in ``data``)."""
        if len(data) < self.span:
            return (np.empty(0, np.int64),) * 5
        h, elected = self._elect(data)
        starts = np.concatenate(([0], ends[:-1]))
        doc = np.repeat(np.arange(len(ends)), ends - starts)[: len(elected)]
        valid = np.arange(len(elected)) + self.span <= ends[doc]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (elected[1:] != elected[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        last_valid = valid.copy()
        last_valid[:-1] &= ~valid[1:] | new[1:]
        last = np.flatnonzero(last_valid)
        return doc[first], h[elected[first]].view(np.int64), elected[first], first, last


def _parts(column: pa.Array, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts of a binary column as chunks: (bytes, ends, row of each text, its offset there)."""
    pieces: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def chunk() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return (
            np.concatenate([p[2] for p in pieces]), np.cumsum([len(p[2]) for p in pieces]),
            np.array([p[0] for p in pieces]), np.array([p[1] for p in pieces]),
        )

    for row, value in enumerate(column):
        raw = value.as_buffer() if value.is_valid else None
        size = raw.size if raw is not None else 0
        if size < span:
            continue
        data = np.frombuffer(raw, np.uint8)
        step = CHUNK // 2
        for at in range(0, size - span + 1, step):
            part = data[at : at + step + span - 1]
            if held + len(part) > CHUNK:
                yield chunk()
                pieces, held = [], 0
            pieces.append((row, at, part))
            held += len(part)
    if pieces:
        yield chunk()


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Two longs that name a row by id and text; repeated rows share them."""
    return docs.withColumns({"_row": F.xxhash64(F.col(id_col), F.col(text)), "_row2": F.xxhash64(F.lit(1), F.col(id_col))})


def _grams(docs: DataFrame, text: str, span: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        anchors = Anchors(span, gram)
        for batch in batches:
            for data, ends, _, _ in _parts(batch.column(0), span):
                _, grams, _, first, last = anchors.of(data, ends)
                view = memoryview(np.ascontiguousarray(data))
                regions = [xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), (last + span).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.array(regions, np.uint64).view(np.int64))], names=["gram", "region"])

    return docs.select(F.col(text).cast("binary")).mapInArrow(run, "gram long, region long")


def _filter(grams: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of grams as an array of fixed size (4 MB)."""
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright("gram", 16 + 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(8)]
    rows = grams.groupBy(F.col("gram").bitwiseAND(F.lit(_BLOCKS - 1)).alias("b")).agg(*[F.bit_or(w).alias(f"w{i}") for i, w in enumerate(words)])
    out = np.zeros((_BLOCKS, 8), np.int64)
    got = rows.toArrow()
    out[got.column("b").to_numpy()] = np.stack([got.column(f"w{i}").to_numpy() for i in range(8)], axis=1) if got.num_rows else np.empty((0, 8))
    return out


def _passes(bloom: np.ndarray, grams: np.ndarray) -> np.ndarray:
    rows = bloom[grams & (_BLOCKS - 1)]
    ok = np.ones(len(grams), bool)
    for i in range(8):
        ok &= (rows[:, i] >> ((grams >> (16 + 6 * i)) & 63)) & 1 == 1
    return ok


OCCURRENCE = "_row long, _row2 long, start long, length int, gram long, region binary, anchor int, bytes binary"


def _occurrences(keyed: DataFrame, text: str, repeated: np.ndarray, mixed: np.ndarray, span: int, gram: int) -> DataFrame:
    """Anchors whose gram may repeat; with the bytes of their region if regions may differ."""
    spark = keyed.sparkSession
    shared = spark.sparkContext.broadcast((repeated, mixed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        anchors = Anchors(span, gram)
        repeated, mixed = shared.value
        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for data, ends, rows, offsets in _parts(batch.column(2), span):
                doc, grams, place, first, last = anchors.of(data, ends)
                hit = np.flatnonzero(_passes(repeated, grams))
                doc, grams, place, first, last = doc[hit], grams[hit], place[hit], first[hit], last[hit]
                differ = _passes(mixed, grams)
                raw = data.tobytes()
                texts = [raw[a:b] for a, b in zip(first.tolist(), (last + span).tolist(), strict=True)]
                begins = np.concatenate(([0], ends[:-1]))
                row = rows[doc] if len(doc) else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[0][row]), pa.array(keys[1][row]), pa.array(first - begins[doc] + offsets[doc], pa.int64()),
                        pa.array(last + span - first, pa.int32()), pa.array(grams), pa.array([xxh3_128_digest(t) for t in texts], pa.binary()),
                        pa.array(place - first, pa.int32()), pa.array([t if d else None for t, d in zip(texts, differ.tolist(), strict=True)], pa.binary()),
                    ],
                    names=[f.split()[0] for f in OCCURRENCE.split(", ")],
                )

    return keyed.select("_row", "_row2", F.col(text).cast("binary")).mapInArrow(run, OCCURRENCE)


def _common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def repeat_intervals(texts: list[bytes], anchors: list[int], span: int = SPAN) -> list[list[tuple[int, int]]]:
    """For different regions around one gram: per region the intervals that some other
    region holds too, at the same place relative to the anchor, of ``span`` bytes or more."""
    right = [t[a:] for t, a in zip(texts, anchors, strict=True)]
    left = [t[:a][::-1] for t, a in zip(texts, anchors, strict=True)]
    by_left = sorted(range(len(texts)), key=left.__getitem__)
    suffixes = sorted(range(len(texts)), key=right.__getitem__)
    rank = {i: r for r, i in enumerate(by_left)}
    out: list[list[tuple[int, int]]] = [[] for _ in texts]

    def meet(r: int, q: int, depth: int) -> None:
        i, j = by_left[r], by_left[q]
        reach = _common(left[i], left[j])
        if reach + depth >= span:
            out[i].append((anchors[i] - reach, anchors[i] + depth))
            out[j].append((anchors[j] - reach, anchors[j] + depth))

    def merged(x: list[int], y: list[int], depth: int) -> list[int]:
        """Members of two sub-intervals, sorted by left context; each new neighbour is tested."""
        if len(x) < len(y):
            x, y = y, x
        for r in y:
            at = bisect_left(x, r)
            if at:
                meet(r, x[at - 1], depth)
            if at < len(x):
                meet(r, x[at], depth)
            x.insert(at, r)
        return x

    # Open intervals of the stack scan: (common prefix, members).
    stack: list[tuple[int, list[int]]] = []
    for no, i in enumerate([*suffixes, None]):
        depth = -1 if i is None else _common(right[suffixes[no - 1]], right[i]) if no else -1
        while stack and stack[-1][0] > depth:
            _, members = stack.pop()
            if stack and stack[-1][0] >= depth:
                below, others = stack.pop()
                stack.append((below, merged(others, members, below)))
            elif i is not None:
                stack.append((depth, members))
        if i is not None:
            stack.append((len(right[i]), [rank[i]]))
            if len(stack) > 1 and stack[-2][0] == stack[-1][0]:
                depth, members = stack.pop()
                below, others = stack.pop()
                stack.append((below, merged(others, members, below)))
    return out


RESULT = "region binary, spans array<struct<from: int, to: int>>"


def _by_tree(regions: DataFrame, span: int) -> DataFrame:
    """Repeated intervals of each region of the grams in ``regions``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> list[tuple[bytes, list]]:
            whole = [(r, [(0, length)]) for r, n, length, _, _ in held if n > 1]
            if len(held) < 2:
                return whole
            found = repeat_intervals([h[4] for h in held], [h[3] for h in held], span)
            return whole + [(h[0], f) for h, f in zip(held, found, strict=True) if f and h[1] == 1]

        last = None
        for batch in batches:
            out: list[tuple[bytes, list]] = []
            for g, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != last:
                    out += done()
                    last, held = g, []
                held.append(tuple(rest))
            yield _result(out)
        yield _result(done())

    def _result(out: list[tuple[bytes, list]]) -> pa.RecordBatch:
        spans = pa.array([[{"from": a, "to": b} for a, b in s] for _, s in out], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), spans], names=["region", "spans"])

    rows = regions.select("gram", "region", "n", "length", "anchor", "bytes").repartition("gram").sortWithinPartitions("gram")
    return rows.mapInArrow(run, RESULT)


def _by_windows(regions: DataFrame, span: int) -> DataFrame:
    """The same for grams with very many regions: every window is counted by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = [
                (r, at, xxh3_128_digest(raw[at : at + span]), n)
                for r, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                for at in range(len(raw) - span + 1)
            ]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.binary(), pa.int32(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["region", "at", "window", "n"])

    windows = stage(regions.select("region", "n", "bytes").mapInArrow(run, "region binary, at int, window binary, n long"))
    often = windows.groupBy("window").agg(F.sum("n").alias("_n")).where("_n > 1")
    found = skew_join(windows, often, "window", "_n", windows.count(), F.col("region")).where("_n is not null")
    one = F.struct(F.col("at").alias("from"), (F.col("at") + span).alias("to"))
    return found.groupBy("region").agg(F.collect_list(one).alias("spans"))


def repeated_spans(keyed: DataFrame, text: str = "text", span: int = SPAN, gram: int = GRAM, large: int = LARGE) -> DataFrame:
    """(``_row``, ``_row2``, ``start``, ``spans``): repeated intervals around each anchor,
    relative to ``start`` in the row's bytes."""
    counted = _grams(keyed, text, span, gram).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("a"), F.max("region").alias("b"))
    counted = stage(counted.where("n > 1").select("gram", F.expr("a <> b").alias("mixed")))
    repeated, mixed = _filter(counted), _filter(counted.where("mixed"))
    found = stage(_occurrences(keyed, text, repeated, mixed, span, gram))
    regions = stage(
        found.groupBy("region").agg(
            F.first("gram").alias("gram"), F.count(F.lit(1)).alias("n"), F.first("length").alias("length"),
            F.first("anchor").alias("anchor"), F.max("bytes").alias("bytes"),
        )
    )
    sizes = regions.groupBy("gram").agg(F.count(F.lit(1)).alias("_regions"))
    # Grams with one region need no comparison: it repeats or it does not.
    shared = stage(sizes.where("_regions > 1"))
    alone = regions.where("n > 1").join(shared, "gram", "left_anti")
    spans = alone.select("region", F.expr("array(named_struct('from', 0, 'to', length))").alias("spans"))
    spans = spans.unionByName(_by_tree(regions.join(shared.where(F.col("_regions") <= large), "gram", "left_semi"), span))
    if not (very := shared.where(F.col("_regions") > large)).isEmpty():
        spans = spans.unionByName(_by_windows(regions.join(very, "gram", "left_semi"), span))
    sized = stage(spans.join(regions.select("region", "n"), "region"))
    rows = sized.agg(F.sum("n")).first()[0] or 0
    out = skew_join(found.select("_row", "_row2", "start", "region"), sized, "region", "n", rows, F.col("_row"))
    return out.where("n is not null").select("_row", "_row2", "start", "spans")


def _cut(raw: bytes, places: list[tuple[int, list]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The remaining bytes and the removed runs."""
    runs: list[list[int]] = []
    for a, b in sorted((s + x["from"], s + x["to"]) for s, spans in places for x in spans):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    kept, at = [], 0
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]), [(a, b) for a, b in runs]


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, large: int = LARGE, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept`` (the remaining bytes), ``spans`` (removed runs as from/to),
    ``n_bytes`` and ``n_removed``.  Texts without a repeat are not shuffled."""
    docs = clashing(docs, RESULTS)
    keyed = _keyed(docs, id_col, text)
    places = repeated_spans(keyed, text, span, gram, large)
    places = stage(places.groupBy("_row", "_row2").agg(F.collect_list(F.struct("start", "spans")).alias("_places")))
    marked = bloom_hits(keyed, [F.col("_row"), F.col("_row2")], stage(bloom_of(places.select("_row", "_row2"))), "_some")
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    empty = F.lit(None).cast("array<struct<start: bigint, spans: array<struct<from: int, to: int>>>>")
    columns = [*docs.columns, raw.alias("_raw"), "_places"]
    some = marked.where("_some").join(places, ["_row", "_row2"], "left").select(columns)
    rest = marked.where("not _some").withColumn("_places", empty)
    run_type = T.StructType().add("from", T.LongType()).add("to", T.LongType())
    schema = T.StructType([*docs.schema.fields]).add("kept", T.BinaryType()).add("spans", T.ArrayType(run_type)).add("n_bytes", T.LongType()).add("n_removed", T.LongType())
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(names)
        for batch in batches:
            kept, spans, sizes = [], [], []
            for value, at in zip(batch.column(n), batch.column(n + 1), strict=True):
                whole = value.as_py()
                rest_, runs = _cut(whole, [(p["start"], p["spans"]) for p in at.as_py() or []])
                kept.append(rest_)
                spans.append([{"from": a, "to": b} for a, b in runs])
                sizes.append(len(whole))
            cols = [
                *batch.columns[:n], pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                pa.array(sizes, pa.int64()), pa.array([s - len(k) for s, k in zip(sizes, kept, strict=True)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *RESULTS])

    whole = rest.select(
        *docs.columns, raw.alias("kept"), F.expr("cast(array() as array<struct<from: bigint, to: bigint>>)").alias("spans"),
        F.octet_length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
    )
    return whole.unionByName(some.mapInArrow(run, schema))

