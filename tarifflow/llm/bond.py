"""Hard negatives by branch and bound on decomposed vectors.

Vectors are cut into shards that hold one array per dimension, with its least and
greatest component.  For an anchor, a shard's dimensions are read in order of the
anchor's descending magnitude.  After every few of them each candidate's score lies
between its partial sum plus the least, and plus the greatest, that the unread dimensions
can add; candidates that can no longer be among the wanted ones leave the bitmap.  Those
left at the end have exact scores.

Two scans over all shards: the first finds each anchor's positives, the second the
negatives in the score windows that the positives open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors

SCALE = 256  # components become floor(SCALE * x)
POSITIVES = 5
NEGATIVES = 3
LEAST, MOST = 50, 95  # a negative's score, in hundredths of the positive's
_STEP = 8  # dimensions read between two prunings
_EXACT = 2.0**53  # doubles hold all integers up to it
_LONG = 2**63


def build(shard: int, dim: int, table: pa.Table) -> bytes:
    """Columns of integer components with their bounds; rows stay in order of (id, row)."""
    with np.errstate(over="ignore"):
        values = np.nan_to_num(np.floor(SCALE * vectors.matrix(table.column("vec"), dim).astype(float)))
    unknown = pa.compute.is_null(table.column("id")).to_numpy(zero_copy_only=False).astype(bool)
    ids = pa.compute.fill_null(table.column("id"), 0).to_numpy()
    rows = table.column("row").to_numpy()
    order = np.lexsort((rows, ids, unknown))
    columns = np.ascontiguousarray(values[order].T)
    return vectors.packed({"columns": columns, "ids": ids[order], "unknown": unknown[order], "rows": rows[order], "labels": table.column("label").to_numpy()[order]})


class Shard:
    """``search`` methods return positions in order of (score falling, id, row)."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.columns, self.ids, self.unknown, self.rows, self.labels = (a[k] for k in ("columns", "ids", "unknown", "rows", "labels"))
        self.low, self.high = self.columns.min(axis=1), self.columns.max(axis=1)

    def _rest(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order of dimensions, least, greatest sum of what is unread after each step)."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        one, two = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least, most = np.minimum(one, two), np.maximum(one, two)
        return order, least.sum() - np.cumsum(least), most.sum() - np.cumsum(most)

    def _exact_range(self, anchor: np.ndarray) -> bool:
        return float(np.abs(anchor) @ np.maximum(np.abs(self.low), np.abs(self.high))) < _EXACT

    def _large(self, anchor: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Scores that doubles cannot hold, by whole numbers of any size."""
        whole = [int(a) for a in anchor]
        sums = [sum(a * int(x) for a, x in zip(whole, column, strict=True)) for column in self.columns[:, at].T]
        return np.array([min(max(s, -_LONG), _LONG - 1) for s in sums], np.int64)

    def _scan(self, anchor: np.ndarray, at: np.ndarray, alive) -> tuple[np.ndarray, np.ndarray]:
        """Candidates left of positions ``at``, and their scores.  ``alive(low, high)`` tells
        which candidates with scores in these ranges can still matter."""
        if not self._exact_range(anchor):
            return at, self._large(anchor, at)
        order, least, most = self._rest(anchor)
        score = np.zeros(len(at))
        for start in range(0, len(order), _STEP):
            dims = order[start : start + _STEP]
            score += anchor[dims] @ self.columns[np.ix_(dims, at)]
            last = start + len(dims) - 1
            if last + 1 < len(order):
                left = alive(score + least[last], score + most[last])
                at, score = at[left], score[left]
        return at, score.astype(np.int64)

    def _first(self, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
        return np.argsort(-score, kind="stable")[:k]  # positions ascend by (id, row)

    def alike(self, anchor: np.ndarray, own: int, label: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` rows of the anchor's label with the highest scores."""

        def alive(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            if len(low) <= k:
                return np.ones(len(low), bool)
            return high >= np.partition(low, -k)[-k]

        at, score = self._scan(anchor, np.flatnonzero((self.labels == label) & (self.rows != own)), alive)
        first = self._first(at, score, k)
        return at[first], score[first]

    def within(self, anchor: np.ndarray, label: int, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, the ``k`` highest rows of other labels inside it."""

        def alive(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.zeros(len(low), bool)
            for least, most in windows:
                sure = low[(low >= least) & (high <= most)]
                bar = np.partition(sure, -k)[-k] if len(sure) >= k else least
                out |= (high >= bar) & (low <= most)
            return out

        at, score = self._scan(anchor, np.flatnonzero(self.labels != label), alive)
        found = []
        for least, most in windows:
            inside = np.flatnonzero((score >= least) & (score <= most))
            first = inside[self._first(at[inside], score[inside], k)]
            found.append((at[first], score[first]))
        return found


def window(positive: int) -> tuple[int, int]:
    """Whole scores s with LEAST * positive <= 100 * s <= MOST * positive."""
    return -(-LEAST * positive // 100), MOST * positive // 100


def _anchors(some: pa.Table, dim: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * vectors.matrix(some.column("vec"), dim).astype(float)))


def _batch(found: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*found, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def hard_negatives(
    df: DataFrame,
    anchors: str = "pmod(id, 50) = 0",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    shard_bytes: int = vectors.SHARD_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of the integer components with the anchor's; higher ones
    come first, ties by smaller id (a null id last).  ``anchors`` is a condition on ``id``.
    An anchor's positives are the first ``positives`` other rows of its label; for each of
    them the first ``negatives`` rows of other labels are returned whose score is between
    50 and 95 hundredths of the positive's.

    Defined cases: rows with a null label, or a vector that is null, empty or holds null, NaN
    or infinite components, take no part; only vectors of the anchor's length are compared;
    rows alike in all columns are rows of their own; fewer rows than asked for are returned
    as they are; an empty table gives none; other columns are ignored, whatever their names.
    Scores are exact; one beyond the range of a long is returned as its bound.
    """
    rows, shards = vectors.dealt(df.where(F.col(label).isNotNull()), id_col, vector, vectors.usable, shard_bytes, label=F.col(label).cast("long"))
    index = vectors.indexed(rows, shards, build)
    asked = rows.where(anchors).select("row", "id", "vec", "label")

    def likest(shard: Shard, some: pa.Table) -> Iterator[pa.RecordBatch]:
        names, found = ["anchor_row", "id", "row", "score"], []
        points = _anchors(some, len(shard.columns))
        for point, own, of in zip(points, some.column("row").to_pylist(), some.column("label").to_pylist(), strict=True):
            at, score = shard.alike(point, own, of, positives)
            found += [(own, None if shard.unknown[a] else int(shard.ids[a]), int(shard.rows[a]), int(s)) for a, s in zip(at, score, strict=True)]
        yield _batch(found, names)

    near = vectors.searched(index, shards, asked, Shard, likest, "anchor_row long, id long, row long, score long")
    best = Window.partitionBy("anchor_row").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    near = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives)
    # At most ``positives`` entries per anchor.
    chosen = near.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("chosen"))
    opened = vectors.stage(asked.join(chosen, F.col("row") == F.col("anchor_row")).drop("anchor_row"))

    def hardest(shard: Shard, some: pa.Table) -> Iterator[pa.RecordBatch]:
        names, found = ["anchor_row", "anchor_id", "positive_id", "place", "positive_score", "id", "row", "score"], []
        points = _anchors(some, len(shard.columns))
        for point, a in zip(points, some.select(["row", "id", "label", "chosen"]).to_pylist(), strict=True):
            windows = [window(p["score"]) for p in a["chosen"]]
            for p, (at, score) in zip(a["chosen"], shard.within(point, a["label"], windows, negatives), strict=True):
                head = (a["row"], a["id"], p["id"], p["place"], p["score"])
                found += [(*head, None if shard.unknown[x] else int(shard.ids[x]), int(shard.rows[x]), int(s)) for x, s in zip(at, score, strict=True)]
        yield _batch(found, names)

    hard = vectors.searched(
        index, shards, opened, Shard, hardest,
        "anchor_row long, anchor_id long, positive_id long, place long, positive_score long, id long, row long, score long",
    )
    first = Window.partitionBy("anchor_row", "place").orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "row")
    hard = hard.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= negatives)
    return hard.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
