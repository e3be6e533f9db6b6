"""Approximate nearest neighbours: a navigable small-world graph per shard.

Each shard of at most about ``SHARD_BYTES`` of vectors gets its own hierarchical graph,
stored as flat neighbour arrays (one int32 matrix per layer, -1 where a node has fewer
links).  Nodes are numbered by falling level, so layer L is the first n_L nodes.  All
rows are indexed.  A search walks every shard's graph and the shards' results are merged.

Searches of many queries walk in lockstep: each step expands the nearest open nodes of
all queries at once, so the work is in array operations, not in Python per node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import vectors

LINKS = 16  # links of a node in upper layers; twice as many in the lowest
EF_BUILD = 64  # candidates kept while a node looks for its links
EF_SEARCH = 192  # candidates kept while a query is answered
_TOGETHER = 256  # nodes or queries that walk in lockstep
_EXPAND = 4  # nodes that each of them expands per step
_NONE = -1


def _distances(points: np.ndarray, of: np.ndarray, queries: np.ndarray, to: np.ndarray) -> np.ndarray:
    diff = points[of] - queries[to]
    return np.einsum("ij,ij->i", diff, diff)


def _merge(dist: np.ndarray, node: np.ndarray, opened: np.ndarray, new_dist: np.ndarray, new_node: np.ndarray, width: int):
    dist = np.concatenate([dist, new_dist], axis=1)
    node = np.concatenate([node, new_node], axis=1)
    opened = np.concatenate([opened, new_node != _NONE], axis=1)
    order = np.argsort(dist, axis=1, kind="stable")[:, :width]
    return tuple(np.take_along_axis(a, order, axis=1) for a in (dist, node, opened))


def _ragged(rows: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Place of each entry within its row (``rows`` ascends), and the longest row."""
    counts = np.bincount(rows, minlength=n)
    return np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts), int(counts.max(initial=0))


def walk(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, squared distances) of up to ``ef`` nearest nodes found, nearest first.

    ``entry`` holds start nodes of each query, -1 where it has fewer.
    """
    n, b = len(links), len(queries)
    seen = np.zeros(b * n, bool)
    first = np.empty(b * n, np.int32)
    dist = np.full((b, ef), np.inf, points.dtype)
    node = np.full((b, ef), _NONE, np.int32)
    opened = np.zeros((b, ef), bool)
    rows, at = np.nonzero(entry != _NONE)
    nodes = entry[rows, at]
    while len(rows):
        spot = rows * n + nodes
        spot = spot[~seen[spot]]
        first[spot] = np.arange(len(spot), dtype=np.int32)  # of repeated nodes the last one stays
        spot = spot[first[spot] == np.arange(len(spot))]
        seen[spot] = True
        rows, nodes = np.divmod(spot, n)
        near = _distances(points, nodes, queries, rows)
        better = near < dist[rows, -1]
        rows, nodes, near = rows[better], nodes[better], near[better]
        touched, local = np.unique(rows, return_inverse=True)
        if len(touched):
            place, width = _ragged(local, len(touched))
            new_dist = np.full((len(touched), width), np.inf, points.dtype)
            new_node = np.full((len(touched), width), _NONE, np.int32)
            new_dist[local, place], new_node[local, place] = near, nodes
            dist[touched], node[touched], opened[touched] = _merge(dist[touched], node[touched], opened[touched], new_dist, new_node, ef)
        pick = opened & (np.cumsum(opened, axis=1) <= _EXPAND)
        opened &= ~pick
        rows, at = np.nonzero(pick)
        around = links[node[rows, at]]
        rows = np.repeat(rows, links.shape[1])
        nodes = around.ravel()
        rows, nodes = rows[nodes != _NONE], nodes[nodes != _NONE]
    return node, dist


def diverse(points: np.ndarray, node: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (nearest first) those nearer to the row's node than to any
    link chosen before; then, up to ``most``, the nearest of the others."""
    near = points[node]
    square = np.einsum("bcd,bcd->bc", near, near)
    between = square[:, :, None] + square[:, None, :] - 2 * (near @ near.transpose(0, 2, 1))
    valid = node != _NONE
    kept = np.zeros(node.shape, bool)
    covered = ~valid
    count = np.zeros(len(node), int)
    for c in range(node.shape[1]):
        take = ~covered[:, c] & (count < most)
        kept[:, c] = take
        count += take
        covered |= take[:, None] & (between[:, c, :] < dist)
    rank = np.where(kept, 0, np.where(valid, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.take_along_axis(np.where(valid, node, _NONE), order, axis=1)
    if out.shape[1] < most:
        out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=_NONE)
    return out.astype(np.int32)


def _pairwise(a: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)
    out = np.maximum(square[:, None] + square[None, :] - 2 * (a @ a.T), 0)
    np.fill_diagonal(out, np.inf)
    return out


def _link_back(points: np.ndarray, links: np.ndarray, new: np.ndarray, start: int) -> None:
    """Add the reverse of the links that nodes from ``start`` on have just got."""
    most = links.shape[1]
    rows, at = np.nonzero(new != _NONE)
    target, source = new[rows, at], (rows + start).astype(np.int32)
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    touched, local = np.unique(target, return_inverse=True)
    place, width = _ragged(local, len(touched))
    added = np.full((len(touched), width), _NONE, np.int32)
    added[local, place] = source
    both = np.concatenate([links[touched], added], axis=1)
    row, col = np.nonzero(both != _NONE)
    dist = np.full(both.shape, np.inf, points.dtype)
    dist[row, col] = _distances(points, both[row, col], points, touched[row])
    order = np.argsort(dist, axis=1, kind="stable")
    both, dist = np.take_along_axis(both, order, axis=1), np.take_along_axis(dist, order, axis=1)
    # Two nodes of one batch may have chosen each other: keep one of equal neighbours.
    same = np.zeros(both.shape, bool)
    same[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE)
    both[same], dist[same] = _NONE, np.inf
    order = np.argsort(dist, axis=1, kind="stable")[:, : 3 * most]
    both, dist = np.take_along_axis(both, order, axis=1), np.take_along_axis(dist, order, axis=1)
    full = (both != _NONE).sum(axis=1) > most
    roomy = both[~full, :most]
    links[touched[~full], : roomy.shape[1]] = roomy
    for part in np.array_split(np.flatnonzero(full), max(1, -(-int(full.sum()) // _TOGETHER))):
        if len(part):
            links[touched[part]] = diverse(points, both[part], dist[part], most)


class Graph:
    """Layers over ``points``; layer L links the first ``len(layers[L])`` nodes."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray]):
        self.points, self.layers = points, layers

    @classmethod
    def built(cls, points: np.ndarray, seed: int, links: int = LINKS, ef: int = EF_BUILD) -> tuple[Graph, np.ndarray]:
        """(graph, order): node i of the graph is ``points[order[i]]``."""
        rng = np.random.default_rng(seed)
        level = np.minimum(rng.exponential(1 / np.log(links), len(points)).astype(int), 12)
        order = rng.permutation(len(points))
        order = order[np.argsort(-level, kind="stable")]
        points, level = points[order], np.sort(level)[::-1]
        graph = cls(points, [])
        for layer in range(int(level[0]), -1, -1):
            graph.layers.insert(0, graph._layer(int((level >= layer).sum()), links if layer else 2 * links, ef))
        return graph, order

    def _layer(self, n: int, most: int, ef: int) -> np.ndarray:
        points, links = self.points[:n], np.full((n, most), _NONE, np.int32)
        done = 0
        while done < n:
            end = min(n, done + max(1, min(max(done, 64), _TOGETHER)))
            batch = points[done:end]
            inside = _pairwise(batch)
            near = np.argsort(inside, axis=1, kind="stable")[:, : min(most, max(1, end - done - 1))]
            dist, node = np.take_along_axis(inside, near, axis=1), (near + done).astype(np.int32)
            node[np.isinf(dist)] = _NONE
            if done:
                found, far = walk(points, links[:done], batch, self._entries(batch, done), ef)
                dist, node, _ = _merge(far, found, found != _NONE, dist, node, ef)
            links[done:end] = diverse(points, node, dist, most)
            _link_back(points, links, links[done:end].copy(), done)
            done = end
        return links

    def _entries(self, queries: np.ndarray, below: int, keep: int = 4) -> np.ndarray:
        """Start nodes (numbers under ``below``) from the layers built so far."""
        found = np.zeros((len(queries), 1), np.int32)
        for links in reversed(self.layers):
            found, _ = walk(self.points, links, queries, found[:, :keep], 2 * keep)
        found = np.where(found < below, found, _NONE)[:, : 2 * keep]
        found[(found == _NONE).all(axis=1), 0] = 0
        return found

    def search(self, queries: np.ndarray, ef: int = EF_SEARCH) -> tuple[np.ndarray, np.ndarray]:
        found = np.zeros((len(queries), 1), np.int32)
        for links in reversed(self.layers[1:]):
            found, _ = walk(self.points, links, queries, found[:, :4], 8)
        return walk(self.points, self.layers[0], queries, found, min(ef, len(self.points)))


def _unit(values: np.ndarray) -> float:
    """Power of two that brings ``values`` near 1, so that squares neither overflow nor vanish."""
    most = float(np.abs(values).max(initial=0))
    return float(2.0 ** -np.floor(np.log2(most))) if most > 0 else 1.0


def build(shard: int, dim: int, table: pa.Table) -> bytes:
    """Graph over the distinct vectors of a shard; equal vectors are one node with many rows."""
    values = vectors.matrix(table.column("vec"), dim) + 0.0  # -0.0 equals 0.0
    distinct, node = np.unique(values, axis=0, return_inverse=True)
    unit = _unit(distinct)
    graph, order = Graph.built((distinct * unit).astype(np.float32), shard)
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    node = at[node.ravel()]
    ids = table.column("id")
    unknown = pa.compute.is_null(ids).to_numpy(zero_copy_only=False).astype(bool)
    ids = pa.compute.fill_null(ids, 0).to_numpy()
    rows = table.column("row").to_numpy()
    sort = np.lexsort((rows, ids, unknown, node))
    starts = np.searchsorted(node[sort], np.arange(len(order) + 1))
    arrays = {"values": distinct[order], "unit": np.array(unit), "starts": starts, "ids": ids[sort], "unknown": unknown[sort], "rows": rows[sort]}
    return vectors.packed(arrays | {f"layer{i}": a for i, a in enumerate(graph.layers)})


class Shard:
    def __init__(self, a: dict[str, np.ndarray]):
        self.values, self.unit, self.starts = a["values"], float(a["unit"]), a["starts"]
        self.ids, self.unknown, self.rows = a["ids"], a["unknown"], a["rows"]
        layers = [a[f"layer{i}"] for i in range(sum(k.startswith("layer") for k in a))]
        self.graph = Graph((self.values * self.unit).astype(np.float32), layers)

    def nearest(self, queries: np.ndarray, own: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, ...]:
        """(query, id, id is null, row, distance) of each query's ``k`` nearest rows found, not its own.

        Distances are exact: from the original vectors, in double precision.
        """
        node, _ = self.graph.search((queries * self.unit).astype(np.float32), ef)
        query, at = np.nonzero(node != _NONE)
        node = node[query, at]
        diff = self.values[node].astype(float) - queries[query].astype(float)
        # One after the other, as a loop over the dimensions adds.
        with np.errstate(over="ignore"):
            dist = np.sqrt(np.add.accumulate(diff * diff, axis=1)[:, -1])
        # Of equal vectors the first k + 1 rows suffice: they are in order of id.
        copies = np.minimum(self.starts[node + 1] - self.starts[node], k + 1)
        place = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        row = np.repeat(self.starts[node], copies) + place
        query, dist = np.repeat(query, copies), np.repeat(dist, copies)
        other = self.rows[row] != own[query]
        query, dist, row = query[other], dist[other], row[other]
        order = np.lexsort((self.rows[row], self.ids[row], self.unknown[row], dist, query))
        query, dist, row = query[order], dist[order], row[order]
        place, _ = _ragged(query, len(queries))
        first = place < k
        query, dist, row = query[first], dist[first], row[first]
        return query, self.ids[row], self.unknown[row], self.rows[row], dist


_FOUND = "query_row long, query_id long, vec_id long, row long, score double"


def neighbours(
    df: DataFrame,
    queries: str = "pmod(id, 100) = 0",
    k: int = 10,
    *,
    id_col: str = "vec_id",
    vector: str = "embedding",
    ef: int = EF_SEARCH,
    shard_bytes: int = vectors.SHARD_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query row.

    ``queries`` is a condition on ``id``; every other row is a candidate, the query's own
    row is not.  ``score`` is the Euclidean distance in double precision; ties go to the
    smaller id, a null id last.

    Defined cases: vectors that are null, empty, all zero or hold null, NaN or infinite
    components take no part; only vectors of the query's length are candidates; rows alike
    in all columns are rows of their own (each finds the others at distance 0, and each
    query among them has its own ranks); fewer candidates than ``k`` give fewer rows; an
    empty table gives none; other columns are ignored, whatever their names.
    """

    def takes_part(v):
        return vectors.usable(v) & F.exists(v, lambda x: x != 0)

    rows, shards = vectors.dealt(df, id_col, vector, takes_part, shard_bytes)
    index = vectors.indexed(rows, shards, build)

    def search(shard: Shard, some: pa.Table) -> Iterator[pa.RecordBatch]:
        dim = shard.values.shape[1]
        for start in range(0, len(some), _TOGETHER):
            part = some.slice(start, _TOGETHER)
            own, ids = part.column("row").to_numpy(), part.column("id").to_numpy()
            query, found, unknown, row, dist = shard.nearest(vectors.matrix(part.column("vec"), dim), own, k, ef)
            yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(ids[query]), pa.array(found, mask=unknown), pa.array(row), pa.array(dist)], names=["query_row", "query_id", "vec_id", "row", "score"])

    found = vectors.searched(index, shards, rows.where(queries), Shard, search, _FOUND)
    order = Window.partitionBy("query_row").orderBy("score", F.col("vec_id").asc_nulls_last(), "row")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
