"""Searches over embeddings against brute force."""

import math
import random

import numpy as np
import pytest

from tarifflow.llm import bond, hnsw, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, row int, id string, score double, shard int, data binary, vec int, place int"
CLASH = (1, "x", 0.5, 3, None, 7, 9)


def _rows():
    """Clusters, equal vectors under many ids, repeated rows, odd vectors, two lengths."""
    rng = random.Random(2)
    out = []
    for i in range(400):
        v = [rng.choice((-1, 1)) * (0.2 + i % 5) + rng.gauss(0, 0.3) for _ in range(6)]
        out.append((i, v, i % 4))
    same = [0.25] * 6
    out += [(1000 + 7 * i, same, i % 3) for i in range(150)]
    out += [(2000, [1.0, 2.0], 1), (2100, [1.0, 2.5], 1), (2101, [0.5, 2.0], 2), (2102, [0.75, 1.5], 2), (2200, [9.0], 0)]
    out += [(3000, None, 1), (3100, [], 1), (3200, [0.0] * 6, 1), (3300, [float("nan")] * 6, 1), (3400, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (3500, [math.inf] * 6, 1)]
    out += [(4000, same, None), (None, same, 1), (None, None, None), (5000, [-0.0, 0.0, -0.0, 1.0, 0.0, 0.0], 2), (5001, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0], 2)]
    out += [out[0], out[0], out[100], out[2]]
    return [(*r, *CLASH) for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


def _usable(rows):
    return [(i, np.array(v, np.float32).astype(float), label) for i, v, label, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]


def _distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def _by_id(i):
    return (i is None, i or 0)


def test_neighbours_equal_brute_force(table):
    rows = [r for r in _usable(table.collect()) if r[1].any()]
    want = []
    for n, (qid, q, _) in enumerate(rows):
        if qid is None or qid % 100:
            continue
        found = [(_distance(v, q), _by_id(i), i) for m, (i, v, _) in enumerate(rows) if m != n and len(v) == len(q)]
        want += [(qid, rank, i, score) for rank, (score, _, i) in enumerate(sorted(found)[:10], 1)]
    for shard_bytes in (vectors.SHARD_BYTES, 2_000):
        got = hnsw.neighbours(table, shard_bytes=shard_bytes)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_neighbours_recall(spark):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(6000, 32)).astype(np.float32)
    points[::3] = points[0] + rng.normal(size=(2000, 32)) * 1e-3  # a third in one tight cluster
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points.tolist())], "vec_id long, embedding array<float>")
    got = hnsw.neighbours(df, shard_bytes=1 << 18)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q in range(0, 6000, 100):
        dist = ((points.astype(float) - points[q]) ** 2).sum(axis=1)
        dist[q] = np.inf
        hits += len(found[q] & set(np.argsort(dist)[:10].tolist()))
    assert hits >= 0.95 * 10 * 60


def test_graph_layers_are_flat_arrays():
    points = np.random.default_rng(3).normal(size=(900, 8)).astype(np.float32)
    graph, order = hnsw.Graph.built(points, 5)
    assert sorted(order.tolist()) == list(range(900))
    assert [len(a) for a in graph.layers] == sorted((len(a) for a in graph.layers), reverse=True)
    for links in graph.layers:
        assert links.dtype == np.int32 and links.max() < len(links)
        for node, row in enumerate(links):
            linked = row[row >= 0].tolist()
            assert node not in linked and len(linked) == len(set(linked))


def _hard(rows):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in _usable(rows) if label is not None]
    want = []
    for n, (aid, a, label) in enumerate(rows):
        if aid is None or aid % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, a, strict=True)), _by_id(i), m, i, other) for m, (i, v, other) in enumerate(rows) if m != n and len(v) == len(a)]
        scored.sort()
        for p, _, _, pid, _ in [s for s in scored if s[4] == label][:5]:
            inside = [s for s in scored if s[4] != label and 50 * -p <= 100 * -s[0] <= 95 * -p]
            want += [(aid, pid, rank, s[3], -p, -s[0]) for rank, s in enumerate(inside[:3], 1)]
    return want


@pytest.mark.parametrize("shard_bytes", [vectors.SHARD_BYTES, 2_000])
def test_hard_negatives_equal_brute_force(table, shard_bytes):
    want = _hard(table.collect())
    got = bond.hard_negatives(table, shard_bytes=shard_bytes)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(want) > 50
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_hard_negatives_beyond_doubles(spark):
    rows = [(0, [3e13, 1.0], 1), (1, [1e4, 5.0], 1), (2, [9e3, 3.5], 2), (3, [6e3, 1.25], 2), (4, [9e3, 3.75], 2), (50, [1e30, 1.0], 3), (5, [1.0, 1.0], 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = [tuple(r) for r in bond.hard_negatives(df).collect() if r["anchor_id"] == 0]
    assert sorted(got) == sorted(r for r in _hard_exact(rows) if r[0] == 0)


def _hard_exact(rows):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    a = rows[0][1]
    score = {i: min(sum(x * y for x, y in zip(v, a, strict=True)), 2**63 - 1) for i, v, _ in rows}
    p = score[1]
    inside = sorted((-score[i], i) for i, _, label in rows if label != 1 and 50 * p <= 100 * score[i] <= 95 * p)
    return [(0, 1, rank, i, p, -s) for rank, (s, i) in enumerate(inside[:3], 1)]


def test_windows():
    for s in (-7, -1, 0, 1, 2, 3, 19, 20, 21, 12345):
        low, high = bond.window(s)
        inside = [x for x in range(-20, 13000) if bond.LEAST * s <= 100 * x <= bond.MOST * s]
        assert inside == list(range(low, high + 1))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hnsw.neighbours(empty).collect() == []
    assert bond.hard_negatives(empty).collect() == []


def test_slices_and_partitions_change_nothing(table, monkeypatch):
    one = sorted(map(tuple, bond.hard_negatives(table, shard_bytes=2_000).collect()), key=str)
    monkeypatch.setattr(vectors, "MOST_PARTITIONS", 3)
    monkeypatch.setattr(vectors.searched, "__defaults__", (3,))
    assert sorted(map(tuple, bond.hard_negatives(table, shard_bytes=2_000).collect()), key=str) == one
