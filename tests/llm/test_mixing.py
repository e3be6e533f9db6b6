"""Which row stands where in a mixture, and mixtures of very many sources."""

from collections import Counter, defaultdict
from math import ceil

from pyspark.sql import functions as F

from tarifflow.llm import mixing


def _brute(rows, share, block):
    """position -> row: at each slot, of the released blocks that with the earliest deadline."""
    quantum = sum(share.values())
    streams = defaultdict(list)
    for spot, doc, source in sorted(rows, key=lambda r: r[:2]):
        streams[source].append(doc)
    placed = dict.fromkeys(share, 0)
    first = {s: -(-len(d) // block) for s, d in streams.items()}
    out, slot = {}, 0
    while any(placed[s] < first[s] for s in share):
        ready = [(-(-(placed[s] + 1) * quantum // share[s]), i, s) for i, s in enumerate(share) if placed[s] * quantum // share[s] <= slot]
        deadline, _, s = min(ready)
        assert slot < deadline
        for k in range(block):
            at = placed[s] * block + k
            out[slot * block + k] = (streams[s][at % len(streams[s])], at // len(streams[s]))
        placed[s] += 1
        slot += 1
    return out


def test_rows_stand_where_the_schedule_puts_them(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('t', id) AS text", "CASE WHEN id < 180 THEN 'a' WHEN id < 260 THEN 'b' WHEN id < 297 THEN NULL ELSE 'd' END AS source")
    weights = {"a": 0.5, "b": 0.2, None: 0.27, "d": 0.03}
    got = mixing.mix(docs, weights, block=4, quantum=40)
    rows = docs.select(F.xxhash64("doc_id", "text"), "doc_id", "source").collect()
    share = mixing.shares({s: weights[s] for s in (None, "a", "b", "d")}, 40)
    want = _brute([tuple(r) for r in rows], share, 4)
    assert {r["position"]: (r["doc_id"], r["epoch"]) for r in got.collect()} == want


def test_very_many_sources(spark):
    """Two thousand hosts, of which one has a third of the rows; few are scheduled alone."""
    docs = spark.range(12_000).selectExpr("id AS doc_id", "concat('t', id) AS text", "IF(id % 3 = 0, 'hot', IF(id % 3 = 1 AND id % 7 = 0, NULL, concat('host', id * id % 2003))) AS source")
    got = mixing.mix(docs, block=4, tasks=60, groups=20).select("doc_id", "source", "epoch", "position").collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert {r["doc_id"] for r in got if r["epoch"] == 0} == set(range(12_000))
    again = mixing.mix(docs.repartition(7), block=4, tasks=60, groups=20).select("doc_id", "source", "epoch", "position").collect()
    assert sorted(got) == sorted(again)
    sizes = Counter(r["source"] for r in docs.collect())
    assert len(sizes) > 1000
    total = sum(n**mixing.TEMPERATURE for n in sizes.values())
    seen = Counter(r["source"] for r in got)
    for s, n in sizes.items():
        fair = len(got) * n**mixing.TEMPERATURE / total
        # Shares are whole parts of the period, at least one; then a block more or less.
        assert n <= seen[s] <= ceil(1.5 * fair) + 8, (s, n, seen[s], fair)


def test_given_weights_of_many_sources(spark):
    docs = spark.range(900).selectExpr("id AS doc_id", "'x' AS text", "concat('s', id % 90) AS source")
    weights = {f"s{i}": 1.0 + i % 3 for i in range(90)}
    got = mixing.mix(docs, weights, block=4, quantum=100, tasks=20, groups=5).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    assert {r["doc_id"] for r in got} == set(range(900))
