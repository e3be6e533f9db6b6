"""The k-d tree on a small table against a direct one."""

from tarifflow.llm import sharding


def test_tree_equals_a_direct_one(spark):
    """Distinct numbers: halves at the weighted median along the widest dimension."""
    docs = spark.range(8000).selectExpr("id AS doc_id", "concat('t', lpad(id, 6, '0')) AS text", "CAST((id * 37) % 8000 AS DOUBLE) AS x", "CAST((id * 101) % 8000 AS DOUBLE) / 2 AS y")
    got = {r["doc_id"]: r["shard"] for r in sharding.place(docs, 4, ("x", "y")).collect()}
    points = {i: (float(i * 37 % 8000) / 7999, float(i * 101 % 8000) / 7999) for i in range(8000)}

    def tree(ids, shards, first=None):
        if len(shards) == 1:
            return dict.fromkeys(ids, shards[0])
        dim = first if first is not None else max((0, 1), key=lambda d: max(points[i][d] for i in ids) - min(points[i][d] for i in ids))
        ids = sorted(ids, key=lambda i: points[i][dim])
        half = len(shards) // 2
        return tree(ids[: len(ids) // 2], shards[:half]) | tree(ids[len(ids) // 2 :], shards[half:])

    # All dimensions fill their range at the root, so either may come first there; a cut may
    # fall a few documents beside the middle.
    same = [sum(got[i] == shard for i, shard in tree(list(points), [0, 1, 2, 3], first).items()) for first in (0, 1)]
    assert max(same) >= 7960
