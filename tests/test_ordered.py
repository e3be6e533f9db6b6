import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tarifflow.operators.ordered import OrderedScan, spread, stage
from tarifflow.operators.skew import first_per, last_per


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("split_rows", [150, 10**6])
def test_scan_equals_loop_with_a_hot_key(spark, keys, descending, split_rows):
    rng = random.Random(5)
    rows = [(rng.choice("aaab" "cd"), rng.randint(0, 90), i, rng.randint(0, 9)) for i in range(900)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[0] if keys else ""].append(r)
    want = {}
    for members in groups.values():
        total, top, before = 0, None, None
        for r in sorted(members, key=lambda r: (r[1], r[2]), reverse=descending):
            total += r[3]
            top = r[1] - total if top is None else max(top, r[1] - total)
            want[r[2]] = (before, total, top)
            before = r[2]
    df = spark.createDataFrame(rows, "k STRING, t INT, i INT, v INT")
    scan = OrderedScan(df, keys, ["t", "i"], descending=descending, split_rows=split_rows)
    scan = scan.lag("p", "i").running_sum("s", F.col("v").cast("bigint"))
    scan = scan.with_column("d", F.col("t") - F.col("s")).running_max("m", F.col("d"))
    got = {r.i: (r.p.i if r.p else None, r.s, r.m) for r in scan.frame().collect()}
    assert got == want


def test_hot_keys_are_split_into_chunks(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id)) AS k", "id AS t")
    scan = OrderedScan(df, ["k"], ["t"], split_rows=500)
    sizes = [r["count"] for r in scan.hot.groupBy("_chunk").count().collect()]
    assert scan.hot.select("k").distinct().count() == 1
    assert len(sizes) > 1 and max(sizes) < 1000
    assert scan.frame().count() == 5000


def test_a_hot_null_key_is_split_and_null_values_carry_over(spark):
    df = spark.range(5000).selectExpr("IF(id % 2 = 0, NULL, concat('k', id)) AS k", "id AS t", "IF(id % 4 = 0, NULL, 1L) AS v")
    scans = [OrderedScan(df, ["k"], ["t"], split_rows=n) for n in (500, 10**6)]
    assert scans[0].hot.count() == 2500 and scans[0].hot.select("_chunk").distinct().count() > 1
    split, whole = ({tuple(r) for r in s.lag("p", "t").running_sum("s", F.col("v")).frame().collect()} for s in scans)
    assert split == whole and len(whole) == 5000


def test_picks(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)], "k STRING, t INT, v STRING")
    assert {tuple(r) for r in first_per(df, ["k"], ["t"]).collect()} == {("a", 1, "x"), ("b", 5, None)}
    assert {tuple(r) for r in last_per(df, ["k"], ["t"]).collect()} == {("a", 2, "y"), ("b", 5, None)}


def test_stage_and_spread_keep_rows(spark):
    df = spark.range(100).selectExpr("id", "named_struct('a', array(id)) AS s").coalesce(1)
    staged = stage(df)
    assert staged.schema.simpleString() == df.schema.simpleString()
    assert staged.count() == 100 and spread(df).count() == 100


def test_no_key_is_moved_by_name_where_no_bucket_is_full(spark):
    df = spark.range(5000).selectExpr("IF(id % 3 = 0, 'hot', concat('k', id)) AS k", "id AS t")
    scan = OrderedScan(df, ["k"], ["t"], split_rows=5000)
    assert scan.hot is None and scan._sizes(df, 5000) is None
    assert {tuple(r) for r in scan._sizes(df, 500).collect()} == {("hot", 1667)}


@pytest.mark.parametrize("split_rows", [500, 10**6])
def test_whole_max(spark, split_rows):
    df = spark.range(3000).selectExpr("IF(id % 2 = 0, 'hot', concat('k', id)) AS k", "id AS t")
    rows = OrderedScan(df, ["k"], ["t"], split_rows=split_rows).whole_max("m", F.col("t")).frame().collect()
    assert len(rows) == 3000 and all(r.m == (2998 if r.k == "hot" else r.t) for r in rows)
