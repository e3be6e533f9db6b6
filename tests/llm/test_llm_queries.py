"""Registered queries against their SQL, and the pipeline's stages on real rows."""

import importlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from check_queries import duck
from tarifflow.llm import simhash
from tarifflow.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    result = duck(SMALL).execute(ORACLES[name])
    names = [d[0] for d in result.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(names).collect()), key=str) == sorted(result.fetchall(), key=str)


def test_pipeline_stages(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for _, apply in pipeline.STAGES:
        seen.append(pipeline.stage(apply(spark, seen[-1], SMALL)))
    for before, after in zip(seen[:4], seen[1:5], strict=True):
        assert after.columns == docs.columns
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    clean, single, apart, mixed, packed = seen[1:]
    lower = [r[0] for r in single.selectExpr("lower(coalesce(text, ''))").collect()]
    assert len(lower) == len(set(lower))
    prints = [simhash.fingerprint((r[0] or "").encode()) for r in apart.select("text").collect()]
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert {r[0] for r in mixed.select("doc_id").collect()} == {r[0] for r in apart.select("doc_id").collect()}
    copies = {r[0]: r[1] for r in mixed.groupBy("doc_id").count().collect()}
    pieces = {r[0]: r[1] for r in packed.where("start = 0").groupBy("doc_id").count().collect()}
    assert pieces == copies
    assert sum(r[0] for r in packed.select("length").collect()) > 0.9 * 4096 * packed.select("sequence_id").distinct().count()


def test_stages_keep_clashing_columns(spark):
    """Columns named like an operator's own come back as they went in."""
    pipeline = importlib.import_module("corpus_pipeline")
    extra = ["n", "root", "component_id", "members", "print", "_print", "_shared", "score", "predicted", "block", "slot", "position", "epoch", "keep_id", "kept"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in extra])
    third = docs.unionByName(docs.where("doc_id = 3").withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(30)))).drop("_n"))
    for name, apply in pipeline.STAGES[:-1]:
        out = apply(spark, third, SMALL)
        assert out.columns == third.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra), name
    assert pipeline.STAGES[-1][1](spark, third, SMALL).where("start = 0").count() == third.count()
