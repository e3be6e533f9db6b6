import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tarifflow.operators import pricing as pr
from tarifflow.plans import workspace
from tarifflow.sources import extraction as ex
from tarifflow.sources import tables as tb

T0 = datetime(2026, 8, 18)


def extracted(spark, answers, **options):
    df = spark.createDataFrame([(f"a{i}", "q's \"x\"", a) for i, a in enumerate(answers)], "answer_id STRING, source_query STRING, response STRING")
    return ex.plan_defaults(ex.explode_plans(ex.parse_answers(df)), **options)


def test_missing_null_and_odd_keys(spark):
    answers = [
        json.dumps({"plans": [{}]}),
        json.dumps({"company_name": None, "plans": [{"plan_name": None, "input_tokens": None, "currency": None, "features": None, "limitations": None}]}),
        json.dumps({"company_name": "C", "plans": [{"plan_name": True, "input_tokens": "0.5", "output_tokens": "ask us", "features": ["a", "24/7"]}]}),
    ]
    a, b, c = extracted(spark, answers).orderBy("answer_id").collect()
    assert (a.company_name, a.plan_name, a.input_tokens, a.currency, a.billing_period, a.features, a.limitations) == (
        "Unknown", "Unknown Plan", 0.0, "USD", "unknown", [], "")
    assert (b.company_name, b.plan_name, b.input_tokens, b.output_tokens, b.currency, b.features, b.limitations) == (
        "None", "None", 0.0, 0.0, "None", None, "None")
    assert (c.plan_name, c.input_tokens, c.input_tokens_raw, c.output_tokens, c.output_tokens_raw) == ("True", 0.5, None, None, "ask us")
    sane = extracted(spark, answers, null_strings="null").orderBy("answer_id").collect()[1]
    assert sane.company_name is None and sane.limitations is None


def test_fences_and_quarantine(spark):
    doc = json.dumps({"company_name": "C", "plans": [{"plan_name": "p"}, {"plan_name": "q"}]})
    texts = ["```json\n" + doc + "\n```", doc[:-4], "[1]", "", doc]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "answer_id INT, response STRING")
    parsed, bad = ex.parse_extraction(df)
    assert sorted(r.answer_id for r in parsed.collect()) == [0, 4]
    assert sorted(r.answer_id for r in bad.collect()) == [1, 2, 3]
    plans = ex.explode_plans(parsed).select("answer_id", "pos").collect()
    assert sorted(map(tuple, plans)) == [(0, 0), (0, 1), (4, 0), (4, 1)]
    counts = pr.store_summary(df, ex.explode_plans(ex.parse_answers(df)))
    assert [tuple(r) for r in counts.orderBy("answer_id").collect()] == [(0, 2), (1, 0), (2, 0), (3, 0), (4, 2)]


def test_quotes_survive(spark):
    plan = {"plan_name": "Builder's Plan", "features": ["O'Hara-grade \"support\"", "24/7"], "limitations": "Can't resize"}
    row = extracted(spark, [json.dumps({"company_name": "D'I", "plans": [plan]})]).select("*", ex.features_json("features").alias("ft")).first()
    assert (row.company_name, row.plan_name, row.limitations, row.source_query) == ("D'I", "Builder's Plan", "Can't resize", "q's \"x\"")
    assert row.ft == json.dumps(plan["features"])
    back = spark.createDataFrame([(row.ft,)], "features_text STRING").select(ex.features_array().alias("f")).first()
    assert back.f == plan["features"]


def test_features_text_is_ascii(spark):
    lists = [["é €5", "tick ✓"], ["😀 ok", "plain"], [], ["tab\tend", "back\\\\slash \"q\""]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i INT, features ARRAY<STRING>")
    got = [r.t for r in df.select("i", ex.features_json().alias("t")).orderBy("i").collect()]
    assert got == [json.dumps(x) for x in lists]


@pytest.fixture
def plans_table(spark):
    name = f"plans_{datetime.now().strftime('%H%M%S%f')}"
    tb.create_pricing_plans(spark, name)
    tb.create_pricing_plans(spark, name)
    yield name
    spark.sql(f"DROP TABLE {name}")


def test_append_is_keyed_and_ids_grow(spark, plans_table):
    doc = lambda n: json.dumps({"company_name": "C", "plans": [{"plan_name": f"p{k}", "features": ["f"]} for k in range(n)]})
    batch = extracted(spark, [doc(3), doc(2)]).withColumn("created_at", F.lit(T0).cast("timestamp_ntz"))
    tb.append_plans(batch, plans_table)
    tb.append_plans(batch, plans_table)  # delivered again
    later = batch.withColumn("answer_id", F.concat(F.lit("b"), "answer_id"))
    tb.append_plans(later, plans_table)
    rows = spark.table(plans_table).orderBy("id").collect()
    assert [(r.answer_id, r.pos) for r in rows] == [
        (a, k) for a, n in (("a0", 3), ("a1", 2), ("ba0", 3), ("ba1", 2)) for k in range(n)
    ]
    assert len({r.id for r in rows}) == 10
    assert plans_table in tb.list_tables(spark)
    described = {r.col_name: r.data_type for r in tb.describe_table(spark, plans_table).collect()}
    assert described["input_tokens"] == "double" and described["features"] == "array<string>"


def priced(spark):
    rows = [
        (0, "Borealis", "V3", 0.32, 0.89, 0), (1, "Borealis", "V3-mini", 0.24, 0.9, 0), (2, "Borealis", "V3", 0.30, 0.88, 5),
        (3, "Cloud", "V3", 0.15, 0.4, 5), (4, "Quartz", "Camel", 0.59, None, 6), (5, "Quartz", "Camel", 0.6, 0.79, 6),
    ]
    return spark.createDataFrame(
        [(i, c, p, a, b, "USD", T0 + timedelta(seconds=s)) for i, c, p, a, b, s in rows],
        "id BIGINT, company_name STRING, plan_name STRING, input_tokens DOUBLE, output_tokens DOUBLE, currency STRING, created_at TIMESTAMP_NTZ",
    )


def test_recent_and_display(spark):
    recent = pr.recent_plans(priced(spark), 3)
    assert [tuple(r)[:3] for r in recent.collect()] == [("Quartz", "Camel", 0.59), ("Quartz", "Camel", 0.6), ("Borealis", "V3", 0.3)]
    assert recent.columns == ["company_name", "plan_name", "input_tokens", "output_tokens", "currency"]
    lines = [r.line for r in pr.format_plans(recent).collect()]
    assert lines[0] == "  • Quartz: Camel - Input Token $0.59, Output Tokens $None"
    assert lines[2] == "  • Borealis: V3 - Input Token $0.3, Output Tokens $0.88"
    assert "TakeOrderedAndProject" in recent._jdf.queryExecution().executedPlan().toString()


def test_latest_compare_cheapest(spark):
    plans = priced(spark)
    assert {r.id for r in pr.latest_plans(plans).collect()} == {1, 2, 3, 5}
    companies = spark.createDataFrame([("Cloud",), ("Borealis",), ("Quartz",)], "company_name STRING")
    got = {r.company_name: (r.input_tokens, r.offered) for r in pr.compare_providers(plans, companies, "V3").collect()}
    assert got == {"Cloud": (0.15, True), "Borealis": (0.30, True), "Quartz": (None, False)}
    matrix = {r.plan_name: r for r in pr.price_matrix(plans, ["Cloud", "Borealis"]).collect()}
    assert matrix["V3"]["Cloud_input"] == 0.15 and matrix["V3-mini"]["Cloud_input"] is None
    best = pr.cheapest_plans(plans.withColumn("plan_family", F.substring_index("plan_name", "-", 1))).collect()
    assert {(r.plan_family, r.lowest, r.cheapest_company) for r in best} == {("V3", 0.15, "Cloud"), ("Camel", 0.59, "Quartz")}


def test_sql_with_markers(spark):
    workspace.open_tables(spark, {"plans": priced(spark)})
    tricky = "x' OR '1'='1"
    assert workspace.sql(spark, "SELECT * FROM plans WHERE company_name = :c", c=tricky).count() == 0
    assert workspace.sql(spark, "SELECT count(*) AS n FROM plans WHERE is_price_like(concat('$', input_tokens))").first().n == 6


def test_features_of_any_kind_and_repeated_keys(spark):
    values = ["fast", [1, None, True], ["a", None], [None], [], None, {"k": 1}, 7, "d\u00e9j\u00e0 \u2713", [{"k": [1]}]]
    docs = [json.dumps({"company_name": "C", "plans": [{"plan_name": str(i), "features": v}]}) for i, v in enumerate(values)]
    docs.append('{"company_name": "Old", "company_name": "New", "plans": [{"plan_name": "last", "features": ["x"]}]}')
    rows = extracted(spark, docs).select("*", ex.features_json("features", "features_raw").alias("ft")).collect()
    got = {r.plan_name: r.ft for r in rows}
    same = lambda x: x.replace(": ", ":")  # noqa: E731  objects are written without blanks
    assert {k: same(v) for k, v in got.items() if k != "last"} == {str(i): same(json.dumps(v)) for i, v in enumerate(values)}
    assert [r.company_name for r in rows if r.plan_name == "last"] == ["New"]


def test_append_reads_the_files_it_meets(spark, plans_table):
    """Answers come in order: a batch of 1 % of the keys reads one file in fifty."""
    def batch(n):
        rows = spark.range(100 * n, 100 * n + 100).selectExpr("format_string('a%08d', id) AS answer_id", "0 AS pos", "'C' AS company_name", "'p' AS plan_name")
        kinds = {f.name: f.dataType for f in spark.table(plans_table).schema}
        return rows.withColumns({c: F.lit(None).cast(t) for c, t in kinds.items() if c not in rows.columns and c != "id"})

    for n in range(12):
        tb.append_plans(batch(n).coalesce(1), plans_table)
    tb.append_plans(batch(5), plans_table)  # delivered again
    spark.catalog.refreshTable(plans_table)
    ids = [r.id for r in spark.table(plans_table).orderBy("answer_id").collect()]
    assert ids == list(range(1200))
    keys = tb.stored_keys(spark.table(plans_table), batch(7))
    assert sorted(r.answer_id for r in keys.collect()) == [f"a{i:08d}" for i in range(700, 800)]
    plan = keys._jdf.queryExecution().executedPlan()
    keys._jdf.queryExecution().executedPlan().execute().count()
    leaf = plan.collectLeaves().head()
    assert leaf.metrics().apply("numOutputRows").value() <= 2 * 100


def test_sql_reads_only(spark):
    spark.range(5).createOrReplaceTempView("guarded")
    assert workspace.sql(spark, "SELECT id FROM guarded WHERE id > :low ORDER BY id DESC; ", low=2).collect() == [(4,), (3,)]
    assert workspace.sql(spark, "WITH x AS (SELECT 1 AS a) SELECT a FROM x -- end").collect() == [(1,)]
    assert workspace.sql(spark, "VALUES (1), (2)").count() == 2
    refused = [
        "DROP VIEW guarded", "CREATE VIEW w AS SELECT 1", "CREATE TABLE t AS SELECT 1", "INSERT INTO guarded VALUES (9)", "SET spark.x = 1",
        "TRUNCATE TABLE guarded", "SELECT 1; DROP VIEW guarded", "SELECT 1) t; DROP VIEW guarded --", "", "ADD JAR 'x.jar'", "REFRESH TABLE guarded",
        "BEGIN DROP VIEW guarded; END", "WITH x AS (SELECT 1) INSERT INTO guarded SELECT * FROM x", "SELECT reflect('java.lang.System', 'exit', 1)",
    ]
    for statement in refused:
        with pytest.raises(workspace.NotAQuery):
            workspace.sql(spark, statement)
    assert spark.table("guarded").count() == 5


def test_quarantine_makes_each_answer_once(spark):
    from conftest import SF_SMALL

    from tarifflow.plans.catalogue import QUERIES

    plan = QUERIES["extraction_quarantine"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_only_objects_are_answers(spark):
    texts = ['{"plans": []}', ' \t\r\n{"a": 1}', "```json\n{}\n```", "[]", '[{"a": 1}]', '"{}"', "1", "null", "{", "", None, "\x0b{}"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i INT, response STRING")
    assert {r.i for r in ex.parse_answers(rows).where("doc IS NOT NULL").collect()} == {0, 1, 2}


def test_one_answer_query_stores_nothing(spark):
    import os

    from conftest import SF_SMALL

    from tarifflow.operators.ordered import ensure_checkpoint_dir
    from tarifflow.plans.catalogue import QUERIES

    ensure_checkpoint_dir(spark)
    where = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(where))
    for name in ("latest_plans", "compare_providers", "recent_plans"):
        assert QUERIES[name](spark, SF_SMALL).count() > 0
    assert set(os.listdir(where)) == before
