import difflib
import json
import random
import re
from datetime import datetime, timedelta
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tarifflow.operators import changes as ch
from tarifflow.operators import snapshots as sn
from tarifflow.sources.payloads import normalize_payload, page_fields
from tarifflow.sources.tables import current_snapshots, read_snapshots, write_snapshots
from tarifflow.sources.texts import read_texts

T0 = datetime(2026, 8, 1)
PAYLOAD = "attempt_id INT, provider STRING, url STRING, scraped_at TIMESTAMP_NTZ, formats ARRAY<STRING>, body STRING, raised STRING"


def attempts(spark, rows, **options):
    """rows: (provider, markdown or None for a failure[, formats])."""
    data = []
    for i, (provider, body, *formats) in enumerate(rows):
        doc = None if body is None else json.dumps(body if isinstance(body, dict) else {"markdown": body})
        data.append(
            (i, provider, f"https://{provider}.example.com/p", T0 + timedelta(days=i), formats[0] if formats else ["markdown"], doc,
             "site unreachable" if doc is None else None)
        )
    return sn.clean_payloads(spark.createDataFrame(data, PAYLOAD), **options)


def test_payload_shapes(spark):
    bodies = [
        ('{"success": true, "markdown": "x"}', None), ('{"success": false, "error": "timeout"}', None), ('{"markdown": "x"}', None),
        (None, "site unreachable"), ('{"success": null}', None), ('{"success": 0}', None), ('{"success": "no"}', None),
        ('{"success": false, "error": null}', None),
    ]
    df = spark.createDataFrame([(i, b, r) for i, (b, r) in enumerate(bodies)], "i INT, body STRING, raised STRING")
    got = [(r.success, r.error) for r in normalize_payload(df).orderBy("i").collect()]
    assert got == [
        (True, None), (False, "timeout"), (True, None), (False, "site unreachable"), (False, "Unknown error"),
        (False, "Unknown error"), (True, None), (False, None),
    ]


def test_page_fields_key_presence(spark):
    bodies = ['{"metadata": {"title": "In", "description": null}, "description": "top"}', '{"title": "Top"}', '{"metadata": null, "title": null}', "{}"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i INT, body STRING").withColumn("payload", F.try_parse_json("body"))
    got = [(r.title, r.description) for r in page_fields(df).orderBy("i").collect()]
    assert got == [("In", None), ("Top", ""), ("", ""), ("", "")]


def test_successful_scrape_row(spark):
    body = {"success": True, "markdown": "Model V3 costs $0.50", "html": "<p>V3 <b>$0.50</b></p>", "metadata": {"title": "Pricing", "description": "Page"}}
    row = attempts(spark, [("first", body, ["markdown", "html"])]).first()
    assert (row.success, row.domain, row.title, row.description) == (True, "first.example.com", "Pricing", "Page")
    assert [(p.format, p.content) for p in row.parts] == [("markdown", "Model V3 costs $0.50"), ("html", "V3 $0.50")]
    assert row.content_hash == sha256(b"Model V3 costs $0.50V3 $0.50").hexdigest()
    assert row.content_lengths == {"markdown": 20, "html": 8} and row.truncated is False and row.truncated_formats == []


def test_cap_before_hash_and_total_length_shows(spark):
    text = "Pricing plan costs five dollars a month. " * 50
    rows = attempts(spark, [("a", text), ("a", text + "x"), ("b", text, ["markdown", "html"])], max_chars=1000).orderBy("attempt_id").collect()
    assert rows[0].truncated_formats == ["markdown"] and rows[0].parts[0].original_length == len(text.strip())
    assert rows[0].parts[0].content.startswith(text[:1000] + "\n\n[...content truncated: showing 1,000 of 2,049")
    assert rows[0].content_hash != rows[1].content_hash  # only the length in the note differs
    assert [p.content for p in rows[2].parts][1] == ""


def test_format_order_matters_for_the_hash(spark):
    body = {"markdown": "m", "html": "h"}
    a, b = attempts(spark, [("a", body, ["markdown", "html"]), ("a", body, ["html", "markdown"])]).orderBy("attempt_id").collect()
    assert (a.content_hash, b.content_hash) == (sha256(b"mh").hexdigest(), sha256(b"hm").hexdigest())


def test_failure_hides_a_change_but_not_the_prior_text(spark):
    df = attempts(spark, [("p", "A $1.00"), ("p", None), ("p", "A $2.00"), ("p", "A $2.00"), ("p", "A $3.00")])
    flags = {r.attempt_id: (r.content_changed, r.previous_scraped_at) for r in sn.content_changed(df).collect()}
    assert flags == {0: (False, None), 1: (False, None), 2: (False, None), 3: (False, None), 4: (True, T0 + timedelta(days=3))}
    prior = {r.attempt_id: r.prior_attempt_id for r in sn.prior_snapshot(sn.build_snapshots(df)).collect()}
    assert prior == {0: None, 2: 0, 3: 2, 4: 3}
    report = ch.pricing_changes(df, latest_only=False)
    got = {}
    for r in report.orderBy("attempt_id", "seq").collect():
        got.setdefault((r.attempt_id, r.content_changed), []).append((r.change, r.line))
    # Attempt 3 repeats attempt 2: the pair is equal again and the change is gone.
    assert got == {
        (2, False): [("removed", "A $1.00"), ("added", "A $2.00")],
        (4, True): [("removed", "A $2.00"), ("added", "A $3.00")],
    }


def test_report_lists_hash_changes_without_price_lines(spark):
    df = attempts(spark, [("p", "hello"), ("p", "world"), ("q", "same $5"), ("q", "same $5")])
    rows = ch.pricing_changes(df).collect()
    assert [(r.provider, r.content_changed, r.line) for r in rows] == [("p", True, None)]
    nested = ch.nest_report(ch.pricing_changes(df)).first()
    assert nested.changes == []


def test_latest_failure_is_not_reported(spark):
    df = attempts(spark, [("p", "A $1.00"), ("p", "A $2.00"), ("p", None)])
    assert ch.pricing_changes(df).count() == 0
    assert ch.pricing_changes(df, latest_only=False).select("attempt_id").distinct().count() == 1


def test_price_diff_of_the_second_scrape(spark):
    df = attempts(spark, [("p", "Model V3: $0.50 per 1M input tokens"), ("p", "Model V3: $0.75 per 1M input tokens"), ("other", "x $1")])
    for exact in (True, False):
        rows = ch.pricing_changes(df, exact=exact).collect()
        assert {(r.change, r.line) for r in rows} == {
            ("removed", "Model V3: $0.50 per 1M input tokens"), ("added", "Model V3: $0.75 per 1M input tokens")
        }
    one = spark.createDataFrame([("other",)], "provider STRING")
    assert ch.pricing_changes(df, one).count() == 0


def test_checked_providers(spark):
    df = attempts(spark, [("p", "A $1.00"), ("p", "A $2.00"), ("q", "A $1.00"), ("q", None)])
    calls = spark.createDataFrame([(1, "p"), (1, "q"), (2, "q"), (2, "unseen")], "call_id INT, provider STRING")
    assert {tuple(r) for r in ch.checked_providers(calls, ch.pricing_changes(df)).collect()} == {(2, "q"), (2, "unseen")}


PRICE = re.compile(r"[$€£]\s?\d|\d+\.\d{2}|per\s+1?[MK]?\s*tokens?", re.IGNORECASE)


def unified(old, new):
    """Added and removed lines as a unified diff of the two texts prints them."""
    a, b = (t.replace("\r\n", "\n").replace("\r", "\n").splitlines(keepends=True) for t in (old, new))
    body = list(difflib.unified_diff(a, b, lineterm=""))
    return [line for line in body if line[0] in "+-"]


def pairs(spark, texts):
    rows = [(i, "p", "markdown", T0, old, new) for i, (old, new) in enumerate(texts)]
    return spark.createDataFrame(
        rows, "attempt_id INT, provider STRING, format STRING, scraped_at TIMESTAMP_NTZ, prior_content STRING, content STRING"
    )


@pytest.fixture(scope="module")
def text_pairs():
    rng = random.Random(7)
    lines = ["A $1.00", "B $2.00", "", "note", "-- cut $3", "++ add 4.50", "per 1M tokens", "x\ry $7", " $9 "]
    made = [("A $1.00", "A $1.00\nB $2.00"), ("a\r\nb $1", "a\nb $1"), ("", "A $1.00"), ("A $1.00", "")]
    for _ in range(250):
        made.append(tuple("\n".join(rng.choices(lines, k=rng.randint(0, 9))) for _ in range(2)))
    return [p for p in made if p[0] != p[1]]


def test_exact_diff_equals_unified_diff(spark, text_pairs):
    got = {}
    for r in ch.line_diff(pairs(spark, text_pairs)).orderBy("attempt_id", "seq").collect():
        got.setdefault(r.attempt_id, []).append(("+" if r.change == "added" else "-") + r.line)
    for i, (old, new) in enumerate(text_pairs):
        # The two file headers are always there when anything differs.
        assert got.get(i, []) == unified(old, new)[2:], (old, new)


def test_prior_text_and_diff_give_the_current_text(spark, text_pairs):
    base = pairs(spark, text_pairs)
    got = {r.attempt_id: r.rebuilt for r in ch.apply_diff(base, ch.line_diff(base)).collect()}
    assert got == {i: new.replace("\r\n", "\n").replace("\r", "\n") for i, (_, new) in enumerate(text_pairs)}


def test_rebuilt_pairs_moves_no_text_for_the_diff(spark):
    """Texts rebuilt beside their pairs equal those of apply_diff, and the plan moves rows
    for the joins of the texts and for the order of providers alone."""
    base = [(1, "a\nb\nc\n"), (2, "b\nc\nd"), (3, "b\nc\nd"), (4, ""), (5, "x\nx\ny"), (6, "y\nx\nx\n")]
    rows = [(i, p, "markdown", datetime(2024, 1, i), f"{t}{p}" if t else "") for p in ("p", "q") for i, t in base]
    rows = [(i + 10 * (p == "q"), p, *rest) for i, p, *rest in rows]
    stored = spark.createDataFrame(rows, "attempt_id BIGINT, provider STRING, format STRING, scraped_at TIMESTAMP_NTZ, content STRING")
    pairs = sn.snapshot_pairs(stored.withColumn("text_hash", F.sha2("content", 256)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rebuilt = ch.rebuilt_pairs(pairs)
        moves = rebuilt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        got = {r.attempt_id: (r.rebuilt, r.in_order) for r in rebuilt.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {r.attempt_id: (r.content, True) for r in pairs.collect()}
    assert got == want and len(got) == 8
    assert {r.attempt_id: r.rebuilt for r in ch.apply_diff(pairs, ch.line_diff(pairs)).collect()} == {k: v for k, (v, _) in got.items()}
    assert moves == 5


def test_rebuilt_pairs_of_rows_that_come_twice(spark):
    row = (1, "p", "markdown", datetime(2024, 1, 1), "b\nx\ny", "a\nb\nc\n")
    pairs = spark.createDataFrame([row, row], "attempt_id BIGINT, provider STRING, format STRING, scraped_at TIMESTAMP_NTZ, content STRING, prior_content STRING")
    assert [tuple(r) for r in ch.rebuilt_pairs(pairs).collect()] == [(1, "markdown", "b\nx\ny", True)] * 2


def test_net_diff_needs_no_exchange(spark, text_pairs):
    plan = ch.line_diff_net(pairs(spark, text_pairs), price_lines_only=True)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_price_lines_of_the_exact_diff(spark, text_pairs):
    rows = ch.price_changes(ch.line_diff(pairs(spark, text_pairs))).orderBy("attempt_id", "seq").collect()
    got = {}
    for r in rows:
        got.setdefault(r.attempt_id, []).append((r.change, r.line))
    for i, (old, new) in enumerate(text_pairs):
        listed = [d for d in unified(old, new) if not d.startswith(("+++", "---")) and PRICE.search(d)]
        want = [("added" if d[0] == "+" else "removed", d[1:].strip()[:200]) for d in listed]
        assert got.get(i, []) == want, (old, new)


def test_net_diff_equals_netted_exact_diff(spark, text_pairs):
    base = pairs(spark, text_pairs)
    sign = F.expr("IF(change = 'added', 1, -1)")
    netted = ch.line_diff(base).groupBy("attempt_id", "line").agg(F.sum(sign).alias("net")).where("net <> 0")
    net = ch.line_diff_net(base).select("attempt_id", "line", "net")
    assert sorted(map(tuple, net.collect())) == sorted(map(tuple, netted.collect()))
    prices = ch.price_changes(ch.line_diff_net(base, price_lines_only=True), price_lines_only=True).select("attempt_id", "change", "line", "net")
    slow = ch.price_changes(ch.line_diff_net(base)).select("attempt_id", "change", "line", "net")
    assert sorted(map(tuple, prices.collect())) == sorted(map(tuple, slow.collect()))


def test_hot_provider_gives_the_same_report(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), None if rng.random() < 0.2 else f"v $1.0{rng.randint(0, 2)}") for _ in range(120)]
    df = attempts(spark, rows, any_html=False)
    whole = ch.pricing_changes(df, latest_only=False)
    split = ch.pricing_changes(df, latest_only=False, split_rows=20)
    assert sorted(map(str, whole.collect())) == sorted(map(str, split.collect()))


def test_snapshot_table_keeps_history(spark, tmp_path):
    path = str(tmp_path / "snaps")
    first, second = attempts(spark, [("p", "one"), ("p", "two"), ("q", "three")]), attempts(spark, [("p", "x")])
    write_snapshots(sn.build_snapshots(first), path)
    write_snapshots(sn.build_snapshots(second.withColumn("attempt_id", F.lit(9)).withColumn("scraped_at", F.lit(T0 + timedelta(days=30)).cast("timestamp_ntz"))), path)
    table = read_snapshots(spark, path)
    assert table.count() == 4
    assert {(r.provider, r.content) for r in current_snapshots(table).collect()} == {("p", "x"), ("q", "three")}


def test_stored_rows_move_once_and_narrow(spark, tmp_path):
    """Rows that come from a table are not written down again; the last ones of a provider
    and format go there by themselves, copies of an attempt included, not by their attempt."""
    path = str(tmp_path / "snaps")
    df = attempts(spark, [("p", "one"), ("p", "two"), ("q", "two"), ("q", None), ("p", "three")])
    df = df.unionByName(df.where("attempt_id = 4"))
    write_snapshots(sn.build_snapshots(df), path, stored=True)
    rows = read_snapshots(spark, path, texts=False)
    current = current_snapshots(rows, read_texts(spark, f"{path}/texts"))
    got = sorted((r.provider, r.attempt_id, r.content, r.text_hash) for r in current.collect())
    assert got == [(p, i, t, sha256(t.encode()).hexdigest()) for p, i, t in (("p", 4, "three"), ("p", 4, "three"), ("q", 2, "two"))]
    plan = current.select("provider", "attempt_id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "hashpartitioning(attempt_id" not in plan
    assert {r.scrape_hash for r in rows.collect()} == {r.content_hash for r in df.where("success").collect()}


def test_upsert_keeps_first_place(spark):
    schema = "provider STRING, note STRING, scraped_at TIMESTAMP_NTZ, ord BIGINT"
    old = spark.createDataFrame([("a", "old", T0, 0), ("b", "old", T0, 1)], schema)
    new = spark.createDataFrame([("a", "new", T0 + timedelta(days=1), 10), ("c", "new", T0, 11)], schema)
    assert [tuple(r) for r in sn.upsert_metadata(old, new).select("provider", "note", "ord").orderBy("ord").collect()] == [
        ("a", "new", 0), ("b", "old", 1), ("c", "new", 11)
    ]
    latest = sn.latest_per_provider(attempts(spark, [("p", "x"), ("p", None), ("q", "y")]).select("provider", "attempt_id", "scraped_at", "success"))
    assert [r.provider for r in sn.successful(latest).collect()] == ["q"]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.mark.parametrize("exact", [False, True])
def test_report_moves_attempts_once(spark, exact):
    df = attempts(spark, [("p", "A $1.00"), ("p", "A $2.00"), ("q", "B $1.00")], any_html=False)
    for latest_only in (False, True):
        # Behind Python rows count as unordered: diffs, not texts, move once more.
        assert exchanges(ch.pricing_changes(df, latest_only=latest_only, exact=exact)) == 1 + exact


def test_report_cuts_price_lines_before_texts_move(spark):
    """Each text is matched once, not once for every pair it is in, and below the exchange."""
    rows = [("p", "x\nA $1.00\nA $1.00"), ("p", "x\nA $1.00\nB $2.00"), ("p", "y\nB $2.00\nA $1.00"), ("p", ""), ("p", "++ $1.00\n-- $2.00")]
    df = attempts(spark, rows, any_html=False).localCheckpoint()
    report = ch.pricing_changes(df, latest_only=False, exact=False)
    plan = report._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("per[") == 1
    sign = F.expr("CASE change WHEN 'added' THEN n WHEN 'removed' THEN -n END")
    netted, want = ({tuple(r) for r in x.groupBy("attempt_id", "line").agg(F.sum(sign).alias("net")).where("line IS NULL OR net <> 0").collect()}
                    for x in (report, ch.pricing_changes(df, latest_only=False, exact=True)))
    assert netted == want and len(want) > 4


def test_report_lists_copies_of_an_attempt_as_joins_do(spark):
    df = attempts(spark, [("p", "A $1.00", ["markdown", "html"]), ("p", "A $2.00\nB $3.00", ["markdown", "html"]), ("p", "x"), ("q", "x"), ("q", "y")])
    twice = df.unionByName(df.where("attempt_id IN (0, 1, 4)"))
    for exact, rows in ((a, r) for a in (True, False) for r in (df, twice)):
        for latest_only in (True, False):
            args = {"latest_only": latest_only, "exact": exact}
            got = ch.pricing_changes(rows, **args)
            want = ch.pricing_changes(rows, snapshots=sn.build_snapshots(rows), **args).select(*got.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_a_diff_takes_few_pairs_at_a_time(spark):
    plan = ch.line_diff(pairs(spark, [("a", "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "InPandas" not in plan
