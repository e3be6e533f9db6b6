from datetime import datetime

from tarifflow.operators import logs as lg


def test_answers_in_turn_order(spark):
    rows = [
        (1, 2, "assistant", "second "), (1, 0, "user", "q"), (1, 1, "assistant", " first"), (1, 3, "tool", "t"),
        (2, 0, "user", "only asks"), (3, 1, "assistant", "  \n "),
    ]
    df = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    assert [tuple(r) for r in lg.assemble_answers(df).collect()] == [(1, 0, "first\nsecond")]


def test_huge_answers_come_in_parts(spark):
    rows = [(1, i, "assistant", f"text {i}") for i in range(400)] + [(2, 0, "assistant", "small")]
    df = spark.createDataFrame(rows, "conv_id INT, turn INT, role STRING, text STRING")
    got = lg.assemble_answers(df, part_chars=500, split_rows=50).orderBy("conv_id", "part").collect()
    assert "\n".join(r.answer for r in got if r.conv_id == 1) == "\n".join(f"text {i}" for i in range(400))
    assert len(got) > 3 and max(len(r.answer) for r in got) < 520
    assert (got[-1].conv_id, got[-1].part, got[-1].answer) == (2, 0, "small")


def test_last_source_url(spark):
    rows = [
        (1, 0, "pages", "see https://a.b/x) and https://c.d"), (1, 1, "pages", "nothing"), (1, 2, "SQLite", "https://no.no"),
        (2, 0, "sqlite", "https://no.no"),
    ]
    df = spark.createDataFrame(rows, "conv_id INT, seq INT, server STRING, text STRING")
    assert [tuple(r) for r in lg.last_source_url(df).collect()] == [(1, "https://a.b/x)")]


def test_trace_lines(spark):
    lines = [
        "Query: compare", "  [01:15:46] 🧠 THINKING    Sending query...", "2026-08-18 01:15:50,390 - INFO - x",
        "  [01:15:50] 🔧 TOOL_CALL   scrape with args={'a': 'b'}", "  [01:15:50] ✅ TOOL_RESULT scrape -> 18 chars returned",
        "  [01:15:51] ❌ TOOL_ERROR  oops", "  [01:16:08] 💬 ANSWER      All done, see below:", "", "1. **Cloud**",
        "  [01:16:09] 🗄️ DB          Extracting", "  [01:16:09] • OTHER       none",
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "seq INT, value STRING")
    got = [tuple(r) for r in lg.parse_trace(df).orderBy("seq").collect()]
    assert [(g[0], g[1], g[2]) for g in got] == [
        (1, "01:15:46", "THINKING"), (3, "01:15:50", "TOOL_CALL"), (4, "01:15:50", "TOOL_RESULT"),
        (5, "01:15:51", "TOOL_ERROR"), (6, "01:16:08", "ANSWER"), (9, "01:16:09", "DB"),
    ]
    assert got[1][3] == "scrape with args={'a': 'b'}"
    assert tuple(lg.tool_error_share(lg.parse_trace(df)).first()) == (2, 1, 5000)


def test_gaps_over_one_global_order(spark):
    rows = [(i, datetime(2024, 1, 1, 0, 0, i % 50, i), "DB") for i in range(300)]
    df = spark.createDataFrame(rows, "seq INT, ts TIMESTAMP_NTZ, stage STRING")
    times = sorted((r[1], r[0]) for r in rows)
    want = {a[1]: (b[0] - a[0]).seconds * 10**6 + (b[0] - a[0]).microseconds for a, b in zip(times, times[1:])}
    for split_rows in (10**6, 40):
        gapped = lg.stage_gaps(df, split_rows=split_rows)
        assert {r.seq: r.gap_us for r in gapped.collect() if r.gap_us is not None} == want
    stats = lg.stage_stats(lg.stage_gaps(df)).first()
    assert (stats.events, stats.total_gap_us) == (300, sum(want.values()))


def test_result_log_forms(spark):
    texts = [
        "[{'company_name': 'Nimbus', 'plan_name': 'Basic', 'input_tokens': 0.5, 'output_tokens': 1.5, 'currency': 'USD'}, "
        "{'company_name': 'Quartz', 'plan_name': 'Plain', 'input_tokens': 0.59, 'output_tokens': 0.79, 'currency': 'USD'}]",
        '[{"company_name": "Sparkler", "plan_name": "Base"}]', "[]", "",
        "[{'company_name': \"O'Neil\", 'plan_name': None, 'input_tokens': 1, 'output_tokens': None}]",
        "[{'company_name': 'It\\'s', 'plan_name': 'x'}]", '[{"company_name": "None of it"}]', "no rows",
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, result_text STRING")
    parsed = lg.parse_result_log(df).collect()
    got = {r.i: r.rows for r in parsed}
    assert [(x.company_name, x.input_tokens) for x in got[0]] == [("Nimbus", 0.5), ("Quartz", 0.59)]
    assert got[1][0].company_name == "Sparkler" and got[1][0].currency is None
    assert got[2] == [] and got[3] == [] and got[7] is None
    assert (got[4][0].company_name, got[4][0].plan_name, got[4][0].input_tokens) == ("O'Neil", None, 1.0)
    assert got[5][0].company_name == "It's" and got[6][0].company_name == "None of it"
    cells = {r.i: r.cells for r in parsed}
    assert cells[0][1]["output_tokens"] == "0.79" and cells[4] == [
        {"company_name": "O'Neil", "plan_name": None, "input_tokens": "1", "output_tokens": None}
    ]


def test_result_log_keeps_every_column(spark):
    texts = ["[{'id': 7, 'tags': ['a', None], 'note': 'x'}]", '[{"id": 8, "deep": {"k": 1}}]', None, "[1, None]", "{'a': None}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, result_text STRING")
    got = {r.i: r.cells for r in lg.parse_result_log(df).collect()}
    assert got[0] == [{"id": "7", "tags": '["a",null]', "note": "x"}] and got[1] == [{"id": "8", "deep": '{"k":1}'}]
    assert got[2] is None and got[3] is None and got[4] is None


def test_parts_of_an_answer_make_the_whole(spark):
    turns = ["  ", "aa ", "   ", " bb", "", "cc", " \n"]
    rows = [("c", i, "assistant", t) for i, t in enumerate(turns)] + [("d", 0, "assistant", "  ")]
    df = spark.createDataFrame(rows, "conv_id STRING, turn INT, role STRING, text STRING")
    whole = lg.assemble_answers(df).collect()
    assert [(r.conv_id, r.answer) for r in whole] == [("c", "\n".join(turns).strip())]
    for size in (1, 4, 9):
        parts = lg.assemble_answers(df, part_chars=size).orderBy("part").collect()
        assert {r.conv_id for r in parts} == {"c"}
        assert "\n".join(r.answer for r in parts) == whole[0].answer
