import random
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from test_snapshots import attempts

from tarifflow.operators import changes as ch
from tarifflow.operators import snapshots as sn
from tarifflow.operators.history import History
from tarifflow.plans.derived import stream_table
from tarifflow.streaming import jobs


def as_stream(spark, df, folder, batches):
    for part in batches:
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_folder(spark, folder, spark.read.parquet(folder).schema, files_per_trigger=1)


_ATTEMPT = ["attempt_id", "provider", "scraped_at", "content_hash", "parts", "success"]


def test_stream_changes_equal_batch_and_restart(spark, tmp_path):
    """Three files, one a trigger; the stream is stopped after two, then goes on; at last it
    starts anew with a lost checkpoint and finds all batches done."""
    rng = random.Random(4)
    rows = [(rng.choice("ppq"), None if rng.random() < 0.2 else f"head\nA $1.0{rng.randint(0, 3)}\nfoot {rng.randint(0, 1)}") for _ in range(40)]
    df = attempts(spark, rows, any_html=False).select(*_ATTEMPT).cache()
    folder, history = str(tmp_path / "in"), History(spark, str(tmp_path / "h"), "INT")
    parts = ["attempt_id < 15", "attempt_id BETWEEN 15 AND 29", "attempt_id > 29"]
    first = as_stream(spark, df, folder, parts[:2])
    jobs.run_into(jobs.stream_changes(first, history), str(tmp_path / "c1"))
    assert history.attempts().count() == 30
    stream = as_stream(spark, df, folder, parts[2:])
    jobs.run_into(jobs.stream_changes(stream, history), str(tmp_path / "c1"))
    out = history.changes().collect()
    flags = {(r.attempt_id, r.previous_scraped_at) for r in out if r.kind == "flag"}
    want = {(r.attempt_id, r.previous_scraped_at) for r in sn.content_changed(df).where("content_changed").collect()}
    assert flags == want and flags
    lines = sorted((r.attempt_id, r.seq, r.change, r.line) for r in out if r.kind == "pair")
    diff = ch.price_changes(ch.line_diff(sn.snapshot_pairs(sn.build_snapshots(df)))).collect()
    assert lines == sorted((r.attempt_id, r.seq, r.change, r.line) for r in diff) and lines
    assert not [r for r in out if r.kind == "late"]
    jobs.run_into(jobs.stream_changes(stream, history), str(tmp_path / "c2"))
    assert sorted(map(str, history.changes().collect())) == sorted(map(str, out))


def test_stream_dedup(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1, h)) for h in range(0, 20, 4)] + [("b", datetime(2024, 1, 1, 5))]
    rows += [("a", datetime(2024, 1, 2, 0)), ("a", datetime(2024, 1, 2, 23)), ("b", datetime(2024, 1, 2, 4))]
    df = spark.createDataFrame([(p, t, i) for i, (p, t) in enumerate(rows)], "provider STRING, ts TIMESTAMP, event_id LONG")
    stream = as_stream(spark, df, str(tmp_path / "in"), ["event_id < 3", "event_id BETWEEN 3 AND 5", "event_id > 5"])
    seen = []
    got = jobs.run_available(jobs.stream_dedup(stream, lateness="1 hour"), progress=seen.extend).collect()
    assert sorted((r.provider, r.ts) for r in got) == [("a", rows[0][1]), ("a", datetime(2024, 1, 2)), ("b", rows[5][1])]
    assert not any(r.late for r in got)


def test_dedup_state_ends(spark, tmp_path):
    """Providers that are not asked for again leave the state after their life; requests that
    come out of order within the lateness are reported."""
    day = datetime(2024, 1, 1)
    rows = [(f"p{i}", day, i) for i in range(50)] + [("a", day + timedelta(hours=40), 100), ("a", day + timedelta(hours=39), 101), ("a", day + timedelta(hours=41), 102)]
    rows += [("p1", day + timedelta(hours=90), 200), ("a", day + timedelta(hours=64), 201)]
    df = spark.createDataFrame(rows, "provider STRING, ts TIMESTAMP, event_id LONG")
    stream = as_stream(spark, df, str(tmp_path / "in"), ["event_id < 50", "event_id = 100", "event_id IN (101, 102)", "event_id = 200", "event_id = 201"])
    seen = []
    got = jobs.run_available(jobs.stream_dedup(stream, lateness="30 hours"), progress=seen.extend).collect()
    assert sorted((r.event_id, r.late) for r in got) == [(i, False) for i in range(50)] + [(100, False), (101, True), (200, False), (201, False)]
    state = [op["numRowsTotal"] for p in seen for op in p["stateOperators"]]
    assert max(state) >= 50 and state[-1] <= 6


def test_stage_counts_equal_batch_for_closed_windows(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(minutes=7 * i), "DB" if i % 3 else "ANSWER") for i in range(60)]
    df = spark.createDataFrame(rows, "ts TIMESTAMP, stage STRING")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.stream_stage_counts(jobs.read_folder(spark, str(tmp_path / "in"), df.schema))).collect()
    mark = max(r[0] for r in rows) - timedelta(minutes=10)
    want = {}
    for ts, stage in rows:
        hour = ts.replace(minute=0)
        if hour + timedelta(hours=1) <= mark:
            want[hour, stage] = want.get((hour, stage), 0) + 1
    assert {(r.window_start, r.stage): r.events for r in got} == want


def test_a_table_of_one_file_streams_on_all_cores(spark, tmp_path):
    pq.write_table(pa.table({"id": range(1000)}), str(tmp_path / "lines.parquet"))
    seen = []
    stream = stream_table(spark, str(tmp_path), "lines")
    writer = stream.writeStream.foreachBatch(lambda rows, _: seen.append((rows.rdd.getNumPartitions(), rows.count())))
    jobs.run_into(writer, str(tmp_path / "c"))
    assert seen == [(spark.sparkContext.defaultParallelism, 1000)]


def test_rows_do_not_depend_on_the_number_of_files(spark, tmp_path):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([(start + timedelta(minutes=7 * i), "DB") for i in range(60)], "ts TIMESTAMP, stage STRING")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    df.coalesce(1).write.parquet(one)
    df.repartition(50).write.parquet(many)
    counts = [
        sorted(tuple(r) for r in jobs.run_available(jobs.stream_stage_counts(jobs.read_folder(spark, f, df.schema))).collect())
        for f in (one, many)
    ]
    assert counts[0] == counts[1] and counts[0]
    split = jobs.stream_stage_counts(jobs.read_folder(spark, many, df.schema, files_per_trigger=10))
    with pytest.raises(jobs.LateRows):
        jobs.run_available(split)
