import random
from datetime import datetime, timedelta
from urllib.robotparser import RobotFileParser

import pytest

from tarifflow.operators import frontier as fr
from tarifflow.operators import robots as rb

T0 = datetime(2024, 1, 1)


def test_duplicate_url_goes_to_the_first_provider(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", "https://e.com"), (1, 1, "b", "https://e.com"), (1, 2, "c", "https://e.com/"), (2, 0, "b", "https://e.com")],
        "call_id BIGINT, pos BIGINT, provider STRING, url STRING",
    )
    assert {(r.call_id, r.provider) for r in fr.dedup_urls(df).collect()} == {(1, "a"), (1, "c"), (2, "b")}


def test_cache_split(spark):
    meta = spark.createDataFrame(
        [("fresh", True, T0), ("stale", True, T0 - timedelta(hours=24)), ("failed", False, T0)],
        "provider_name STRING, success BOOLEAN, scraped_at TIMESTAMP_NTZ",
    )
    asked = [("fresh", False), ("fresh", True), ("stale", False), ("failed", False), ("new", False)]
    df = spark.createDataFrame([(i, p, f) for i, (p, f) in enumerate(asked)], "pos INT, provider STRING, force BOOLEAN")
    hits, misses = fr.cache_split(df, meta, "TIMESTAMP_NTZ '2024-01-01 00:00:00'")
    assert [r.pos for r in hits.collect()] == [0]
    assert sorted(r.pos for r in misses.collect()) == [1, 2, 3, 4]


def replay_loop(rows, ttl):
    state, out = {}, {}
    for provider, at, force, ok, call, pos in sorted(rows, key=lambda r: (r[1], r[4], r[5])):
        last = state.get(provider)
        hit = not force and last is not None and last[1] and at - last[0] < ttl
        if not hit:
            state[provider] = (at, ok)
        out[call, pos] = hit
    return out


@pytest.mark.parametrize("fold_rows, split_rows", [(1000, 10**6), (1000, 60), (3, 10**6), (3, 60)])
@pytest.mark.parametrize("seed", [1, 2])
def test_cache_replay_equals_loop(spark, fold_rows, split_rows, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        provider = "hot" if rng.random() < 0.4 else f"p{rng.randint(0, 9)}"
        at = T0 + timedelta(hours=rng.randint(0, 24 * 12 * 4) / 4)
        rows.append((provider, at, rng.random() < 0.03, rng.random() < 0.8, i // 5, i % 5))
    df = spark.createDataFrame(
        rows, "provider STRING, requested_at TIMESTAMP_NTZ, force BOOLEAN, ok BOOLEAN, call_id INT, pos INT"
    )
    got = fr.cache_replay(df, fold_rows=fold_rows, split_rows=split_rows).collect()
    assert {(r.call_id, r.pos): r.cache_hit for r in got} == replay_loop(rows, timedelta(hours=24))


def test_cache_and_force_in_a_row(spark):
    rows = [("c", T0, False, True, 0, 0), ("c", T0 + timedelta(hours=1), False, True, 1, 0), ("c", T0 + timedelta(hours=2), True, True, 2, 0)]
    df = spark.createDataFrame(rows, "provider STRING, requested_at TIMESTAMP_NTZ, force BOOLEAN, ok BOOLEAN, call_id INT, pos INT")
    assert [r.cache_hit for r in fr.cache_replay(df).orderBy("call_id").collect()] == [False, True, False]


@pytest.mark.parametrize("split_rows", [10**6, 50])
def test_throttle_equals_loop(spark, split_rows):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", "b"]), T0 + timedelta(milliseconds=rng.randint(0, 200_000)), i, 0) for i in range(400)]
    last, want = {}, {}
    for domain, at, call, pos in sorted(rows, key=lambda r: (r[1], r[2])):
        start = at if domain not in last else max(at, last[domain] + timedelta(seconds=2))
        last[domain] = want[call] = start
    df = spark.createDataFrame(rows, "domain STRING, requested_at TIMESTAMP_NTZ, call_id INT, pos INT")
    got = fr.throttle_schedule(df, split_rows=split_rows).collect()
    assert {r.call_id: r.dispatch_at for r in got} == want
    assert all(r.wait_ms == (r.dispatch_at - r.requested_at) // timedelta(milliseconds=1) for r in got)


def test_retry_outcome(spark):
    log = [
        ("first", 1, True, None),
        ("second", 1, False, "e1"), ("second", 2, True, None), ("second", 3, False, "never"),
        ("never", 1, False, "e1"), ("never", 2, False, "e2"), ("never", 3, False, "site unreachable"), ("never", 4, True, None),
    ]
    df = spark.createDataFrame(log, "fetch_id STRING, attempt INT, ok BOOLEAN, error STRING")
    got = {r.fetch_id: (r.success, r.attempts_used, r.waited_seconds, r.error) for r in fr.retry_outcome(df).collect()}
    assert got == {
        "first": (True, 1, 0.0, None),
        "second": (True, 2, 2.0, None),
        "never": (False, 3, 6.0, "site unreachable"),
    }


def test_summary_keeps_frontier_order(spark):
    df = spark.createDataFrame(
        [(1, 0, "b", True), (1, 1, "a", False), (1, 2, "c", True)], "call_id INT, pos INT, provider STRING, succeeded BOOLEAN"
    )
    assert tuple(fr.scrape_summary(df).first()) == (1, 2, 3)
    assert [r.provider for r in fr.scraped_providers(df).orderBy("pos").collect()] == ["b", "c"]


def test_robots_equal_the_standard_library(spark):
    rng = random.Random(11)
    pieces = [
        "User-agent: *", "user-agent: bot", "Disallow: /a", "Disallow: /a/b", "Allow: /a/b/c", "Disallow:", "Disallow: *",
        "", "# note", "Allow: /%7Eme", "Disallow: /x?q", "Crawl-delay: 5", "Sitemap: http://s", "   ", "Disallow: / # all", "nonsense",
    ]
    paths = ["", "/", "/a", "/a/b", "/a/b/c/d", "/~me/x", "/%7eme", "/x?q=1", "/x", "/z#f"]
    files = ["\n".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(150)]
    robots = spark.createDataFrame([(f"d{i}", 200, body) for i, body in enumerate(files)], "domain STRING, status INT, body STRING")
    front = spark.createDataFrame(
        [(f"d{i}", f"https://d{i}{p}") for i in range(len(files)) for p in paths], "domain STRING, url STRING"
    )
    allowed, blocked = rb.robots_filter(front, rb.robots_policies(robots))
    got = {r.url: True for r in allowed.collect()} | {r.url: False for r in blocked.collect()}
    wrong = []
    for i, body in enumerate(files):
        parser = RobotFileParser()
        parser.parse(body.splitlines())
        parser.modified()
        for p in paths:
            url = f"https://d{i}{p}"
            if got[url] != parser.can_fetch("*", url):
                wrong.append((body, p))
    assert not wrong


def test_robots_status_and_message(spark):
    rows = [("none", 403, ""), ("open", 404, ""), ("down", 503, ""), ("lost", None, None), ("ok", 200, "User-agent: *\nDisallow: /p")]
    robots = spark.createDataFrame(rows, "domain STRING, status INT, body STRING")
    front = spark.createDataFrame([(d, f"https://{d}/p") for d in ("none", "open", "down", "lost", "ok", "unlisted")], "domain STRING, url STRING")
    allowed, blocked = rb.robots_filter(front, rb.robots_policies(robots))
    assert {r.domain for r in allowed.collect()} == {"open", "lost", "unlisted"}
    refused = blocked.collect()
    assert {r.domain for r in refused} == {"none", "down", "ok"}
    assert {(r.success, r.error) for r in refused} == {(False, "Disallowed by robots.txt")}
