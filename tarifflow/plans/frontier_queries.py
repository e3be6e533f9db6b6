"""Queries for the frontier decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frontier as fr
from ..operators import robots as rb
from ..operators.skew import first_per
from . import oracle_parts as O
from .derived import attempt_log, requests, robots_texts
from .registry import query

GAP_SECONDS = 5400


@query(
    "dedup_urls",
    f"""WITH {O.REQUESTS}
    SELECT call_id, pos, provider, url FROM requests
    QUALIFY row_number() OVER (PARTITION BY call_id, url ORDER BY pos) = 1""",
)
def dedup_urls(spark, sf_dir):
    return fr.dedup_urls(requests(spark, sf_dir).select("call_id", "pos", "provider", "url"))


def _earliest_entries(reqs):
    """Metadata as the first request of each provider would leave it."""
    order = ["requested_at", "call_id", "pos"]
    return first_per(reqs.select("provider", "ok", *order), ["provider"], order).select(
        F.col("provider").alias("provider_name"), F.col("ok").alias("success"), F.col("requested_at").alias("scraped_at")
    )


@query(
    "cache_split",
    f"""WITH {O.REQUESTS},
    entries AS (SELECT provider, arg_min(ok, requested_at) AS good, min(requested_at) AS first_at FROM requests GROUP BY 1)
    SELECT call_id, pos, r.provider,
      NOT force AND good AND date_diff('microsecond', first_at, requested_at) < 86400000000 AS cache_hit
    FROM requests r JOIN entries USING (provider)""",
)
def cache_split(spark, sf_dir):
    reqs = requests(spark, sf_dir)
    hits, misses = fr.cache_split(reqs, _earliest_entries(reqs), "requested_at")
    key = ["call_id", "pos", "provider"]
    return hits.select(*key, F.lit(True).alias("cache_hit")).unionByName(
        misses.select(*key, F.lit(False).alias("cache_hit"))
    )


@query(
    "cache_replay",
    f"""WITH RECURSIVE {O.REQUESTS},
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY provider ORDER BY requested_at, call_id, pos) AS i FROM requests),
    replay AS (
      SELECT provider, i, call_id, pos, false AS cache_hit, requested_at AS last_at, ok AS last_ok
      FROM ordered WHERE i = 1
      UNION ALL
      SELECT o.provider, o.i, o.call_id, o.pos, hit, CASE WHEN hit THEN last_at ELSE o.requested_at END,
        CASE WHEN hit THEN last_ok ELSE o.ok END
      FROM (SELECT o.*, r.last_at, r.last_ok,
              NOT o.force AND r.last_ok AND date_diff('microsecond', r.last_at, o.requested_at) < 86400000000 AS hit
            FROM replay r JOIN ordered o ON o.provider = r.provider AND o.i = r.i + 1) o)
    SELECT provider, call_id, pos, cache_hit FROM replay""",
)
def cache_replay(spark, sf_dir):
    reqs = requests(spark, sf_dir).select("provider", "requested_at", "force", "ok", "call_id", "pos")
    return fr.cache_replay(reqs).select("provider", "call_id", "pos", "cache_hit")


_RULES = """
rules AS (
  SELECT DISTINCT 'd' || (user_id % 20) || '.example.com' AS domain, user_id % 20 AS n FROM events),
rule_rows AS (
  SELECT domain, 0::BIGINT AS seq, true AS allow, '/' || (n % 7) AS path FROM rules WHERE n % 10 > 3
  UNION ALL SELECT domain, 1, false, '/' || (n % 5) FROM rules WHERE n % 10 > 3
  UNION ALL SELECT domain, 2, false, '/3' FROM rules WHERE n % 10 > 3)"""


@query("robots_rules", f"WITH {_RULES} SELECT domain, seq, allow, path FROM rule_rows")
def robots_rules(spark, sf_dir):
    return rb.robots_rules(robots_texts(spark, sf_dir))


_ALLOWED = """CASE WHEN n % 10 IN (1, 3) THEN false WHEN n % 10 IN (0, 2) THEN true
  WHEN page = n % 7 THEN true WHEN page = n % 5 OR page = 3 THEN false ELSE true END"""


@query(
    "robots_filter",
    f"""WITH {O.REQUESTS}
    SELECT call_id, pos, url, {_ALLOWED} AS allowed,
      CASE WHEN NOT ({_ALLOWED}) THEN 'Disallowed by robots.txt' END AS error FROM requests""",
)
def robots_filter(spark, sf_dir):
    reqs = requests(spark, sf_dir).select("call_id", "pos", "url", "domain")
    allowed, blocked = rb.robots_filter(reqs, rb.robots_policies(robots_texts(spark, sf_dir)))
    key = ["call_id", "pos", "url"]
    return allowed.select(*key, F.lit(True).alias("allowed"), F.lit(None).cast("string").alias("error")).unionByName(
        blocked.select(*key, F.lit(False).alias("allowed"), "error")
    )


@query(
    "throttle_schedule",
    f"""WITH {O.REQUESTS},
    numbered AS (
      SELECT *, {O.micros('requested_at')} AS t,
        row_number() OVER (PARTITION BY domain ORDER BY requested_at, call_id, pos) AS i FROM requests),
    planned AS (
      SELECT *, i * {GAP_SECONDS}000000 + max(t - i * {GAP_SECONDS}000000) OVER (
        PARTITION BY domain ORDER BY i ROWS UNBOUNDED PRECEDING) AS d FROM numbered)
    SELECT call_id, pos, domain, make_timestamp(d) AS dispatch_at, (d - t) // 1000 AS wait_ms FROM planned""",
)
def throttle_schedule(spark, sf_dir):
    reqs = requests(spark, sf_dir).select("call_id", "pos", "domain", "requested_at")
    return fr.throttle_schedule(reqs, GAP_SECONDS).select("call_id", "pos", "domain", "dispatch_at", "wait_ms")


@query(
    "plan_collection",
    f"""WITH {O.REQUESTS},
    entries AS (SELECT provider, arg_min(ok, requested_at) AS good, min(requested_at) AS first_at FROM requests GROUP BY 1),
    judged AS (
      SELECT r.*, CASE
          WHEN row_number() OVER (PARTITION BY call_id, url ORDER BY pos) > 1 THEN 'duplicate'
          WHEN NOT force AND good AND date_diff('microsecond', first_at, requested_at) < 86400000000 THEN 'cache_hit'
          WHEN NOT ({_ALLOWED}) THEN 'blocked' ELSE 'fetch' END AS decision
      FROM requests r JOIN entries USING (provider)),
    numbered AS (
      SELECT *, {O.micros('requested_at')} AS t,
        row_number() OVER (PARTITION BY domain ORDER BY requested_at, call_id, pos) AS i
      FROM judged WHERE decision = 'fetch'),
    waits AS (
      SELECT call_id, pos, (i * {GAP_SECONDS}000000 + max(t - i * {GAP_SECONDS}000000) OVER (
        PARTITION BY domain ORDER BY i ROWS UNBOUNDED PRECEDING) - t) // 1000 AS wait_ms FROM numbered)
    SELECT call_id, pos, provider, url, decision, wait_ms FROM judged LEFT JOIN waits USING (call_id, pos)""",
)
def plan_collection(spark, sf_dir):
    reqs = requests(spark, sf_dir)
    policies = rb.robots_policies(robots_texts(spark, sf_dir))
    decided = fr.plan_collection(reqs, _earliest_entries(reqs), policies, gap_seconds=GAP_SECONDS)
    return decided.select("call_id", "pos", "provider", "url", "decision", "wait_ms")


@query(
    "retry_outcome",
    """WITH every_try AS (
      SELECT event_id // 4 AS fetch_id, event_id % 4 + 1 AS attempt, event_type IN ('view', 'purchase') AS ok,
        'failed: ' || event_type || ' ' || event_id AS error FROM events),
    log AS (SELECT * FROM every_try WHERE attempt <= 3),
    ends AS (
      SELECT fetch_id, min(attempt) FILTER (ok) AS first_ok, max(attempt) AS last_try,
        arg_max(error, attempt) AS last_error FROM log GROUP BY 1)
    SELECT fetch_id, first_ok IS NOT NULL AS success, coalesce(first_ok, last_try) AS attempts_used,
      (SELECT coalesce(sum(1000 * power(2, attempt)), 0)::BIGINT FROM log l WHERE l.fetch_id = e.fetch_id AND NOT ok
        AND attempt < 3 AND attempt < coalesce(first_ok, 99)) AS waited_ms,
      CASE WHEN first_ok IS NULL THEN last_error END AS error
    FROM ends e""",
)
def retry_outcome(spark, sf_dir):
    folded = fr.retry_outcome(attempt_log(spark, sf_dir))
    return folded.withColumn("waited_ms", (F.col("waited_seconds") * 1000).cast("bigint")).drop("waited_seconds")


_DECIDED = f"""WITH {O.REQUESTS},
    decided AS (
      SELECT *, ok AND row_number() OVER (PARTITION BY call_id, url ORDER BY pos) = 1 AS succeeded FROM requests)"""


def _decided(spark, sf_dir):
    reqs = requests(spark, sf_dir).select("call_id", "pos", "provider", "url", "ok")
    kept = fr.dedup_urls(reqs).where("ok").select("call_id", "pos", F.lit(True).alias("_s"))
    return reqs.join(kept, ["call_id", "pos"], "left").withColumn("succeeded", F.col("_s").isNotNull()).drop("_s")


@query(
    "scrape_summary",
    f"{_DECIDED} SELECT call_id, count_if(succeeded)::BIGINT AS succeeded, count(*) AS requested FROM decided GROUP BY 1",
)
def scrape_summary(spark, sf_dir):
    return fr.scrape_summary(_decided(spark, sf_dir))


@query("scraped_providers", f"{_DECIDED} SELECT call_id, pos, provider FROM decided WHERE succeeded")
def scraped_providers(spark, sf_dir):
    return fr.scraped_providers(_decided(spark, sf_dir))
