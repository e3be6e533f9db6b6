"""What to collect, when, and how it went: the crawl-frontier decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ordered import BROADCAST_ROWS, SPLIT_ROWS, OrderedScan, durable, stage
from .robots import mark_robots
from .skew import first_per

# --- fixed values -----------------------------------------------------------
MIN_REQUEST_GAP_SECONDS = 2.0
MAX_ATTEMPTS = 3
BACKOFF_BASE_SECONDS = 2.0
# --- end of fixed values ----------------------------------------------------

FOLD_ROWS = 1_000


def dedup_urls(frontier: DataFrame) -> DataFrame:
    """Within a call the first provider (lowest ``pos``) of an exact URL wins."""
    return first_per(frontier, ["call_id", "url"], ["pos"])


def mark_cache_hits(
    frontier: DataFrame, metadata: DataFrame, now: str, ttl_hours: int = text.CACHE_TTL_HOURS
) -> DataFrame:
    """Adds ``cache_hit``: not forced, and the provider's last attempt succeeded
    and is fresh.  The provider name is the cache key, not the URL.

    ``now`` is an SQL expression over the frontier, such as ``requested_at``.
    """
    # One entry per provider, the latest: repeated entries must not double requests.
    entries = (
        metadata.groupBy(F.col("provider_name").alias("provider"))
        .agg(F.max(F.struct("scraped_at", "success")).alias("_entry"))
        .select("provider", F.col("_entry.success").alias("_ok"), F.col("_entry.scraped_at").alias("_scraped_at"))
    )
    hit = ~F.col("force") & F.coalesce("_ok", F.lit(False)) & text.is_fresh("_scraped_at", now, ttl_hours)
    decided = frontier.join(entries, "provider", "left").withColumn("cache_hit", hit)
    return decided.select(*frontier.columns, "cache_hit")


def cache_split(
    frontier: DataFrame, metadata: DataFrame, now: str, ttl_hours: int = text.CACHE_TTL_HOURS
) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of ``mark_cache_hits``."""
    marked = mark_cache_hits(frontier, metadata, now, ttl_hours)
    return marked.where("cache_hit").drop("cache_hit"), marked.where("NOT cache_hit").drop("cache_hit")


def throttle_schedule(
    requests: DataFrame,
    gap_seconds: float = MIN_REQUEST_GAP_SECONDS,
    order: Sequence[str] = ("call_id", "pos"),
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Earliest dispatch time per domain with a minimum gap between requests.

    ``start(i) = max(t(i), start(i-1) + gap)`` unrolls to
    ``gap*i + max over j<=i of (t(j) - gap*j)``: two prefix scans, no loop.
    Adds ``dispatch_at`` and ``wait_ms``.
    """
    gap = int(gap_seconds * 1_000_000)
    columns = requests.columns
    timed = requests.withColumn("_t", F.expr(text.micros_sql("requested_at")))
    scan = (
        OrderedScan(timed, ["domain"], ["_t", *order], split_rows=split_rows)
        .running_sum("_i", F.lit(1).cast("bigint"))
        .with_column("_slack", F.col("_t") - F.col("_i") * gap)
        .running_max("_late", F.col("_slack"))
    )
    dispatch = F.col("_late") + F.col("_i") * gap
    return (
        scan.frame()
        .withColumn("_d", dispatch)
        .select(
            *columns,
            F.expr(text.from_micros_sql("_d")).alias("dispatch_at"),
            F.expr("(_d - _t) DIV 1000").alias("wait_ms"),
        )
    )


def plan_collection(
    frontier: DataFrame,
    metadata: DataFrame,
    policies: DataFrame,
    now: str = "requested_at",
    ttl_hours: int = text.CACHE_TTL_HOURS,
    gap_seconds: float = MIN_REQUEST_GAP_SECONDS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Decide every row of a frontier, in the order a crawler checks: duplicates
    of a call go first, then cache hits, then what robots rules forbid; the rest
    is scheduled.

    Adds ``decision`` ('duplicate', 'cache_hit', 'blocked', 'fetch') and, for
    fetches, ``dispatch_at`` and ``wait_ms``.
    """
    key = ["call_id", "pos"]
    kept = dedup_urls(frontier.select(*key, "url")).select(*key, F.lit(True).alias("_first"))
    marked = mark_cache_hits(frontier.join(kept, key, "left"), metadata, now, ttl_hours)
    decision = (
        F.when(F.col("_first").isNull(), "duplicate")
        .when(F.col("cache_hit"), "cache_hit")
        .when(~F.col("robots_allowed"), "blocked")
        .otherwise("fetch")
    )
    # Written once: the schedule reads the fetches, the rest is passed through.
    judged = stage(
        mark_robots(marked, policies).withColumn("decision", decision).drop("_first", "cache_hit", "robots_allowed")
    )
    fetches = throttle_schedule(judged.where("decision = 'fetch'"), gap_seconds, split_rows=split_rows)
    return fetches.unionByName(judged.where("decision <> 'fetch'"), allowMissingColumns=True)


def retry_outcome(
    attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, base_seconds: float = BACKOFF_BASE_SECONDS
) -> DataFrame:
    """Fold an attempt log (fetch_id, attempt, ok, error) per fetch.

    The first success ends the fetch, attempts beyond ``max_attempts`` never
    happen, and each failure but the last allowed one waits ``base ** attempt``.
    """
    tries = range(1, max_attempts + 1)
    per_try = []
    for k in tries:
        is_k = F.col("attempt") == k
        per_try.append(F.bool_or(F.when(is_k, F.col("ok"))).alias(f"_ok{k}"))
        per_try.append(F.max(F.when(is_k, F.col("error"))).alias(f"_err{k}"))
    folded = attempts.where(F.col("attempt") <= max_attempts).groupBy("fetch_id").agg(*per_try)
    first_ok = F.coalesce(*[F.when(F.col(f"_ok{k}"), F.lit(k)) for k in tries])
    last_seen = F.greatest(*[F.when(F.col(f"_ok{k}").isNotNull(), F.lit(k)) for k in tries])
    used = folded.withColumn("_first_ok", first_ok).withColumn("_used", F.coalesce("_first_ok", last_seen))
    waited = sum(
        (
            F.when(~F.col(f"_ok{k}") & (F.lit(k) < F.col("_used") + F.col("_first_ok").isNull().cast("int")), base_seconds**k)
            .otherwise(0.0)
            for k in tries
            if k < max_attempts
        ),
        F.lit(0.0),
    )
    error = F.coalesce(*[F.when(F.col("_used") == k, F.col(f"_err{k}")) for k in tries])
    return used.select(
        "fetch_id",
        F.col("_first_ok").isNotNull().alias("success"),
        F.col("_used").cast("bigint").alias("attempts_used"),
        F.coalesce(waited, F.lit(0.0)).alias("waited_seconds"),
        F.when(F.col("_first_ok").isNull(), error).alias("error"),
    )


def scrape_summary(decided: DataFrame) -> DataFrame:
    """Per call: how many providers succeeded (fresh scrapes and cache hits) of
    how many asked for.  ``decided`` holds every requested row, duplicates
    included, with a boolean ``succeeded``."""
    return decided.groupBy("call_id").agg(
        F.count_if("succeeded").alias("succeeded"), F.count(F.lit(1)).alias("requested")
    )


def scraped_providers(decided: DataFrame) -> DataFrame:
    """The successful providers of each call, one row each; ``pos`` keeps the
    frontier order, so no list has to be gathered."""
    return decided.where("succeeded").select("call_id", "pos", "provider")


# --- cache replay --------------------------------------------------------------


def cache_replay(
    requests: DataFrame,
    ttl_hours: float = text.CACHE_TTL_HOURS,
    order: Sequence[str] = ("call_id", "pos"),
    fold_rows: int = FOLD_ROWS,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """Decide hit or miss for a whole request log in time order.

    Input: provider, requested_at, force, ok (outcome if fetched), ``order``.
    A hit does not renew the time; a failed fetch makes the next request a miss.
    Adds ``cache_hit``.

    A forced request and one that comes a full TTL after its predecessor are
    misses whatever happened before, so the log falls into independent segments.
    Short segments are folded inside one row.  Long ones (a hot provider) follow
    "next fetch" pointers by doubling: joins on unique row numbers, no big group.
    """
    ttl = int(ttl_hours * 3_600_000_000)
    columns = requests.columns
    timed = requests.withColumn("_t", F.expr(text.micros_sql("requested_at")))
    starts = F.col("_prev").isNull() | F.col("force") | (F.col("_t") - F.col("_prev._t") >= ttl)
    scan = (
        OrderedScan(timed, ["provider"], ["_t", *order], split_rows=split_rows)
        .lag("_prev", "_t")
        .running_sum("_i", F.lit(1).cast("bigint"))
        .with_column("_start", starts)
        .running_sum("_seg", F.col("_start").cast("bigint"))
    )
    rows = scan.frame().drop("_prev")
    seg = ["provider", "_seg"]
    long_segments = durable(
        rows.groupBy(*seg).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold_rows).select(*seg)
    )
    n_long = long_segments.count()
    if n_long == 0:
        return _fold_segments(rows, seg, columns, ttl)
    if n_long <= BROADCAST_ROWS:
        long_segments = F.broadcast(long_segments)
    short = _fold_segments(rows.join(long_segments, seg, "left_anti"), seg, columns, ttl)
    return short.unionByName(_chase_segments(rows.join(long_segments, seg, "left_semi"), seg, columns, ttl, split_rows))


def _fold_segments(rows: DataFrame, seg: list[str], columns: list[str], ttl: int) -> DataFrame:
    rest = [c for c in columns if c != "provider"]
    # State: time and outcome of the last fetch, row numbers of all fetches.
    fold = f"""
        aggregate(
          items,
          CAST(named_struct('at', NULL, 'fine', false, 'fetched', array())
               AS STRUCT<at: BIGINT, fine: BOOLEAN, fetched: ARRAY<BIGINT>>),
          (s, r) -> IF(NOT r.row.force AND s.fine AND r._t - s.at < {ttl}, s,
            named_struct('at', r._t, 'fine', r.row.ok, 'fetched', concat(s.fetched, array(r._i)))),
          s -> s.fetched)
    """
    grouped = rows.groupBy(*seg).agg(
        F.array_sort(F.collect_list(F.struct("_i", "_t", F.struct(*rest).alias("row")))).alias("items")
    )
    return (
        grouped.withColumn("fetched", F.expr(fold))
        .select("provider", "fetched", F.explode("items").alias("item"))
        .select("provider", "item.row.*", (~F.array_contains("fetched", F.col("item._i"))).alias("cache_hit"))
        .select(*columns, "cache_hit")
    )


def _chase_segments(rows: DataFrame, seg: list[str], columns: list[str], ttl: int, split_rows: int) -> DataFrame:
    rows = durable(rows)
    # Row that would be fetched next if row _i is fetched: after a failure the
    # next one, else the first at least one TTL later.  The latter is found by
    # sorting expiry times in among the request times, latest first.
    line = rows.select(*seg, F.col("_t").alias("_at"), F.lit(1).alias("_kind"), F.col("_i"), F.col("_i").alias("_target"))
    expiry = rows.where("ok").select(
        *seg, (F.col("_t") + ttl).alias("_at"), F.lit(0).alias("_kind"), F.col("_i"), F.lit(None).cast("bigint").alias("_target")
    )
    looked_up = (
        OrderedScan(line.unionByName(expiry), seg, ["_at", "_kind", "_i"], descending=True, split_rows=split_rows)
        .running_min("_next", F.col("_target"))
        .frame()
        .where("_kind = 0")
        .select(*seg, "_i", "_next")
    )
    # The number after a segment's last row belongs to no row and leads nowhere.
    if_failed = rows.where("NOT ok").select(*seg, "_i", (F.col("_i") + 1).alias("_next"))
    pointers = durable(looked_up.unionByName(if_failed).where("_next IS NOT NULL"))
    fetched = rows.where("_start").select(*seg, "_i")
    key = [*seg, "_i"]
    while not pointers.isEmpty():
        reached = fetched.join(pointers, key).select(*seg, F.col("_next").alias("_i"))
        fetched = durable(fetched.unionByName(reached).distinct())
        hop = pointers.select(*seg, F.col("_i").alias("_next"), F.col("_next").alias("_far"))
        pointers = durable(pointers.join(hop, [*seg, "_next"]).select(*key, F.col("_far").alias("_next")))
    return (
        rows.join(fetched.withColumn("_fetched", F.lit(True)), key, "left")
        .withColumn("cache_hit", F.col("_fetched").isNull())
        .select(*columns, "cache_hit")
    )
