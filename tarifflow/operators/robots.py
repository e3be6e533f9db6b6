"""Robots rules as data: parse the texts once, decide URLs with one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
BLOCKED_MESSAGE = "Disallowed by robots.txt"
# --- end of fixed values ----------------------------------------------------


def _decoded(x: str) -> str:
    # %-escapes compared in decoded form; '+' is literal in a path.
    return f"coalesce(try_url_decode(replace({x}, '+', '%2B')), {x})"


# One robots file is one row, so its rule groups are read by a fold over its own
# lines.  `phase`: 0 between groups, 1 after an agent line, 2 after a rule line.
_CLOSE_GROUP = "IF(s.phase = 2 AND s.star AND s.chosen IS NULL, s.rules, s.chosen)"
_FOLD = f"""
aggregate(
  lines,
  CAST(named_struct('phase', 0, 'star', false, 'rules', array(), 'chosen', NULL)
       AS STRUCT<phase: INT, star: BOOLEAN, rules: ARRAY<STRUCT<allow: BOOLEAN, path: STRING>>,
                 chosen: ARRAY<STRUCT<allow: BOOLEAN, path: STRING>>>),
  (s, l) -> CASE
    WHEN l.kind = 'blank' AND s.phase > 0 THEN
      named_struct('phase', 0, 'star', false, 'rules', slice(s.rules, 1, 0), 'chosen', {_CLOSE_GROUP})
    WHEN l.kind = 'user-agent' AND s.phase = 1 THEN
      named_struct('phase', 1, 'star', s.star OR l.value = '*', 'rules', s.rules, 'chosen', s.chosen)
    WHEN l.kind = 'user-agent' THEN
      named_struct('phase', 1, 'star', l.value = '*', 'rules', slice(s.rules, 1, 0), 'chosen', {_CLOSE_GROUP})
    WHEN l.kind IN ('allow', 'disallow') AND s.phase > 0 THEN
      named_struct('phase', 2, 'star', s.star, 'rules', concat(s.rules, array(named_struct(
        'allow', l.kind = 'allow' OR l.value = '', 'path', l.value))), 'chosen', s.chosen)
    WHEN l.kind IN ('crawl-delay', 'request-rate') AND s.phase > 0 THEN
      named_struct('phase', 2, 'star', s.star, 'rules', s.rules, 'chosen', s.chosen)
    ELSE s END,
  s -> {_CLOSE_GROUP})
"""

_LINES = f"""
transform(
  split(body, '\\\\r\\\\n|\\\\r|\\\\n'),
  raw -> CASE
    WHEN raw = '' THEN named_struct('kind', 'blank', 'value', '')
    ELSE named_struct(
      'kind', lower(trim(split_part(split_part(raw, '#', 1), ':', 1))),
      'value', regexp_replace({_decoded("trim(regexp_extract(split_part(raw, '#', 1), '^[^:]*:(.*)$', 1))")}, '[?]$', ''))
  END)
"""


def robots_policies(robots_txt: DataFrame) -> DataFrame:
    """(domain, status, body) -> (domain, access, rules): one row per domain.

    ``access`` is 'all', 'none' or 'rules'.  No status means the file could not
    be fetched: open.  401/403 close a site, other 4xx open it, 5xx close it.
    Only the first group for agent ``*`` counts.  Of several rows of a domain the one
    with the largest ``fetched_at`` (without that column: status and body) is taken.
    """
    # Several fetches of one domain: the latest, if they carry their time.
    latest = F.struct(*[c for c in ("fetched_at", "status", "body") if c in robots_txt.columns])
    robots_txt = robots_txt.groupBy("domain").agg(F.max(latest).alias("_last")).select("domain", "_last.*")
    status = F.col("status")
    access = (
        F.when(status.isNull(), "all")
        .when(status.isin(401, 403) | (status >= 500), "none")
        .when(status >= 400, "all")
        .otherwise("rules")
    )
    return (
        robots_txt.withColumn("lines", F.expr(_LINES))
        .select("domain", access.alias("access"), F.expr(_FOLD).alias("rules"))
        .withColumn("rules", F.when(F.col("access") == "rules", F.col("rules")))
    )


def robots_rules(robots_txt: DataFrame) -> DataFrame:
    """Flat form of the rules that count: domain, seq, allow, path."""
    return (
        robots_policies(robots_txt)
        .select("domain", F.posexplode("rules").alias("seq", "rule"))
        .select("domain", F.col("seq").cast("bigint").alias("seq"), "rule.allow", "rule.path")
    )


def mark_robots(frontier: DataFrame, policies: DataFrame) -> DataFrame:
    """Adds ``robots_allowed`` to a frontier with ``domain`` and ``url``.

    One equi-join on domain; the first rule in file order whose path is a prefix
    decides, found inside the row, so no rule rows multiply the frontier.
    """
    target = f"coalesce(nullif(regexp_replace({_decoded('url')}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), ''), '/')"
    verdict = (
        "CASE access WHEN 'none' THEN false WHEN 'rules' THEN "
        "coalesce(get(filter(rules, r -> startswith(_target, r.path)), 0).allow, true) "
        "ELSE true END"
    )
    return (
        frontier.join(policies, "domain", "left")
        .withColumn("_target", F.expr(target))
        .withColumn("robots_allowed", F.expr(verdict))
        .select(*frontier.columns, "robots_allowed")
    )


def robots_filter(frontier: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(allowed, blocked) rows; a blocked one is a failure with its message."""
    marked = mark_robots(frontier, policies)
    allowed = marked.where("robots_allowed").drop("robots_allowed")
    blocked = marked.where("NOT robots_allowed").drop("robots_allowed").select(
        "*", F.lit(False).alias("success"), F.lit(BLOCKED_MESSAGE).alias("error")
    )
    return allowed, blocked
