"""URL verdicts by rules and by a list of canonical URLs, in DataFrame operations only.

The list is put into a blocked Bloom filter of fixed size, which every task tests
row by row.  Only possible hits go to an exact hash join with the list, which
removes the false ones; all other rows are never shuffled.

Defined cases: a null url, or one without ``://``, has empty host and path and is
allowed.  Rules of equal length: the longer host goes first, then ``block``.
Other columns are carried along; those named as the results are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bloom_hits, bloom_of, clashing, skew_join, stage

# (verdict, host, path): the production rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
# Hosts with one of these labels feed the production list.
SPAM_LABELS = ("spam-farm", "cheap-pills", "casino-win")
RESULTS = ("host", "path", "rule", "verdict")
MAX_RULES = 1000


def _rest(url: str) -> Column:
    u = F.col(url)
    return F.coalesce(F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")), F.lit(""))


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host``, ``path`` and ``canonical`` (host without ``www.``, path without
    closing slashes, query without ``utm_`` parameters)."""
    df = df.withColumn("_rest", _rest(url)).withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    df = df.withColumn("_tail", F.expr("substring(_rest, length(_host) + 1)")).withColumn("path", F.regexp_extract("_tail", r"^[^?#]*", 0))
    query = F.regexp_replace(F.regexp_extract("_tail", r"^[^?#]*\?([^#]*)", 1), r"(^|&)utm_[^&]*", "")
    query = F.regexp_replace(query, r"^&+", "")
    host = ascii_lower(F.col("_host"))
    canonical = F.concat(
        F.regexp_replace(host, r"^www\.", ""), F.regexp_replace("path", r"/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )
    return df.withColumns({"host": host, "canonical": canonical}).drop("_rest", "_host", "_tail")


def _fits(host: str, path: str) -> Column:
    h = F.col("host")
    return ((h == host) | h.endswith(f".{host}")) & F.col("path").startswith(path)


def by_rules(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; put whole URLs into the list instead")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[0] == "block")):
        rule = F.when(_fits(host, path), F.lit(host + path)).otherwise(rule)
        verdict = F.when(_fits(host, path), F.lit(what)).otherwise(verdict)
    return rule, verdict


def spam_list(pages: DataFrame, labels: Sequence[str] = SPAM_LABELS, url: str = "url") -> DataFrame:
    """Canonical URLs of all pages whose host has one of these labels."""
    parts = with_parts(pages.select(url), url)
    return parts.where(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels)))).select("canonical")


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, *, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``listed`` has a string column ``canonical``; repeated and null entries do no harm.
    """
    listed = stage(listed.select("canonical").where("canonical is not null").distinct())
    pages = clashing(pages, (*RESULTS, "canonical"))
    rule, verdict = by_rules(rules)
    pages = with_parts(pages, url).withColumns({"rule": rule, "_ruled": verdict})
    pages = bloom_hits(pages, [F.col("canonical")], stage(bloom_of(listed)), "_maybe")
    maybe = F.col("_ruled").isNull() & F.col("_maybe")
    # Exact join on one row per distinct URL, then back to the rows that share it.
    found = stage(pages.where(maybe).groupBy("canonical").agg(F.count(F.lit(1)).alias("_hits")).join(listed, "canonical"))
    rows = found.agg(F.sum("_hits")).first()[0] or 0
    hits = skew_join(pages.where(maybe), found, "canonical", "_hits", rows, F.col(id_col))
    hits = hits.withColumn("verdict", F.when(F.col("_hits").isNotNull(), "block").otherwise("allow")).drop("_hits")
    rest = pages.where(~maybe).withColumn("verdict", F.coalesce("_ruled", F.lit("allow")))
    return rest.unionByName(hits).drop("_ruled", "_maybe", "canonical")
