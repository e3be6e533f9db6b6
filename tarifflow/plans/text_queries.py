"""Queries for the scalar functions, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.html import with_clean_content, with_html_text
from . import oracle_parts as O
from .derived import price_payloads, table
from .registry import query
from ..operators.snapshots import build_snapshots, clean_payloads

CAP = 1000
NOW = "2024-01-15 12:00:00"


@query("url_domain", f"SELECT page_id, {O.domain('url')} AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.url_domain("url").alias("domain"))


@query("load_pages", f"SELECT {O.domain('url')} AS domain, count(*) AS pages, sum(length(html))::BIGINT AS html_chars FROM pages GROUP BY 1")
def load_pages(spark, sf_dir):
    from ..sources.payloads import load_pages as load

    pages = load(spark, f"{sf_dir}/pages.parquet")
    return pages.groupBy(text.url_domain("url").alias("domain")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("html")).alias("html_chars")
    )


@query("html_to_text", f"SELECT page_id, {O.html_text('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return with_html_text(table(spark, sf_dir, "pages"), "html", "text").select("page_id", "text")


@query(
    "page_text",
    f"SELECT page_id, sha256({O.clean_html('html')}) AS hash FROM pages WHERE contains(html, '&') OR contains(html, '<svg')",
)
def page_text(spark, sf_dir):
    """The parser as a SQL function, over pages with references or drawings."""
    from .workspace import open_tables, sql

    open_tables(spark, {"pages": table(spark, sf_dir, "pages")})
    return sql(spark, "SELECT page_id, content_hash(normalize_ws(page_text(html))) AS hash FROM pages WHERE contains(html, '&') OR contains(html, '<svg')")


@query("normalize_ws", f"SELECT doc_id, {O.normalize('text')} AS text FROM documents")
def normalize_ws(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_ws("text").alias("text"))


@query(
    "clean_content",
    f"SELECT 'page' AS kind, page_id AS id, {O.clean_html('html')} AS content FROM pages "
    f"UNION ALL SELECT 'document', doc_id, {O.normalize('text')} FROM documents",
)
def clean_content(spark, sf_dir):
    pages = with_clean_content(table(spark, sf_dir, "pages"), "html", "content")
    pages = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "content")
    docs = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.clean_content("text", "'markdown'").alias("content")
    )
    return pages.unionByName(docs)


@query(
    "truncate_guard",
    f"SELECT doc_id, {O.capped('text', CAP)} AS content, length(text) > {CAP} AS was_truncated, "
    "length(text)::BIGINT AS original_length FROM documents",
)
def truncate_guard(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", text.truncate_guard("text", CAP).alias("t"))
        .select("doc_id", "t.content", "t.was_truncated", F.col("t.original_length").cast("bigint").alias("original_length"))
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash("text").alias("content_hash"))


@query(
    "cache_freshness",
    f"SELECT event_id, date_diff('microsecond', ts, TIMESTAMP '{NOW}') < 86400000000 AS fresh FROM events",
)
def cache_freshness(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", text.is_fresh("CAST(ts AS STRING)", f"'{NOW}'").alias("fresh")
    )


@query(
    "price_like_lines",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT doc_id, count(*) AS lines, count_if({O.price_like('line')})::BIGINT AS price_lines FROM lines GROUP BY 1""",
)
def price_like_lines(spark, sf_dir):
    # Counted inside the row: no line ever leaves its document.
    return table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l")).select(
        "doc_id",
        F.size("l").cast("bigint").alias("lines"),
        F.expr(f"CAST(size(filter(l, x -> {text.is_price_like_sql('x')})) AS BIGINT)").alias("price_lines"),
    )


@query("first_url", "SELECT page_id, url || '),' AS found FROM pages")
def first_url(spark, sf_dir):
    return (
        table(spark, sf_dir, "pages")
        .selectExpr("page_id", "concat('Prices (see ', url, '), also http://x.example.org>') AS t")
        .select("page_id", text.first_url("t").alias("found"))
    )


@query(
    "clip_line",
    f"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
    SELECT doc_id, pos::BIGINT AS pos, left({O.strip('line')}, 200) AS clipped FROM lines""",
)
def clip_line(spark, sf_dir):
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("doc_id", F.col("pos").cast("bigint").alias("pos"), text.clip_line("concat('+', line)").alias("clipped"))
    )


@query(
    "price_mentions",
    f"""WITH {O.STORED},
    found AS (SELECT attempt_id, format, regexp_extract_all(content, '{O.PRICE}', 0, 'i') AS tokens FROM stored
      UNION ALL SELECT doc_id::VARCHAR, 'document', regexp_extract_all(text, '{O.PRICE}', 0, 'i') FROM documents)
    SELECT attempt_id, format, unnest(tokens) AS token, (generate_subscripts(tokens, 1) - 1)::BIGINT AS pos FROM found""",
)
def price_mentions(spark, sf_dir):
    scraped = build_snapshots(clean_payloads(price_payloads(spark, sf_dir), any_html=False)).select("attempt_id", "format", "content")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("attempt_id"), F.lit("document").alias("format"), F.col("text").alias("content")
    )
    return (
        scraped.unionByName(docs)
        .select("attempt_id", "format", F.posexplode(text.price_tokens("content")).alias("pos", "token"))
        .select("attempt_id", "format", "token", F.col("pos").cast("bigint").alias("pos"))
    )


@query("adhoc_sql", """SELECT l_returnflag AS flag, count(*) AS lines, count_if(l_discount = 0.05)::BIGINT AS discounted
    FROM lineitem GROUP BY 1""")
def adhoc_sql(spark, sf_dir):
    from .workspace import open_tables, sql

    open_tables(spark, {"lineitem": table(spark, sf_dir, "lineitem")})
    return sql(
        spark,
        "SELECT l_returnflag AS flag, count(*) AS lines, count_if(l_discount = :rate) AS discounted "
        "FROM lineitem GROUP BY 1",
        rate=0.05,
    )


@query("sql_functions", f"SELECT page_id, {O.domain('url')} AS domain, sha256({O.clean_html('html')}) AS hash FROM pages")
def sql_functions(spark, sf_dir):
    from .workspace import open_tables, sql

    open_tables(spark, {"pages": table(spark, sf_dir, "pages")})
    return sql(
        spark,
        "SELECT page_id, url_domain(url) AS domain, content_hash(clean_content(html, :fmt)) AS hash FROM pages",
        fmt="html",
    )
