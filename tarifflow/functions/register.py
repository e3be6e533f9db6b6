"""Expose the scalar functions to SQL.

Each one becomes a temporary SQL function whose body is a plain expression, so
Catalyst inlines it: filters still push down and code generation still applies.
``html_to_text`` and ``clean_content`` are the native chain, for plain pages; for
arbitrary ones there is ``page_text``, the parser as a vectorized function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import text
from .html import page_text

# name -> (parameters, return type, body)
SQL_FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "url_domain": ("url STRING", "STRING", text.url_domain_sql("url")),
    "html_to_text": ("html STRING", "STRING", text.html_to_text_sql("html")),
    "normalize_ws": ("t STRING", "STRING", text.normalize_ws_sql("t")),
    "clean_content": ("raw STRING, fmt STRING", "STRING", text.clean_content_sql("raw", "fmt")),
    "truncate_guard": (
        "t STRING, max_chars INT",
        "STRUCT<content: STRING, was_truncated: BOOLEAN, original_length: INT>",
        text.truncate_guard_sql("t", "max_chars"),
    ),
    "content_hash": ("t STRING", "STRING", text.content_hash_sql("t")),
    "is_fresh": (
        "scraped_at STRING, as_of STRING, ttl_hours INT",
        "BOOLEAN",
        text.is_fresh_sql("scraped_at", "as_of", "ttl_hours"),
    ),
    "is_price_like": ("line STRING", "BOOLEAN", text.is_price_like_sql("line")),
    "first_url": ("t STRING", "STRING", text.first_url_sql("t")),
    "clip_line": ("line STRING, max_chars INT", "STRING", text.clip_line_sql("line", "max_chars")),
    "price_tokens": ("t STRING", "ARRAY<STRING>", text.price_tokens_sql("t")),
}


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the temporary SQL functions; returns their names."""
    for name, (params, returns, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {returns} RETURN {body}")
    spark.udf.register("page_text", page_text)
    return [*SQL_FUNCTIONS, "page_text"]
