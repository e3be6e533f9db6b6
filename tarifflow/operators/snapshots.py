"""From payloads to cleaned, capped, hashed snapshots and their history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.html import with_html_text
from ..sources.payloads import normalize_payload, page_fields
from .ordered import SPLIT_ROWS, OrderedScan
from .skew import last_per


def clean_payloads(
    payloads: DataFrame, max_chars: int = text.MAX_CONTENT_CHARS, any_html: bool = True
) -> DataFrame:
    """One attempt per payload row, everything computed inside the row.

    Input: attempt_id, provider, url, scraped_at, formats ARRAY<STRING>, body
    (JSON text), raised.  Output: the attempt's fields plus ``parts``, one struct
    per requested format in request order, and the hash over all of them.  No
    shuffle: the formats of an attempt never leave its row.

    ``any_html=False`` keeps all pages on the native HTML chain, for sources known
    to be plain; by default pages it cannot read exactly go to a parser.
    """
    shaped = page_fields(normalize_payload(payloads))
    # Two nested transforms bind the cleaned text once; cap and lengths reuse it.
    parts = f"""
        transform(
          transform(formats, f -> named_struct('format', f, 'cleaned',
            IF(f = 'html', _page_text, {text.normalize_ws_sql("coalesce(_texts[f], '')")}))),
          p -> named_struct('format', p.format, 'stored', {text.truncate_guard_sql("p.cleaned", max_chars)}))
    """
    flat = """
        transform(_parts, (p, i) -> named_struct('pos', i, 'format', p.format, 'content', p.stored.content,
          'was_truncated', p.stored.was_truncated, 'original_length', p.stored.original_length,
          'text_hash', sha2(p.stored.content, 256)))
    """
    lengths = "map_from_entries(array_distinct(transform(parts, p -> struct(p.format, length(p.content)))))"
    per_success = {
        "parts": flat,
        # Not from ``parts``: a hash alone needs none of the texts' own hashes.
        "content_hash": "sha2(array_join(transform(_parts, p -> p.stored.content), ''), 256)",
        "content_lengths": lengths,
        "truncated_formats": "transform(filter(parts, p -> p.was_truncated), p -> p.format)",
        "truncated": "size(truncated_formats) > 0",
    }
    pages = (
        shaped.withColumn("domain", text.url_domain("url"))
        .withColumn("_texts", F.expr("try_variant_get(payload, '$', 'map<string, string>')"))
        .withColumn("_html", F.expr("IF(success AND array_contains(formats, 'html'), _texts['html'], NULL)"))
    )
    if any_html:
        pages = with_html_text(pages, "_html", "_page_text")
    else:
        pages = pages.withColumn("_page_text", text.html_to_text("_html"))
    out = (
        pages.withColumn("_page_text", F.coalesce(text.normalize_ws("_page_text"), F.lit("")))
        .withColumn("_parts", F.expr(f"CASE WHEN success THEN {parts} END"))
    )
    for name, sql in per_success.items():
        out = out.withColumn(name, F.expr(f"CASE WHEN success THEN {sql} END"))
    for name in ("title", "description"):
        out = out.withColumn(name, F.expr(f"CASE WHEN success THEN {name} END"))
    return out.drop("_texts", "_html", "_page_text", "_parts", "payload")


def build_snapshots(attempts: DataFrame, stored: bool = False) -> DataFrame:
    """One row per (attempt, format) that was stored; a failed attempt has none.

    ``stored`` says that ``attempts`` is read back from a table: then only the
    nested fields that are used later are read from it.  On attempts that are
    still being computed the optimizer would derive a size filter from that form
    and push it below the cleaning, which would run twice; ``coalesce`` stops it.
    """
    parts = "parts" if stored else "coalesce(parts, filter(parts, p -> false))"
    exploded = attempts.select("attempt_id", "provider", "scraped_at", "content_hash", F.explode(F.expr(parts)).alias("_p"))
    fields = ("pos", "format", "content", "was_truncated", "original_length", "text_hash")
    return exploded.select(
        "attempt_id", "provider", "scraped_at", *[F.col(f"_p.{f}").alias(f) for f in fields],
        F.col("content_hash").alias("scrape_hash"), F.length("_p.content").alias("content_length"),
    )


def content_changed(
    attempts: DataFrame, split_rows: int = SPLIT_ROWS, extra: Sequence[str] = (), keys: Sequence[str] = ("provider",), cold: bool = False
) -> DataFrame:
    """Flags per attempt: compared with the provider's previous *attempt*, which
    has no hash if it failed, so a failure in between hides a change.

    Works on narrow columns only: attempt_id, provider, scraped_at, success,
    content_hash, and those of ``extra``.  ``keys``: of which rows the previous one is taken.
    """
    narrow = attempts.select("attempt_id", "provider", "scraped_at", "success", "content_hash", *extra)
    scan = OrderedScan(narrow, keys, ["scraped_at", "attempt_id"], split_rows=split_rows, cold=cold).lag(
        "_before", "content_hash", "scraped_at"
    )
    changed = F.coalesce(F.col("success") & (F.col("_before.content_hash") != F.col("content_hash")), F.lit(False))
    return (
        scan.frame()
        .withColumn("content_changed", changed)
        .withColumn("previous_scraped_at", F.when(F.col("content_changed"), F.col("_before.scraped_at")))
        .withColumn("previous_content_hash", F.when(F.col("content_changed"), F.col("_before.content_hash")))
        .drop("_before")
    )


def prior_snapshot(
    snapshots: DataFrame, split_rows: int = SPLIT_ROWS, extra: Sequence[str] = (), cold: bool = False
) -> DataFrame:
    """For each stored text the previous *stored* text of its (provider, format),
    even if equal: attempt_id, provider, format, scraped_at, text_hash,
    prior_attempt_id, prior_text_hash, and the columns of ``extra``.  Texts themselves stay
    where they are.
    """
    narrow = snapshots.select("attempt_id", "provider", "format", "scraped_at", "text_hash", *extra)
    scan = OrderedScan(narrow, ["provider", "format"], ["scraped_at", "attempt_id"], split_rows=split_rows, cold=cold).lag(
        "_before", "attempt_id", "text_hash"
    )
    return (
        scan.frame()
        .withColumn("prior_attempt_id", F.col("_before.attempt_id"))
        .withColumn("prior_text_hash", F.col("_before.text_hash"))
        .drop("_before")
    )


def prior_of_parts(attempts: DataFrame, split_rows: int = SPLIT_ROWS, extra: Sequence[str] = ()) -> DataFrame:
    """``prior_snapshot`` of the snapshots in ``attempts``: attempt_id, provider,
    scraped_at, ``parts`` with format, text_hash and the fields of ``extra``.

    Rows go to their provider as whole attempts; formats are told apart there.  A hot
    provider makes the formats separate keys first, so that each is cut into chunks.
    """
    rows = attempts.where("parts IS NOT NULL").select("attempt_id", "provider", "scraped_at", "parts")
    cold = OrderedScan(rows, ["provider"], ["scraped_at", "attempt_id"], split_rows=split_rows).hot is None
    dealt = rows.repartition("provider") if cold else rows
    apart = dealt.select("attempt_id", "provider", "scraped_at", F.explode("parts").alias("_p"))
    apart = apart.select("attempt_id", "provider", "scraped_at", *[F.col(f"_p.{c}").alias(c) for c in ("format", "text_hash", *extra)])
    return prior_snapshot(apart, split_rows, extra, cold)


def snapshot_pairs(
    snapshots: DataFrame, only: DataFrame | None = None, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """Pairs of current and prior text that differ: attempt_id, provider, format,
    scraped_at, content, prior_content.  ``only`` (attempt_id) restricts them.

    Equal texts have no diff, so they are dropped on their hashes before any text
    moves; both text joins are on unique (attempt, format) keys.
    """
    history = prior_snapshot(snapshots, split_rows)
    differing = history.where("prior_attempt_id IS NOT NULL AND text_hash <> prior_text_hash").select(
        "attempt_id", "provider", "format", "scraped_at", "prior_attempt_id"
    )
    if only is not None:
        differing = differing.join(only.select("attempt_id"), "attempt_id", "left_semi")
    current = snapshots.select("attempt_id", "format", "content")
    prior = snapshots.select(
        F.col("attempt_id").alias("prior_attempt_id"), "format", F.col("content").alias("prior_content")
    )
    return (
        differing.join(current, ["attempt_id", "format"])
        .join(prior, ["prior_attempt_id", "format"])
        .select("attempt_id", "provider", "format", "scraped_at", "content", "prior_content")
    )


def latest_per_provider(attempts: DataFrame) -> DataFrame:
    return last_per(attempts, ["provider"], ["scraped_at", "attempt_id"])


def upsert_metadata(entries: DataFrame, attempts: DataFrame) -> DataFrame:
    """The last attempt replaces a provider's whole entry; the place in the
    stored order (``ord``) is that of its first appearance."""
    both = entries.unionByName(attempts)
    newest = last_per(both, ["provider"], ["scraped_at", "ord"])
    places = both.groupBy("provider").agg(F.min("ord").alias("ord"))
    return newest.drop("ord").join(places, "provider")


def successful(entries: DataFrame) -> DataFrame:
    return entries.where("success")
