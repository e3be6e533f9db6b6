"""Finding a provider by name, URL or domain, and reading what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .ordered import BROADCAST_ROWS, stage

# --- fixed values -----------------------------------------------------------
NOT_FOUND = "There's no saved information related to identifier '%s'."
# --- end of fixed values ----------------------------------------------------


def provider_keys(metadata: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Every identifier with the one provider it stands for: the first entry in
    stored order.  Unique on ``identifier``, so joins on it never multiply, and
    shared domains are folded on the map side.  With ``asked`` only those identifiers."""
    keys = (
        metadata.select(
            "ord",
            "provider_name",
            F.explode(F.array("provider_name", F.coalesce("url", F.lit("")), F.coalesce("domain", F.lit("")))).alias(
                "identifier"
            ),
        )
    )
    if asked is not None:
        keys = keys.join(few(asked.select("identifier").distinct()), "identifier", "left_semi")
    return keys.groupBy("identifier").agg(F.min_by("provider_name", "ord").alias("provider"))


def few(keys: DataFrame) -> DataFrame:
    """``keys``, counted, and marked for broadcast if they are few."""
    keys = stage(keys)
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def resolve_provider(identifiers: DataFrame, metadata: DataFrame) -> DataFrame:
    """identifier -> provider, or null with ``message``.  Three equalities joined
    by OR become one hash equi-join on exploded keys."""
    joined = identifiers.join(provider_keys(metadata, identifiers), "identifier", "left")
    return joined.withColumn(
        "message", F.when(F.col("provider").isNull(), F.format_string(NOT_FOUND, F.col("identifier")))
    )


def extract_info(
    identifiers: DataFrame, metadata: DataFrame, content: DataFrame, max_chars: int = text.MAX_CONTENT_CHARS
) -> DataFrame:
    """Stored information per (identifier, format): the metadata entry and the
    text, capped again on reading.  ``content``: provider, format, content.

    A text that was capped when stored carries its note and is longer than the
    cap, so it is cut once more and ``original_length`` is the stored length.
    """
    # Resolve first: texts and entries nobody asked for are dropped where they are read.
    resolved = stage(resolve_provider(identifiers, metadata))
    wanted = few(resolved.select("provider").where("provider IS NOT NULL").distinct())
    entries = metadata.drop("ord").withColumnRenamed("provider_name", "provider").join(wanted, "provider", "left_semi")
    read = content.join(wanted, "provider", "left_semi").select(
        "provider", "format", F.expr(text.read_text_sql("coalesce(content, '')")).alias("_text")
    ).withColumn("_read", text.truncate_guard("_text", max_chars))
    texts = read.select(
        "provider",
        "format",
        F.col("_read.content").alias("content"),
        F.when(F.col("_read.was_truncated"), F.col("_read.original_length")).alias("original_length"),
        F.when(F.col("_read.was_truncated"), F.length("_read.content")).alias("returned_length"),
    )
    return resolved.join(entries, "provider", "left").join(texts, "provider", "left")
