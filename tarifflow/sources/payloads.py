"""Scrape payloads: loading and bringing both payload shapes to one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import last_key_wins

# --- fixed values -----------------------------------------------------------
UNKNOWN_ERROR = "Unknown error"
# Values that count as false when a payload carries an explicit success flag.
FALSY_JSON = ("false", "null", "0", "0.0", '""', "[]", "{}")
# --- end of fixed values ----------------------------------------------------


def load_pages(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Payload or page tables; give ``schema`` for JSON so that nothing is inferred."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def normalize_payload(df: DataFrame, body: str = "body", raised: str = "raised") -> DataFrame:
    """Adds ``payload`` (VARIANT), ``success`` and ``error``.

    A raised exception fails the attempt.  Otherwise an explicit ``success`` key
    decides by its truth value, and a payload without that key succeeded.  Of a
    repeated key the last value counts.
    """
    last_key_wins(df.sparkSession)
    falsy = ", ".join(f"'{v}'" for v in FALSY_JSON)
    flag = "coalesce(to_json(variant_get(payload, '$.success')), 'true')"
    success = (
        f"CASE WHEN {raised} IS NOT NULL OR payload IS NULL THEN false "
        f"ELSE {flag} NOT IN ({falsy}) END"
    )
    error = (
        f"CASE WHEN {raised} IS NOT NULL THEN {raised} WHEN success THEN NULL "
        f"WHEN variant_get(payload, '$.error') IS NULL THEN '{UNKNOWN_ERROR}' "
        "ELSE variant_get(payload, '$.error', 'string') END"
    )
    return (
        df.withColumn("payload", F.expr(f"try_parse_json({body})"))
        .withColumn("success", F.expr(success))
        .withColumn("error", F.expr(error))
    )


def page_fields(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds ``title`` and ``description``: the nested value wherever its key
    exists, even as null; else the top-level one; else empty."""

    def field(name: str):
        nested = f"variant_get({payload}, '$.metadata.{name}')"
        return F.expr(
            f"CASE WHEN {nested} IS NOT NULL THEN variant_get({payload}, '$.metadata.{name}', 'string') "
            f"ELSE coalesce(variant_get({payload}, '$.{name}', 'string'), '') END"
        )

    return df.withColumn("title", field("title")).withColumn("description", field("description"))
