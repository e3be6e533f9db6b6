"""Queries over stored price plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import last_per

# --- fixed values -----------------------------------------------------------
PLAN_LINE = "  • %s: %s - Input Token $%s, Output Tokens $%s"
RECENT_COLUMNS = ("company_name", "plan_name", "input_tokens", "output_tokens", "currency")
RECENT_ROWS = 5
NULL_WORD = "None"
# --- end of fixed values ----------------------------------------------------


def store_summary(answers: DataFrame, plans: DataFrame) -> DataFrame:
    """Number of plans stored per answer, zero included."""
    counts = plans.groupBy("answer_id").agg(F.count(F.lit(1)).alias("n"))
    return answers.select("answer_id").join(counts, "answer_id", "left").select(
        "answer_id", F.coalesce("n", F.lit(0)).alias("stored_plans")
    )


def latest_plans(plans: DataFrame) -> DataFrame:
    """Newest row per (company, plan): the table is append-only and may repeat."""
    return last_per(plans, ["company_name", "plan_name"], ["created_at", "id"])


def compare_providers(plans: DataFrame, companies: DataFrame, model: str) -> DataFrame:
    """Latest input and output price of the chosen companies for one plan name.
    A company without it stays, with null prices and ``offered`` false."""
    offers = latest_plans(plans.where(F.col("plan_name") == model)).select(
        "company_name", "input_tokens", "output_tokens", "currency"
    )
    return companies.select("company_name").join(offers, "company_name", "left").withColumn(
        "offered", F.col("input_tokens").isNotNull() | F.col("output_tokens").isNotNull()
    )


def price_matrix(plans: DataFrame, companies: Sequence[str]) -> DataFrame:
    """Side by side: one row per plan, one input and output price column per
    company.  The companies are given, so the pivot needs no extra pass."""
    return (
        latest_plans(plans.where(F.col("company_name").isin(list(companies))))
        .groupBy("plan_name")
        .pivot("company_name", list(companies))
        .agg(F.max("input_tokens").alias("input"), F.max("output_tokens").alias("output"))
    )


def cheapest_plans(plans: DataFrame, by: str = "input_tokens", family: str = "plan_family") -> DataFrame:
    """Per model family the lowest and highest price and the cheapest plan."""
    priced = plans.where(F.col(by).isNotNull())
    return priced.groupBy(family).agg(
        F.min(by).alias("lowest"),
        F.max(by).alias("highest"),
        F.min_by("plan_name", F.struct(by, "plan_name", "company_name", "id")).alias("cheapest_plan"),
        F.min_by("company_name", F.struct(by, "plan_name", "company_name", "id")).alias("cheapest_company"),
    )


def recent_plans(plans: DataFrame, n: int = RECENT_ROWS) -> DataFrame:
    """The newest rows; rows of the same second keep insertion order."""
    return plans.orderBy(F.col("created_at").desc(), F.col("id").asc()).limit(n).select(*RECENT_COLUMNS)


def format_plans(plans: DataFrame) -> DataFrame:
    return plans.select(
        F.format_string(
            PLAN_LINE,
            F.col("company_name"),
            F.col("plan_name"),
            F.coalesce(F.col("input_tokens").cast("string"), F.lit(NULL_WORD)),
            F.coalesce(F.col("output_tokens").cast("string"), F.lit(NULL_WORD)),
        ).alias("line")
    )
