"""Ad-hoc SQL over registered tables."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.register import register


def open_tables(spark: SparkSession, tables: Mapping[str, DataFrame]) -> None:
    """Register DataFrames as views and the text functions beside them."""
    register(spark)
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


class NotAQuery(ValueError):
    """The statement would do more than read."""


# Parts of a query that run code outside Spark.
_OUTSIDE = re.compile(r"ScriptTransformation|\b(?:try_)?(?:reflect|java_method)\(")


def sql(spark: SparkSession, query: str, **args) -> DataFrame:
    """Run a query that reads; values enter by named markers (``:name``), never by pasting,
    so quotes in them cannot break the statement.

    The text becomes a subquery, where the grammar allows queries only: statements that
    create, change or drop anything, set options or run several commands are refused with
    :class:`NotAQuery` before anything is run, and so are scripts and reflection.
    """
    inner = query.strip().removesuffix(";")
    try:
        # The line end closes a comment at the end of the text.
        result = spark.sql(f"SELECT * FROM (\n{inner}\n)", args=args or None)
    except ParseException as problem:
        raise NotAQuery(f"not a single query: {query.strip()[:200]}") from problem
    if _OUTSIDE.search(result._jdf.queryExecution().analyzed().toString()):
        raise NotAQuery("scripts and reflection are not allowed")
    return result
