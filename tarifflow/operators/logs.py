"""Conversation tables, SQL-result logs and stage traces."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import text
from ..schemas import RESULT_ROWS, ROW_CELLS
from .ordered import SPLIT_ROWS, OrderedScan

# --- fixed values -----------------------------------------------------------
STAGES = ("THINKING", "TOOL_CALL", "TOOL_RESULT", "TOOL_ERROR", "DB", "ANSWER")
TRACE_PATTERN = r"^  \[(\d{2}:\d{2}:\d{2})\] (\S+) ([A-Z_]+)\s+(.*)$"
SQL_SERVER = "sqlite"
# --- end of fixed values ----------------------------------------------------

# An answer is one string, and a string cell ends at 2 GB: a conversation with
# more text than this is returned in several consecutive parts.
PART_CHARS = 50_000_000


def assemble_answers(
    conversations: DataFrame, part_chars: int = PART_CHARS, split_rows: int = SPLIT_ROWS
) -> DataFrame:
    """All assistant texts of a conversation, each on its own line, in turn order
    and stripped: conv_id, part (0 but for huge conversations), answer.  Empty
    answers are dropped.  No group ever holds more than one part; the parts of a
    conversation, put together by line ends, are the whole answer."""
    said = conversations.where("role = 'assistant'").select("conv_id", "turn", "text")
    parts = (
        OrderedScan(said, ["conv_id"], ["turn"], split_rows=split_rows)
        .running_sum("_chars", F.length("text").cast("bigint") + 1)
        .frame()
        .withColumn("part", F.expr(f"(_chars - length(text) - 1) DIV {int(part_chars)}"))
    )
    joined = parts.groupBy("conv_id", "part").agg(F.expr("listagg(text, '\\n') WITHIN GROUP (ORDER BY turn)").alias("answer"))
    # Blanks go at the ends of the whole answer, not at the borders of its parts.
    conversation = Window.partitionBy("conv_id")
    said_in = F.when(text.strip("answer") != "", F.col("part"))
    joined = joined.withColumn("_first", F.min(said_in).over(conversation)).withColumn("_last", F.max(said_in).over(conversation))
    joined = joined.where("part BETWEEN _first AND _last")
    answer = F.when(F.col("part") == F.col("_first"), text.lstrip("answer")).otherwise(F.col("answer"))
    joined = joined.withColumn("answer", answer)
    answer = F.when(F.col("part") == F.col("_last"), text.rstrip("answer")).otherwise(F.col("answer"))
    return joined.withColumn("answer", answer).drop("_first", "_last")


def last_source_url(tool_results: DataFrame) -> DataFrame:
    """Per conversation the first URL of the last tool result that holds one;
    results of the SQL tools do not count.  Input: conv_id, seq, server, text."""
    return (
        tool_results.where(F.lower("server") != SQL_SERVER)
        .withColumn("url", text.first_url("text"))
        .where("url IS NOT NULL")
        .groupBy("conv_id")
        .agg(F.max_by("url", "seq").alias("source_url"))
    )


def parse_trace(lines: DataFrame, column: str = "value") -> DataFrame:
    """Trace lines to (time, stage, message); other lines, such as further lines
    of a long message, are dropped."""
    part = lambda i: F.regexp_extract(column, TRACE_PATTERN, i)
    rest = [c for c in lines.columns if c != column]
    return (
        lines.where(F.col(column).rlike(TRACE_PATTERN))
        .select(*rest, part(1).alias("time"), part(3).alias("stage"), part(4).alias("message"))
        .where(F.col("stage").isin(*STAGES))
    )


def stage_gaps(trace: DataFrame, order: str = "seq", split_rows: int = SPLIT_ROWS) -> DataFrame:
    """Adds ``gap_us``, the time to the next event of the whole trace (null on the
    last).  A global order, so a long trace is scanned in chunks."""
    scan = OrderedScan(trace, [], ["ts", order], descending=True, split_rows=split_rows).lag("_next", "ts")
    gap = f"timestampdiff(MICROSECOND, ts, _next.ts)"
    return scan.frame().withColumn("gap_us", F.expr(gap)).drop("_next")


def stage_stats(gapped: DataFrame) -> DataFrame:
    """Per stage: events, share of errors among tool outcomes is left to the
    caller as two counts, and total and longest gap to the next event."""
    return gapped.groupBy("stage").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum("gap_us").alias("total_gap_us"),
        F.max("gap_us").alias("longest_gap_us"),
    )


def tool_error_share(trace: DataFrame) -> DataFrame:
    """Tool outcomes, errors among them, and the share in basis points."""
    counts = trace.agg(
        F.count_if(F.col("stage").isin("TOOL_RESULT", "TOOL_ERROR")).alias("tool_outcomes"),
        F.count_if(F.col("stage") == "TOOL_ERROR").alias("tool_errors"),
    )
    return counts.withColumn("error_bp", F.expr("tool_errors * 10000 DIV nullif(tool_outcomes, 0)"))


# --- logged SQL results -------------------------------------------------------


def parse_result_log(log: DataFrame, column: str = "result_text", schema: str = RESULT_ROWS) -> DataFrame:
    """Adds ``rows``, the logged result as an array of structs of ``schema``, and
    ``cells``, the same rows with every column of the result as text.

    JSON, and the single-quoted form as far as a JSON reader accepts it, is read
    natively.  Only texts with literals JSON lacks (None, True, escapes of the
    other quote) are handed to the Python literal reader, which gives JSON back.
    """
    as_json = F.expr(f"try_parse_json({column})").isNotNull()
    foreign = F.from_json(column, ROW_CELLS).isNull() | F.col(column).rlike(r"\b(?:None|True|False)\b|\\")
    unsafe = F.coalesce(foreign & ~as_json, F.lit(False))
    blank = F.trim(column) == ""
    read = log.withColumn("_literal", _literal_json(F.when(unsafe & ~blank, F.col(column))))
    read = read.withColumn("_json", F.when(blank, "[]").when(unsafe, F.col("_literal")).otherwise(F.col(column)))
    return read.withColumns({"rows": F.from_json("_json", schema), "cells": F.from_json("_json", ROW_CELLS)}).drop("_literal", "_json")


@F.pandas_udf(StringType())
def _literal_json(values: pd.Series) -> pd.Series:
    """JSON text of each Python literal that is a list of dicts; null for any other."""

    def read(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            rows = ast.literal_eval(value)
            return json.dumps(rows) if isinstance(rows, list) and all(isinstance(r, dict) for r in rows) else None
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            return None

    return values.map(read, na_action="ignore")
