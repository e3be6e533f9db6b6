"""Queries over conversations, tool results and stage traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import logs as lg
from . import oracle_parts as O
from .derived import result_log, table, tool_results, trace_lines
from .registry import query


@query(
    "assemble_answers",
    f"""WITH joined AS (
      SELECT conv_id, {O.strip("string_agg(text, chr(10) ORDER BY turn)")} AS answer
      FROM conversations WHERE role = 'assistant' GROUP BY 1)
    SELECT conv_id, 0::BIGINT AS part, answer FROM joined WHERE answer <> ''""",
)
def assemble_answers(spark, sf_dir):
    return lg.assemble_answers(table(spark, sf_dir, "conversations"))


@query(
    "last_source_url",
    """SELECT page_id // 5 AS conv_id, arg_max(url, page_id) AS source_url
    FROM pages WHERE url LIKE 'https%' GROUP BY 1""",
)
def last_source_url(spark, sf_dir):
    return lg.last_source_url(tool_results(spark, sf_dir))


def _trace(spark, sf_dir):
    return lg.parse_trace(trace_lines(spark, sf_dir))


@query("parse_trace", f"WITH {O.TRACE} SELECT seq, ts, time, stage, message FROM trace")
def parse_trace(spark, sf_dir):
    return _trace(spark, sf_dir)


_GAPS = f"""WITH {O.TRACE},
    gaps AS (SELECT *, date_diff('microsecond', ts, lead(ts) OVER (ORDER BY ts, seq)) AS gap_us FROM trace)"""


@query("stage_gaps", f"{_GAPS} SELECT seq, stage, gap_us FROM gaps")
def stage_gaps(spark, sf_dir):
    return lg.stage_gaps(_trace(spark, sf_dir)).select("seq", "stage", "gap_us")


@query(
    "stage_stats",
    f"""{_GAPS} SELECT stage, count(*) AS events, sum(gap_us)::BIGINT AS total_gap_us, max(gap_us) AS longest_gap_us
    FROM gaps GROUP BY 1""",
)
def stage_stats(spark, sf_dir):
    return lg.stage_stats(lg.stage_gaps(_trace(spark, sf_dir)))


@query(
    "tool_error_share",
    f"""WITH {O.TRACE}, n AS (SELECT count_if(stage IN ('TOOL_RESULT', 'TOOL_ERROR'))::BIGINT AS tool_outcomes,
      count_if(stage = 'TOOL_ERROR')::BIGINT AS tool_errors FROM trace)
    SELECT *, tool_errors * 10000 // tool_outcomes AS error_bp FROM n""",
)
def tool_error_share(spark, sf_dir):
    return lg.tool_error_share(_trace(spark, sf_dir))


@query(
    "parse_result_log",
    f"""SELECT {O.ATTEMPT_ID} AS log_id, 0::BIGINT AS pos, 'Supplier-' || l_suppkey AS company_name,
      'Part-' || l_partkey AS plan_name, round(l_extendedprice * 100)::BIGINT AS input_cents,
      CASE WHEN l_returnflag <> 'R' THEN round(l_extendedprice * 100)::BIGINT END AS output_cents, 'USD' AS currency,
      5::BIGINT AS n_cells, 'USD' AS currency_cell
    FROM lineitem WHERE l_quantity > 2""",
)
def parse_result_log(spark, sf_dir):
    parsed = lg.parse_result_log(result_log(spark, sf_dir))
    both = F.posexplode(F.arrays_zip("rows", "cells")).alias("pos", "b")
    return parsed.select("log_id", both).select("log_id", "pos", F.col("b.rows").alias("r"), F.col("b.cells").alias("cells")).select(
        "log_id",
        F.col("pos").cast("bigint").alias("pos"),
        "r.company_name",
        "r.plan_name",
        F.expr("CAST(round(r.input_tokens * 100) AS BIGINT)").alias("input_cents"),
        F.expr("CAST(round(r.output_tokens * 100) AS BIGINT)").alias("output_cents"),
        "r.currency",
        F.size("cells").cast("bigint").alias("n_cells"),
        F.expr("cells['currency']").alias("currency_cell"),
    )
