"""Price-page inputs derived from the star-schema tables.

Each function maps table rows to input rows one to one (or one to few), with no
grouping, so the inputs grow with the tables and hold no oversized row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.ordered import spread
from ..streaming.jobs import read_folder


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream.  How many files a trigger finds is not known before, so its rows
    are always dealt out to all cores, as :func:`table` does for a table of few files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    rows = read_folder(spark, sf_dir, schema, glob=f"{name}.parquet")
    return rows.repartition(spark.sparkContext.defaultParallelism)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def money(cents: str) -> str:
    """Cents as text with two decimals."""
    return f"concat(({cents}) DIV 100, '.', lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"


def hundredths(x: str) -> str:
    """``round(x * 100)``, halves away from zero.  ``round`` of a double goes through its
    decimal text, which costs more than all other steps of a row's name."""
    return f"CAST(IF({x} < 0, -floor(0.5 - {x} * 100), floor({x} * 100 + 0.5)) AS BIGINT)"


# Names one line item; its first four columns alone are not unique.
LINE_ITEM_ID = (
    "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    f"{hundredths('l_extendedprice')}, replace(CAST(CAST(l_shipdate AS DATE) AS STRING), '-', ''))"
)


def page_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per web page: markdown is a heading line, html the raw page.
    Every fiftieth markdown goes beyond the default cap."""
    body = (
        "to_json(named_struct('markdown', concat('# ', url, '\\n\\n\\n\\npage\\t', page_id, ' ', "
        "repeat(concat('line ', page_id, ' '), IF(page_id % 50 = 7, 6000, 0))), 'html', html, "
        "'metadata', named_struct('title', concat('Page ', page_id))))"
    )
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("attempt_id"),
        text.url_domain("url").alias("provider"),
        "url",
        F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("scraped_at"),
        F.expr("array('markdown', 'html')").alias("formats"),
        F.expr(body).alias("body"),
        F.expr("CAST(NULL AS STRING)").alias("raised"),
    )


def price_payloads(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One scrape per line item; the provider is the part, the time its ship date.

    Covers both payload shapes and all failures: a third raise, quantity 50 and
    49 report failure with and without a message, flag A carries an explicit
    success key and flag N none.  ``lines`` may be a stream of line items.
    """
    source = table(spark, sf_dir, "lineitem") if lines is None else lines
    row = source.select(
        F.expr(LINE_ITEM_ID).alias("attempt_id"),
        F.expr("concat('part-', l_partkey)").alias("provider"),
        F.expr("concat('https://shop', l_suppkey, '.example.com/parts/', l_partkey)").alias("url"),
        F.col("l_shipdate").alias("scraped_at"),
        F.expr("array('markdown', 'html')").alias("formats"),
        F.expr(hundredths("l_extendedprice")).alias("price"),
        F.expr(hundredths("l_discount")).alias("discount"),
        F.expr(hundredths("l_tax")).alias("tax"),
        F.expr("CAST(l_quantity AS BIGINT)").alias("quantity"),
        "l_partkey",
        "l_returnflag",
        "l_linestatus",
    )
    markdown = (
        f"concat('# Part ', l_partkey, '\\nInput: $', {money('price')}, ' per 1M tokens\\n\\n\\n\\nQuantity  ', "
        f"quantity, ' units\\nDiscount\\t', {money('discount')}, '\\nStatus ', l_returnflag, l_linestatus)"
    )
    html = (
        f"concat('<div><!-- tax --><p>Tax &amp; fees <b>$', {money('tax')}, '</b></p>"
        "<script>var q=\"</p>\";</script><p>', quantity, ' left</p></div>')"
    )
    success = "CASE l_returnflag WHEN 'A' THEN true END"
    body = (
        "CASE WHEN quantity = 50 THEN '{\"success\": false, \"error\": \"timeout\"}' "
        "WHEN quantity = 49 THEN '{\"success\": 0}' "
        f"ELSE to_json(named_struct('success', {success}, 'markdown', {markdown}, 'html', {html}, "
        "'title', concat('Part ', l_partkey), 'metadata', named_struct('description', l_linestatus))) END"
    )
    return row.select(
        "attempt_id",
        "provider",
        "url",
        "scraped_at",
        "formats",
        F.expr(f"CASE WHEN l_returnflag <> 'R' THEN {body} END").alias("body"),
        F.expr("CASE WHEN l_returnflag = 'R' THEN 'site unreachable' END").alias("raised"),
    )


def document_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as stored texts of their source, in doc_id order."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("attempt_id"),
        F.col("source").alias("provider"),
        F.lit("markdown").alias("format"),
        F.expr("timestampadd(MINUTE, doc_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("scraped_at"),
        F.expr(text.clean_content_sql("text", "'markdown'")).alias("content"),
    ).withColumn("text_hash", text.content_hash("content"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One crawl request per event."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id DIV 20").alias("call_id"),
        F.expr("event_id % 20").alias("pos"),
        F.expr("concat('u', user_id)").alias("provider"),
        F.expr("concat('https://d', user_id % 20, '.example.com/', user_id % 7)").alias("url"),
        F.expr("concat('d', user_id % 20, '.example.com')").alias("domain"),
        F.col("ts").alias("requested_at"),
        F.expr("event_type = 'signup'").alias("force"),
        F.expr("event_type <> 'error'").alias("ok"),
    )


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four logged tries per fetch, one more than allowed."""
    return table(spark, sf_dir, "events").select(
        F.expr("event_id DIV 4").alias("fetch_id"),
        F.expr("event_id % 4 + 1").alias("attempt"),
        F.expr("event_type IN ('view', 'purchase')").alias("ok"),
        F.expr("concat('failed: ', event_type, ' ', event_id)").alias("error"),
    )


def robots_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One robots file per domain seen in the request log."""
    body = (
        "concat('User-agent: bot\\nDisallow: /\\n\\nuser-agent: * # all\\nAllow: /', n % 7, '\\nDisallow: /', "
        "n % 5, '\\r\\nDisallow: /3 # three\\n\\nUser-agent: *\\nDisallow: /\\n')"
    )
    status = "CASE n % 10 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN NULL WHEN 3 THEN 403 ELSE 200 END"
    return (
        table(spark, sf_dir, "events")
        .select(F.expr("user_id % 20").alias("n"))
        .distinct()
        .select(
            F.expr("concat('d', n, '.example.com')").alias("domain"),
            F.expr(status).alias("status"),
            F.expr(body).alias("body"),
        )
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One extraction answer per line item: fenced for flag R, cut short at
    quantity 50, without plans at quantity 1, without a company at tax 0.  Features
    are one text at quantity 13 and mixed at 14; at 15 the company is given twice."""
    row = table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "CAST(round(l_extendedprice * 100) AS BIGINT) AS _price",
        "CAST(round(l_tax * 100) AS BIGINT) AS _tax",
        "CAST(l_quantity AS BIGINT) AS _q",
    )
    company = "CASE WHEN _tax = 0 THEN '' ELSE concat(IF(_q = 15, '\"company_name\": \"Old\", ', ''), '\"company_name\": \"Supplier-', l_suppkey, '\", ') END"
    output = (
        "CASE WHEN _tax = 1 THEN '\"output_tokens\": null, ' WHEN _tax = 2 THEN '' "
        f"WHEN _tax = 3 THEN '\"output_tokens\": \"on request\", ' ELSE concat('\"output_tokens\": ', {money('_price + 50')}, ', ') END"
    )
    first = (
        f"concat('{{\"plan_name\": \"Part-', l_partkey, '\", \"input_tokens\": ', {money('_price')}, ', ', {output}, "
        "CASE l_returnflag WHEN 'N' THEN '' ELSE '\"currency\": \"EUR\", ' END, "
        "CASE _q WHEN 13 THEN '\"features\": \"fast\"' WHEN 14 THEN '\"features\": [\"q14\", null, true]' "
        "ELSE concat('\"features\": [\"q', _q, '\", \"24/7\"]') END, ', \"limitations\": ', "
        "CASE l_linestatus WHEN 'F' THEN 'null' ELSE concat('\"O\\'Neil ', _q, '\"') END, '}')"
    )
    second = f"concat(', {{\"plan_name\": null, \"input_tokens\": \"', {money('_price')}, '\", \"features\": null}}')"
    plans = (
        f"CASE WHEN _q = 1 THEN '[]' WHEN _q < 25 THEN concat('[', {first}, {second}, ']') ELSE concat('[', {first}, ']') END"
    )
    doc = f"concat('{{', {company}, '\"plans\": ', {plans}, '}}')"
    return row.selectExpr(
        f"{LINE_ITEM_ID} AS answer_id",
        "concat('compare part ', l_partkey) AS source_query",
        "l_shipdate AS created_at",
        f"{doc} AS _doc",
        "l_returnflag",
        "_q",
    ).selectExpr(
        "answer_id",
        "source_query",
        "created_at",
        "CASE WHEN _q = 50 THEN left(_doc, length(_doc) - 5) "
        "WHEN l_returnflag = 'R' THEN concat('```json\\n', _doc, '\\n```') ELSE _doc END AS response",
    )


def trace_lines(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """One trace line per event; clicks write a line that is no trace line."""
    stage = (
        "CASE event_type WHEN 'view' THEN 'THINKING' WHEN 'signup' THEN 'TOOL_RESULT' "
        "WHEN 'error' THEN 'TOOL_ERROR' WHEN 'purchase' THEN 'ANSWER' ELSE 'TOOL_CALL' END"
    )
    line = f"concat('  [', date_format(ts, 'HH:mm:ss'), '] * ', rpad({stage}, 11, ' '), ' ', props)"
    source = table(spark, sf_dir, "events") if events is None else events
    return source.select(
        F.col("event_id").alias("seq"),
        "ts",
        F.expr(f"CASE WHEN event_type = 'click' AND value < 10 THEN concat('more ', props) ELSE {line} END").alias("value"),
    )


def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metadata entry per page; many share a domain."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("ord"),
        F.expr("concat('page-', page_id)").alias("provider_name"),
        "url",
        text.url_domain("url").alias("domain"),
        F.expr("timestampadd(MINUTE, page_id, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("scraped_at"),
        F.expr("html LIKE '%</html>%'").alias("success"),
    )


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, URLs and domains of all pages, and one unknown per page."""
    meta = page_metadata(spark, sf_dir)
    return meta.select(
        F.explode(F.array("provider_name", "url", "domain", F.concat(F.lit("unknown/"), "url"))).alias("identifier")
    ).distinct()


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tool result per page, five to a conversation."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id DIV 5 AS conv_id",
        "page_id % 5 AS seq",
        "CASE WHEN url LIKE 'https%' THEN 'pages' ELSE 'SQLite' END AS server",
        "concat('Found [', url, '] (', url, '), done') AS text",
    )


def result_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged SQL results: JSON for flag A, quoted literals for N, literals with
    a None for R; an empty list or text at quantities 1 and 2."""
    row = table(spark, sf_dir, "lineitem").selectExpr(
        f"{LINE_ITEM_ID} AS log_id",
        "l_suppkey",
        "l_partkey",
        "l_returnflag",
        f"{money('CAST(round(l_extendedprice * 100) AS BIGINT)')} AS price",
        "CAST(l_quantity AS BIGINT) AS q",
    )

    def item(quote: str, output: str) -> str:
        k = quote
        return (
            f"concat('[{{', {k}, 'company_name', {k}, ': ', {k}, 'Supplier-', l_suppkey, {k}, ', ', {k}, 'plan_name', {k}, "
            f"': ', {k}, 'Part-', l_partkey, {k}, ', ', {k}, 'input_tokens', {k}, ': ', price, ', ', {k}, 'output_tokens', {k}, "
            f"': ', {output}, ', ', {k}, 'currency', {k}, ': ', {k}, 'USD', {k}, '}}]')"
        )

    double, single = "'\"'", "'\\''"
    return row.selectExpr(
        "log_id",
        f"CASE WHEN q = 1 THEN '[]' WHEN q = 2 THEN '' WHEN l_returnflag = 'A' THEN {item(double, 'price')} "
        f"WHEN l_returnflag = 'N' THEN {item(single, 'price')} ELSE {item(single, repr('None'))} END AS result_text",
    )
