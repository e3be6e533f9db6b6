"""Pieces of the comparison SQL (DuckDB dialect), written from the contract and
not from the Spark expressions."""

from __future__ import annotations

from html import entities, unescape

from ..functions import text

# Every named character reference of HTML 4, from the standard library's table and not from
# the code's own, in the closed and (where HTML allows it) the open form; decimal and
# hexadecimal forms of printable ASCII signs.  The sign that starts references comes last.
_NUMBERS = [f"&#{code};" for code in range(33, 127)] + [f"&#x{code:x};" for code in range(33, 127)]
_NAMES = [f"&{name};" for name in entities.name2codepoint] + [f"&{name}" for name in entities.html5 if not name.endswith(";")]
_REFERENCES = [(ref, unescape(ref)) for ref in sorted([*_NAMES, "&apos;", *_NUMBERS], key=lambda ref: (-len(ref), ref)) if unescape(ref) not in ("&", ref)]


def q(value: str) -> str:
    """String literal; characters outside printable ASCII go through chr()."""
    pieces, plain = [], ""
    for ch in value:
        if 32 <= ord(ch) < 127:
            plain += "''" if ch == "'" else ch
            continue
        if plain:
            pieces.append(f"'{plain}'")
            plain = ""
        pieces.append(f"chr({ord(ch)})")
    if plain or not pieces:
        pieces.append(f"'{plain}'")
    return "(" + " || ".join(pieces) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(text.STRIP_CHARS)})"


def normalize(x: str) -> str:
    blanks = f"regexp_replace({x}, '[ \\t]+', ' ', 'g')"
    return strip(f"regexp_replace({blanks}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def html_text(x: str) -> str:
    # No back-references in this dialect: one alternative per dropped tag.
    dropped = "|".join(rf"<{t}\b[^>]*>.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "noscript", "svg"))
    bare = f"regexp_replace({x}, '{dropped}|<!--.*?-->|<[!/?]?[a-z][^>]*>', chr(1), 'gis')"
    for ref, ch in _REFERENCES:
        bare = f"replace({bare}, {q(ref)}, {q(ch)})"
    decoded = f"regexp_replace({bare}, '&amp;?', '&', 'g')"
    nodes = f"list_transform(string_split({decoded}, chr(1)), lambda n: {strip('n')})"
    return f"array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ')"


def clean_html(x: str) -> str:
    return normalize(html_text(x))


def capped(x: str, limit: int) -> str:
    note = (
        f"chr(10) || chr(10) || '[...content truncated: showing {limit:,} of ' || "
        f"format('{{:,}}', length({x})) || ' characters...]'"
    )
    return f"CASE WHEN length({x}) > {limit} THEN left({x}, {limit}) || {note} ELSE {x} END"


PRICE = r"[$€£]\s?\d|\d+\.\d{2}|per\s+1?[MK]?\s*tokens?"


def price_like(x: str) -> str:
    return f"regexp_matches({x}, '{PRICE}', 'i')"


def domain(url: str) -> str:
    return f"regexp_extract({url}, '^[a-z]+://([^/?#]*)', 1)"


def money(cents: str) -> str:
    return f"(({cents}) // 100) || '.' || lpad((({cents}) % 100)::VARCHAR, 2, '0')"


def lines_with_ends(x: str) -> str:
    """Lines with their newline kept; an empty rest after the last one is none."""
    parts = f"string_split({x}, chr(10))"
    return (
        f"list_filter(list_transform({parts}, lambda l, i: CASE WHEN i < len({parts}) THEN l || chr(10) ELSE l END), "
        "lambda l: l <> '')"
    )


def micros(ts: str) -> str:
    return f"epoch_us({ts})"


ATTEMPT_ID = (
    "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || "
    "round(l_extendedprice * 100)::BIGINT || '-' || strftime(l_shipdate, '%Y%m%d')"
)

# Price history: one attempt per line item with its two stored texts.
HISTORY = f"""
price_base AS (
  SELECT *, {ATTEMPT_ID} AS attempt_id, 'part-' || l_partkey AS provider, l_shipdate AS scraped_at,
    round(l_extendedprice * 100)::BIGINT AS price, round(l_discount * 100)::BIGINT AS discount,
    round(l_tax * 100)::BIGINT AS tax, l_quantity::BIGINT AS quantity,
    l_returnflag <> 'R' AND l_quantity < 49 AS success
  FROM lineitem),
price_history AS (
  SELECT attempt_id, provider, scraped_at, success, quantity, l_partkey, l_suppkey, l_returnflag, l_linestatus,
    CASE WHEN success THEN '# Part ' || l_partkey || chr(10) || 'Input: $' || {money('price')} || ' per 1M tokens'
      || chr(10) || chr(10) || 'Quantity ' || quantity || ' units' || chr(10) || 'Discount ' || {money('discount')}
      || chr(10) || 'Status ' || l_returnflag || l_linestatus END AS markdown,
    CASE WHEN success THEN 'Tax & fees $' || {money('tax')} || ' ' || quantity || ' left' END AS html
  FROM price_base)"""

FLAGS = HISTORY + """,
hashed AS (SELECT *, CASE WHEN success THEN sha256(markdown || html) END AS content_hash FROM price_history),
before AS (
  SELECT *, lag(content_hash) OVER w AS prev_hash, lag(scraped_at) OVER w AS prev_at FROM hashed
  WINDOW w AS (PARTITION BY provider ORDER BY scraped_at, attempt_id)),
flags AS (
  SELECT *, coalesce(success AND prev_hash <> content_hash, false) AS content_changed FROM before)"""

STORED = HISTORY + """,
stored AS (
  SELECT attempt_id, provider, scraped_at, 'markdown' AS format, markdown AS content FROM price_history WHERE success
  UNION ALL
  SELECT attempt_id, provider, scraped_at, 'html', html FROM price_history WHERE success)"""

PAIRS = f""",
pairs AS (
  SELECT *, lag(content) OVER (PARTITION BY provider, format ORDER BY scraped_at, attempt_id) AS prior_content
  FROM stored),
marked AS (
  SELECT attempt_id, provider, format, scraped_at, unnest({lines_with_ends('content')}) AS line, 1 AS sign
  FROM pairs WHERE prior_content IS NOT NULL
  UNION ALL
  SELECT attempt_id, provider, format, scraped_at, unnest({lines_with_ends('prior_content')}), -1
  FROM pairs WHERE prior_content IS NOT NULL),
net_lines AS (
  SELECT attempt_id, provider, format, scraped_at, line, sum(sign)::BIGINT AS net
  FROM marked GROUP BY ALL HAVING sum(sign) <> 0)"""

PRICE_LINES = f""",
price_lines AS (
  SELECT attempt_id, format, CASE WHEN net > 0 THEN 'added' ELSE 'removed' END AS change,
    left({strip('line')}, 200) AS line, abs(net) AS n
  FROM net_lines
  WHERE {price_like('line')}
    AND NOT starts_with(line, CASE WHEN net > 0 THEN '++' ELSE '--' END))"""

REQUESTS = """
requests AS (
  SELECT event_id // 20 AS call_id, event_id % 20 AS pos, 'u' || user_id AS provider,
    'https://d' || (user_id % 20) || '.example.com/' || (user_id % 7) AS url,
    'd' || (user_id % 20) || '.example.com' AS domain, user_id % 20 AS n, user_id % 7 AS page, ts AS requested_at,
    event_type = 'signup' AS force, event_type <> 'error' AS ok
  FROM events)"""

PLANS = f"""
answer_base AS (
  SELECT *, {ATTEMPT_ID} AS answer_id, round(l_extendedprice * 100)::BIGINT AS price,
    round(l_tax * 100)::BIGINT AS tax, l_quantity::BIGINT AS quantity FROM lineitem),
plans AS (
  SELECT answer_id, 0::BIGINT AS pos, 'compare part ' || l_partkey AS source_query, l_shipdate AS created_at,
    CASE WHEN tax = 0 THEN 'Unknown' ELSE 'Supplier-' || l_suppkey END AS company_name, 'Part-' || l_partkey AS plan_name,
    price AS input_cents, CASE WHEN tax IN (1, 2) THEN 0 WHEN tax = 3 THEN NULL ELSE price + 50 END AS output_cents,
    CASE WHEN tax = 3 THEN 'on request' END AS output_raw,
    CASE WHEN l_returnflag = 'N' THEN 'USD' ELSE 'EUR' END AS currency, 'unknown' AS billing_period,
    CASE quantity WHEN 13 THEN '"fast"' WHEN 14 THEN '["q14", null, true]'
      ELSE '["q' || quantity || '", "24/7"]' END AS features_text,
    CASE WHEN l_linestatus = 'F' THEN 'None' ELSE 'O''Neil ' || quantity END AS limitations
  FROM answer_base WHERE quantity BETWEEN 2 AND 49
  UNION ALL
  SELECT answer_id, 1, 'compare part ' || l_partkey, l_shipdate,
    CASE WHEN tax = 0 THEN 'Unknown' ELSE 'Supplier-' || l_suppkey END, 'None',
    price, 0, NULL, 'USD', 'unknown', 'null', ''
  FROM answer_base WHERE quantity BETWEEN 2 AND 24),
plan_ids AS (SELECT *, answer_id || '#' || pos AS id FROM plans),
latest AS (
  SELECT * FROM plan_ids
  QUALIFY row_number() OVER (PARTITION BY company_name, plan_name ORDER BY created_at DESC, id DESC) = 1)"""

STAGE = """CASE event_type WHEN 'view' THEN 'THINKING' WHEN 'signup' THEN 'TOOL_RESULT'
  WHEN 'error' THEN 'TOOL_ERROR' WHEN 'purchase' THEN 'ANSWER' ELSE 'TOOL_CALL' END"""
TRACE = f"""
trace AS (
  SELECT event_id AS seq, ts, strftime(ts, '%H:%M:%S') AS time, {STAGE} AS stage, props AS message
  FROM events WHERE NOT (event_type = 'click' AND value < 10))"""
