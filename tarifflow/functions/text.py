"""Scalar text functions, written once as Spark SQL expressions.

Every ``*_sql`` helper takes SQL text for its inputs and returns SQL text, so the
same definition serves ``F.expr`` in DataFrame code and ``CREATE TEMPORARY
FUNCTION ... RETURN`` in :mod:`tarifflow.functions.register`.  The public
functions accept a column name or any SQL expression and return a Column.
All of them are built-in expressions: no Python runs for a row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
MAX_CONTENT_CHARS = 50000
CACHE_TTL_HOURS = 24
CLIP_CHARS = 200
DROPPED_TAGS = ("script", "style", "noscript", "svg")
TRUNCATION_NOTE = "\n\n[...content truncated: showing {shown} of {total} characters...]"
# Java form of: currency sign + digit | number with two decimals | per-token wording
PRICE_PATTERN = (
    r"(?iuU)[$€£][\s\x1c-\x1f]?\d|\d+\.\d{2}"
    r"|per[\s\x1c-\x1f]+1?[MK]?[\s\x1c-\x1f]*tokens?"
)
URL_PATTERN = r'https?://[^\s<>"{}|\\^`\[\]]+'
# Characters a Unicode strip removes.
STRIP_CHARS = "".join(
    chr(c)
    for c in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)
# HTML character references decoded natively.  The ones in OPEN_ENTITIES are also
# legal without the closing semicolon.
ENTITIES = {
    "&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'",
    "&#39;": "'", "&#x27;": "'", "&euro;": "€", "&pound;": "£", "&cent;": "¢",
    "&copy;": "©", "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•",
    "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&lsquo;": "‘",
    "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&times;": "×",
}
OPEN_ENTITIES = {"&quot": '"', "&copy": "©", "&middot": "·"}
# --- end of fixed values ----------------------------------------------------

_MARK = "\x01"
# The same characters as a regex class.
_BLANK = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Marks with the blanks around them; a run of blanks is looked at once, plain signs briefly.
_GAP = rf"(?=[^!-~])(?<![{_BLANK}\x01])[{_BLANK}]*+\x01[{_BLANK}\x01]*+"


def lit_sql(text: str) -> str:
    """SQL string literal holding exactly ``text``, whatever it contains."""
    out = []
    for ch in text:
        if ch in "'\\":
            out.append("\\" + ch)
        elif ch == "\n":
            out.append("\\n")
        elif ord(ch) < 32 or ch in STRIP_CHARS and ch != " ":
            out.append(f"\\u{ord(ch):04x}")
        else:
            out.append(ch)
    return "'" + "".join(out) + "'"


def strip_sql(x: str) -> str:
    return f"trim(BOTH {lit_sql(STRIP_CHARS)} FROM {x})"


def read_text_sql(x: str) -> str:
    """Universal newlines: what a text-mode read of the stored file returns."""
    return f"replace(replace({x}, '\\r\\n', '\\n'), '\\r', '\\n')"


def url_domain_sql(url: str) -> str:
    # The regex covers URLs that java.net.URI refuses (blanks, bare brackets ...).
    fallback = f"regexp_extract({url}, {lit_sql(r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)')}, 1)"
    return f"coalesce(try_parse_url({url}, 'AUTHORITY'), {fallback}, '')"


def _decode_entities_sql(x: str) -> str:
    for ref, ch in ENTITIES.items():
        x = f"replace({x}, {lit_sql(ref)}, {lit_sql(ch)})"
    for ref, ch in OPEN_ENTITIES.items():
        x = f"replace({x}, {lit_sql(ref)}, {lit_sql(ch)})"
    return x


# One left-to-right pass, so that whichever of subtree, comment or tag starts
# first wins: a comment that mentions <script> stays a comment.  A tag that closes
# itself opens no subtree.
# All begin with one '<', so that other signs are passed by at the first look.
MARKUP_PATTERN = (
    r"(?is)<(?:(" + "|".join(DROPPED_TAGS) + r")(?=[\s/>])(?:[^>]*[^>/])?>.*?(?:</\1\s*>|\z)"
    r"|!--.*?-->|[!/?]?[a-z][^>]*>)"
)
# Markup the pattern reads differently from a parser.
ODD_MARKUP = (
    r"(?is)<[a-z][^>]*=\s*(?:\"[^\"<>]*>|'[^'<>]*>)"  # '>' inside a quoted attribute
    r"|<!\[|<(?:rt|rp|template|plaintext|xmp|iframe|noembed|noframes)\b"
    r"|<(?:" + "|".join(DROPPED_TAGS) + r")\b[^>]*/>"
    r"|</(?![a-z])|<[!?](?!--|[a-z])|<!--(?:-?>)|--!>"
    r"|<(title|textarea)\b[^>]*>[^<]*<(?!/\1\s*>)"
)


def _bare_sql(html: str) -> str:
    return f"regexp_replace({html}, {lit_sql(MARKUP_PATTERN)}, {lit_sql(_MARK)})"


def html_to_text_sql(html: str) -> str:
    """The native chain: exact where :func:`html_is_plain_sql` holds.  For arbitrary
    pages use ``html.with_html_text``, which gives the others to a parser."""
    bare = _bare_sql(html)
    # Most pages hold no reference at all, or &amp; alone; only the others are searched
    # for every reference.  A tag cannot cut one in two, so the page tells for its text.
    every = f"transform(array({bare}), n -> {_decode_entities_sql('n')})[0]"
    known = f"IF(regexp_like({html}, '&(?!amp;)'), {every}, {bare})"
    decoded = f"IF(contains({html}, '&'), regexp_replace({known}, '&amp;?', '&'), {bare})"
    return strip_sql(f"regexp_replace({decoded}, {lit_sql(_GAP)}, ' ')")


def html_is_plain_sql(html: str) -> str:
    """True where the native chain is known to equal a full HTML parser: no other
    character reference, nothing of :data:`ODD_MARKUP`, no markup left over after the
    pattern, and svg/noscript neither nested nor left open."""
    known = "|".join([*(ref[1:] for ref in ENTITIES), "amp;?", *(f"{ref[1:]}(?![a-zA-Z0-9;])" for ref in OPEN_ENTITIES)])
    checks = [
        f"NOT regexp_like({html}, {lit_sql(rf'&(?!(?:{known}))[#a-zA-Z]')})",
        f"NOT regexp_like({html}, {lit_sql(ODD_MARKUP)})",
        f"NOT contains({html}, {lit_sql(_MARK)})",
        f"NOT regexp_like({_bare_sql(html)}, {lit_sql('<[a-zA-Z/!?]')})",
    ]
    for tag in ("svg", "noscript"):
        # Cut at every end tag: each piece may open the tag once, the last never.
        pieces = f"split({html}, {lit_sql(rf'(?i)</{tag}\s*>')})"
        opened = f"regexp_count(p, {lit_sql(rf'(?i)<{tag}\b')})"
        # The outer transform binds the pieces, so the page is cut once.
        fits = f"transform(ps, (p, i) -> {opened} <= IF(i = size(ps) - 1, 0, 1))"
        checks.append(f"(NOT contains(lower({html}), '<{tag}') OR transform(array({pieces}), ps -> forall({fits}, ok -> ok))[0])")
    return "(" + " AND ".join(checks) + ")"


def normalize_ws_sql(x: str) -> str:
    # A single blank is already in normal form, so only real changes match: a run that
    # begins with a tab or is longer than one sign.
    runs = f"regexp_replace({x}, {lit_sql(r'[ \t](?:(?<=\t)|(?=[ \t]))[ \t]*+')}, ' ')"
    return strip_sql(f"regexp_replace({runs}, {lit_sql(r'\n{3,}')}, '\\n\\n')")


def clean_content_sql(raw: str, fmt: str) -> str:
    return (
        f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN '' "
        f"WHEN {fmt} = 'html' THEN {normalize_ws_sql(html_to_text_sql(raw))} "
        f"ELSE {normalize_ws_sql(raw)} END"
    )


def capped_text_sql(x: str, limit: int | str = MAX_CONTENT_CHARS) -> str:
    head, middle, tail = (
        TRUNCATION_NOTE.split("{shown}")[0],
        TRUNCATION_NOTE.split("{shown}")[1].split("{total}")[0],
        TRUNCATION_NOTE.split("{total}")[1],
    )
    note = (
        f"concat({lit_sql(head)}, format_number({limit}, 0), {lit_sql(middle)}, "
        f"format_number(length({x}), 0), {lit_sql(tail)})"
    )
    return f"CASE WHEN length({x}) > {limit} THEN concat(substring({x}, 1, {limit}), {note}) ELSE {x} END"


def truncate_guard_sql(x: str, limit: int | str = MAX_CONTENT_CHARS) -> str:
    return (
        f"named_struct('content', {capped_text_sql(x, limit)}, "
        f"'was_truncated', length({x}) > {limit}, 'original_length', length({x}))"
    )


def content_hash_sql(x: str) -> str:
    return f"sha2(coalesce({x}, ''), 256)"


def micros_sql(ts: str) -> str:
    """Microseconds since 1970 of a naive time, whatever the session time zone."""
    return f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({ts} AS TIMESTAMP_NTZ))"


def from_micros_sql(micros: str) -> str:
    return f"timestampadd(MICROSECOND, {micros}, TIMESTAMP_NTZ '1970-01-01 00:00:00')"


def is_fresh_sql(scraped_at: str, now: str, ttl_hours: int | str = CACHE_TTL_HOURS) -> str:
    # Naive times on both sides: their difference needs no zone.  A stored time with a
    # zone, or one that is no full date, is not fresh.
    naive = lit_sql(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?)?$")
    age = (
        f"timestampdiff(MICROSECOND, try_cast({scraped_at} AS TIMESTAMP_NTZ), "
        f"CAST({now} AS TIMESTAMP_NTZ))"
    )
    return f"coalesce(regexp_like(CAST({scraped_at} AS STRING), {naive}) AND {age} < {ttl_hours} * 3600000000L, false)"


def is_price_like_sql(line: str) -> str:
    return f"regexp_like({line}, {lit_sql(PRICE_PATTERN)})"


def first_url_sql(text: str) -> str:
    return f"nullif(regexp_extract({text}, {lit_sql(URL_PATTERN)}, 0), '')"


def clip_line_sql(line: str, limit: int | str = CLIP_CHARS) -> str:
    """Drop the leading +/- mark, strip, keep the first ``limit`` characters."""
    return f"substring({strip_sql(f'substring({line}, 2)')}, 1, {limit})"


def price_tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, {lit_sql(PRICE_PATTERN)}, 0)"


def lines_keep_ends_sql(text: str) -> str:
    """Lines of a text with their newline kept, as ARRAY<STRING>; '' has no line.

    Cutting right after every newline leaves the last line bare, so a last line
    without newline stays a different value from the same text with one.
    """
    return f"filter(split({read_text_sql(text)}, {lit_sql('(?<=\\n)')}), l -> l <> '')"


# --- Column forms -------------------------------------------------------------

def strip(x: str) -> Column:
    return F.expr(strip_sql(x))


def lstrip(x: str) -> Column:
    return F.expr(f"trim(LEADING {lit_sql(STRIP_CHARS)} FROM {x})")


def rstrip(x: str) -> Column:
    return F.expr(f"trim(TRAILING {lit_sql(STRIP_CHARS)} FROM {x})")


def url_domain(url: str) -> Column:
    return F.expr(url_domain_sql(url))


def html_to_text(html: str) -> Column:
    return F.expr(html_to_text_sql(html))


def normalize_ws(text: str) -> Column:
    return F.expr(normalize_ws_sql(text))


def clean_content(raw: str, fmt: str) -> Column:
    return F.expr(clean_content_sql(raw, fmt))


def truncate_guard(text: str, limit: int = MAX_CONTENT_CHARS) -> Column:
    return F.expr(truncate_guard_sql(text, limit))


def content_hash(text: str) -> Column:
    return F.expr(content_hash_sql(text))


def is_fresh(scraped_at: str, now: str, ttl_hours: int = CACHE_TTL_HOURS) -> Column:
    return F.expr(is_fresh_sql(scraped_at, now, ttl_hours))


def is_price_like(line: str) -> Column:
    return F.expr(is_price_like_sql(line))


def first_url(text: str) -> Column:
    return F.expr(first_url_sql(text))


def clip_line(line: str, limit: int = CLIP_CHARS) -> Column:
    return F.expr(clip_line_sql(line, limit))


def price_tokens(text: str) -> Column:
    return F.expr(price_tokens_sql(text))
