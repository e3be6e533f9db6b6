"""Change detection: line diffs of snapshot pairs and the price report."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window

from ..functions import text
from .ordered import SPLIT_ROWS, OrderedScan, stage
from .snapshots import content_changed, latest_per_provider, snapshot_pairs

_PAIR = ["attempt_id", "provider", "format", "scraped_at"]


def line_diff(pairs: DataFrame) -> DataFrame:
    """Ordered added/removed lines of each pair, as a unified diff lists them
    (longest-block matching; lines keep their newline).  ``at`` is the line's place in
    the text it belongs to, from 0: the prior one if removed, the current one if added.

    The matching has no SQL form, so it runs in Python, one pair per row: pairs are
    independent, and a text is bounded by the stored-text cap.
    """
    return pairs.select(*_PAIR, F.inline(_steps("prior_content", "content")))


# Rows go to Python a hundred at a time: an Arrow batch holds thousands of them, and a
# worker's memory would grow with the rows of its partition up to that number.
_STEP = StructType().add("seq", "long").add("change", "string").add("line", "string").add("at", "long")
_steps = F.udf(lambda old, new: [] if old is None else list(changed_lines(old, new)), ArrayType(_STEP), useArrow=False)


def _lines(value: str) -> list[str]:
    value = value.replace("\r\n", "\n").replace("\r", "\n")
    pieces = value.split("\n")
    return [p + "\n" for p in pieces[:-1]] + pieces[-1:] * bool(pieces[-1])


def changed_lines(old_text: str, new_text: str) -> Iterator[tuple[int, str, str, int]]:
    """(seq, change, line, at) of one pair, in diff order."""
    old, new = _lines(old_text), _lines(new_text)
    seq = 0
    for tag, i1, i2, j1, j2 in SequenceMatcher(None, old, new).get_opcodes():
        if tag == "equal":
            continue
        for change, start, block in (("removed", i1, old[i1:i2]), ("added", j1, new[j1:j2])):
            for at, line in enumerate(block, start):
                yield seq, change, line, at
                seq += 1


def apply_diff(pairs: DataFrame, diff: DataFrame) -> DataFrame:
    """The current text of each pair as ``rebuilt``, from its prior text and its diff.

    ``pairs`` needs attempt_id, format and prior_content.  A diff is bounded like the
    texts it was made from, so it is one array per pair.
    """
    steps = diff.groupBy("attempt_id", "format").agg(F.collect_list(F.struct("change", "at", "line")).alias("_steps"))
    joined = pairs.select("attempt_id", "format", "prior_content").join(steps, ["attempt_id", "format"], "left")
    return _rebuild(joined).select("attempt_id", "format", "rebuilt")


def rebuilt_pairs(pairs: DataFrame) -> DataFrame:
    """Of every pair with a line that differs: attempt_id, format, the current text as
    ``rebuilt`` from the prior text and the ordered diff, and ``in_order``, whether the diff
    lists the lines of either side in order.

    The diff stays an array beside its pair, so neither texts nor lines are stored or moved
    for it, and rows of equal attempt and format keep their own.
    """
    rows = pairs.select("attempt_id", "format", "prior_content", _steps("prior_content", "content").alias("_steps"))
    ats = "transform(array_sort(transform(filter(_steps, s -> s.change = '{}'), s -> struct(s.seq, s.at))), s -> s.at)"
    sides = [ats.format(change) for change in ("removed", "added")]
    in_order = " AND ".join(f"transform(array({x}), v -> v = array_sort(v))[0]" for x in sides)
    return _rebuild(rows.where("size(_steps) > 0")).select("attempt_id", "format", "rebuilt", F.expr(in_order).alias("in_order"))


def _rebuild(rows: DataFrame) -> DataFrame:
    """Adds ``rebuilt``, made of ``prior_content`` and ``_steps`` (null: no line differs)."""
    lines = F.expr(text.lines_keep_ends_sql("prior_content"))
    parts = rows.withColumns({
        "_old": lines,
        "_gone": F.expr("transform(filter(_steps, s -> s.change = 'removed'), s -> s.at)"),
        "_new": F.expr("array_sort(transform(filter(_steps, s -> s.change = 'added'), s -> struct(s.at, s.line)))"),
    })
    kept = parts.withColumn("_kept", F.expr("IF(_steps IS NULL, _old, filter(_old, (l, i) -> NOT array_contains(_gone, i)))"))
    # The n-th added line stands where ``at - n`` kept lines come before it.
    before = kept.withColumn("_before", F.expr("transform(coalesce(_new, array()), (s, n) -> CAST(s.at - n AS INT))"))
    pieces = """concat(
        transform(coalesce(_new, array()), (s, n) -> concat(
          array_join(slice(_kept, IF(n = 0, 0, _before[n - 1]) + 1, _before[n] - IF(n = 0, 0, _before[n - 1])), ''), s.line)),
        array(array_join(slice(_kept, IF(size(_before) = 0, 0, element_at(_before, -1)) + 1, size(_kept)), '')))"""
    return before.withColumn("rebuilt", F.array_join(F.expr(pieces), ""))


def is_no_header_sql(change: str, line: str) -> str:
    """Not one of the lines a diff reader takes for a file header."""
    return f"NOT startswith({line}, CASE {change} WHEN 'added' THEN '++' ELSE '--' END)"


def is_listed_sql(change: str, line: str) -> str:
    return f"({text.is_price_like_sql(line)} AND {is_no_header_sql(change, line)})"


def line_diff_net(pairs: DataFrame, price_lines_only: bool = False) -> DataFrame:
    """Order-free net change per line: +n added or -n removed copies.

    Fully native and without a shuffle: a pair is one row, and its lines are counted
    there by sorting both sides together and measuring runs, so the work grows with the
    number of lines (and its logarithm), however few of them the sides share.
    """

    lines = [_lines_sql(c, price_lines_only) for c in ("prior_content", "content")]
    # Equal sides yield nothing.  Tested here and not in a filter, which would be
    # pushed into the join below and split and match every line a second time.
    return (
        pairs.select(*_PAIR, F.expr(lines[0]).alias("_old"), F.expr(lines[1]).alias("_new"))
        .select(*_PAIR, F.inline(F.expr(f"IF(_old = _new, array(), {_net_sql('_old', '_new')})")))
        .withColumn("change", F.expr("IF(net > 0, 'added', 'removed')"))
    )


def _lines_sql(column: str, price_lines_only: bool) -> str:
    every = text.lines_keep_ends_sql(column)
    # Only a property both sides share may filter here: whether a line is
    # taken for a header depends on the sign of its net change.
    return f"filter({every}, l -> {text.is_price_like_sql('l')})" if price_lines_only else every


def _net_sql(old: str, new: str) -> str:
    """Structs (line, net) of the lines whose numbers differ; one side must hold a line.

    ``transform(array(x), v -> ...)[0]`` names a value once: v is all lines in order, the
    old copies of a line before its new ones; r the runs of equal entries with their
    lengths.  Every step reads its array once, by place.  Where no side has a line twice, the
    lines that the other one lacks are looked up instead.
    """
    both = f"array_sort(concat(transform({old}, l -> named_struct('line', l, 'sign', -1L)), transform({new}, l -> named_struct('line', l, 'sign', 1L))))"
    starts = "filter(sequence(0, size(v) - 1), i -> i = 0 OR v[i] <> v[i - 1])"
    length = "coalesce(get(s, k + 1), size(v)) - s[k]"
    runs = f"transform(array({starts}), s -> transform(s, (at, k) -> named_struct('line', v[at].line, 'net', v[at].sign * ({length}))))[0]"
    # A line's run of new copies follows its run of old ones.
    total = "r[k].net + IF(get(r, k + 1).line = r[k].line, r[k + 1].net, 0L)"
    heads = "filter(sequence(0, size(r) - 1), k -> k = 0 OR r[k].line <> r[k - 1].line)"
    nets = f"transform(array({runs}), r -> transform({heads}, k -> named_struct('line', r[k].line, 'net', {total})))[0]"
    counted = f"filter(transform(array({both}), v -> {nets})[0], c -> c.net <> 0)"
    lacked = ", ".join(f"transform(array_except({a}, {b}), l -> named_struct('line', l, 'net', {n}))" for a, b, n in ((old, new, "-1L"), (new, old, "1L")))
    single = " AND ".join(f"size(array_distinct({x})) = size({x})" for x in (old, new))
    return f"IF({single}, concat({lacked}), {counted})"


def price_lines(column: str) -> Column:
    """The price-like lines of a text, as :func:`listed_net` compares them."""
    return F.expr(_lines_sql(column, True))


def listed_net(pairs: DataFrame) -> DataFrame:
    """:func:`line_diff_net` of price lines with :func:`price_changes`, one row of ``_steps``
    for a pair with any.  ``prior_content`` and ``content`` are the pair's price lines, so
    each text is cut and matched once, however many pairs it is in."""
    steps = _listed_steps_sql("IF(prior_content = content, array(), {net})".format(net=_net_sql("prior_content", "content")))
    return pairs.select(*_PAIR, F.expr(steps).alias("_steps")).where("size(_steps) > 0")


def _listed_steps_sql(net: str) -> str:
    """The structs of ``net`` as a report lists them, but whole lines."""
    signed = f"transform({net}, c -> named_struct('seq', CAST(NULL AS BIGINT), 'change', IF(c.net > 0, 'added', 'removed'), 'line', c.line, 'n', abs(c.net)))"
    return f"filter({signed}, s -> {is_no_header_sql('s.change', 's.line')})"


def price_changes(diff: DataFrame, price_lines_only: bool = False) -> DataFrame:
    """Keep the price-like lines of a diff and clip them for display.
    ``price_lines_only``: the diff was made with that option, do not match again."""
    shown = f"substring({text.strip_sql('line')}, 1, {text.CLIP_CHARS})"
    listed = is_no_header_sql("change", "line") if price_lines_only else is_listed_sql("change", "line")
    return diff.where(listed).withColumn("line", F.expr(shown))


def pricing_changes(
    attempts: DataFrame,
    providers: DataFrame | None = None,
    *,
    snapshots: DataFrame | None = None,
    latest_only: bool = True,
    exact: bool = True,
    split_rows: int = SPLIT_ROWS,
) -> DataFrame:
    """The price-change report as flat rows, one per changed price line.

    ``attempts`` is the stored history of ``clean_payloads`` rows, ``snapshots``
    the stored ``build_snapshots`` table; with it, finding the pairs to compare
    reads hashes and no texts.  A failed
    attempt is not reported; a changed hash is, even without a price line (then
    ``line`` is null).  ``providers`` (column ``provider``, from
    ``resolve_provider``) restricts the report.  ``latest_only=False`` gives the
    report as it stood after every attempt.  ``exact`` lists lines in diff order;
    otherwise the native net form is used, with ``n`` copies per line.
    """
    if providers is not None:
        wanted = providers.select("provider").distinct()
        attempts = attempts.join(wanted, "provider", "left_semi")
        snapshots = snapshots if snapshots is None else snapshots.join(wanted, "provider", "left_semi")
    if snapshots is None:
        return _report(attempts, latest_only, exact, split_rows)
    flags = content_changed(attempts, split_rows)
    only = None
    if latest_only:
        narrow = attempts.select("attempt_id", "provider", "scraped_at", "success")
        only = latest_per_provider(narrow).where("success").select("attempt_id")
        flags = flags.join(only, "attempt_id", "left_semi")
    pairs = snapshot_pairs(snapshots, only, split_rows)
    if exact:
        changes = price_changes(line_diff(pairs)).withColumn("n", F.lit(1).cast("bigint"))
    else:
        net = price_changes(line_diff_net(pairs, price_lines_only=True), price_lines_only=True)
        changes = net.withColumn("n", F.abs("net")).withColumn("seq", F.lit(None).cast("bigint")).drop("net")
    return change_report(flags, changes)


def _report(attempts: DataFrame, latest_only: bool, exact: bool, split_rows: int) -> DataFrame:
    """The report from attempts alone.  Rows are put in order of their provider once,
    with their texts; flags, prior texts and diffs are made where they then lie, so no
    join moves a text or a changed line again.

    Rows of equal provider, time and id are copies of one attempt.  Joins by attempt, as
    :func:`change_report` has them, list its changes for every copy, of its own text, of
    the prior text and of the attempt itself; so does this.
    """
    head = ["attempt_id", "provider", "scraped_at"]
    order = ["scraped_at", "attempt_id"]
    # Without their order, price lines are all that is compared: they are cut out of a text
    # once, for both pairs it is in, and move in its place.
    content = "p.content" if exact else _lines_sql("p.content", True)
    parts = F.expr(f"transform(parts, p -> named_struct('format', p.format, 'content', {content})) AS _parts")
    scan = OrderedScan(attempts.select(*head, "success", "content_hash", parts), ["provider"], order, split_rows=split_rows)
    scan = scan.lag("_before", "content_hash", "scraped_at")
    if latest_only:
        scan = scan.whole_max("_last", F.struct(*order))
    changed = F.coalesce(F.col("_before.content_hash") != F.col("content_hash"), F.lit(False))
    newest = F.struct(*order).eqNullSafe(F.col("_last")) if latest_only else F.lit(True)
    rows = scan.frame().where("success").select(
        *head, changed.alias("content_changed"), F.when(changed, F.col("_before.scraped_at")).alias("previous_scraped_at"),
        newest.alias("_wanted"), F.posexplode_outer("_parts").alias("_pos", "_part"),
    )
    rows = rows.select(*[c for c in rows.columns if c != "_part"], "_part.format", "_part.content")
    # Where no provider is hot no format of one is, and rows stay in their partitions.
    cold = scan.hot is None
    rows = rows if cold else stage(rows)
    copies = Window.partitionBy("provider", "format", "scraped_at", "attempt_id")
    rows = rows.withColumn("_copies", F.count(F.lit(1)).over(copies))
    scan = OrderedScan(rows, ["provider", "format"], order, split_rows=split_rows, cold=cold).lag("_prior", "content", "_copies")
    rows = scan.frame().where("_wanted").withColumns({"prior_content": F.col("_prior.content"), "_times": F.col("_prior._copies")}).drop("_prior")
    differs = "coalesce(prior_content <> content, false)"
    if exact:
        steps = _steps(*[F.when(F.expr(differs), F.col(c)) for c in ("prior_content", "content")])
        listed = rows.withColumn("_steps", steps).withColumn("_steps", F.expr(
            f"transform(filter(_steps, s -> {is_listed_sql('s.change', 's.line')}), s -> named_struct('seq', s.seq, 'change', s.change, 'line', s.line, 'n', 1L))"
        ))
    else:
        net = f"IF({differs}, {_net_sql('prior_content', 'content')}, array())"
        listed = rows.withColumn("_steps", F.expr(_listed_steps_sql(net)))
    listed = listed.select(*head, "previous_scraped_at", "content_changed", "_pos", "_copies", "_times", "format", "_steps")
    # An attempt's changes count together: with none in any format only its flag is a row.
    attempt = Window.partitionBy("provider", "scraped_at", "attempt_id")
    own = F.coalesce(F.size("_steps"), F.lit(0))
    listed = listed.withColumns({
        "_any": F.max(own).over(attempt) > 0,
        "_flag": F.max(F.struct("content_changed", "previous_scraped_at")).over(attempt),
    })
    shown = f"substring({text.strip_sql('s.line')}, 1, {text.CLIP_CHARS})"
    steps = f"transform(_steps, s -> named_struct('format', format, 'seq', s.seq, 'change', s.change, 'line', {shown}, 'n', s.n, 'times', _copies * _times))"
    none = "named_struct('format', CAST(NULL AS STRING), 'seq', CAST(NULL AS BIGINT), 'change', CAST(NULL AS STRING), 'line', CAST(NULL AS STRING), 'n', CAST(NULL AS BIGINT), 'times', 1L)"
    out = listed.select(
        *head, "previous_scraped_at", "content_changed", "_any", "_flag", "_copies",
        F.inline(F.expr(f"CASE WHEN _any THEN {steps} WHEN content_changed AND coalesce(_pos, 0) = 0 THEN array({none}) END")),
    )
    # Of an attempt's copies the first one alone can have changed.
    each = out.withColumn("_copy", F.explode(F.expr("sequence(1L, IF(_any, _copies, 1L) * times)")))
    first = F.expr("NOT _any OR _copy <= times")
    return each.select(
        *head,
        F.when(F.col("_any"), F.when(first, F.col("_flag.previous_scraped_at"))).otherwise(F.col("previous_scraped_at")).alias("previous_scraped_at"),
        F.when(F.col("_any"), first & F.col("_flag.content_changed")).otherwise(F.col("content_changed")).alias("content_changed"),
        "format", "seq", "change", "line", "n",
    )


def change_report(flags: DataFrame, changes: DataFrame) -> DataFrame:
    details = changes.select("attempt_id", "format", "seq", "change", "line", "n")
    return (
        flags.where("success")
        .select("attempt_id", "provider", "scraped_at", "previous_scraped_at", "content_changed")
        .join(details, "attempt_id", "left")
        .where("change IS NOT NULL OR content_changed")
    )


def report_of_listed(flags: DataFrame, listed: DataFrame) -> DataFrame:
    """:func:`change_report` of what :func:`listed_net` gives: a pair's lines stay one row until
    they have met their attempt."""
    shown = f"substring({text.strip_sql('s.line')}, 1, {text.CLIP_CHARS})"
    steps = f"transform(_steps, s -> named_struct('seq', s.seq, 'change', s.change, 'line', {shown}, 'n', s.n))"
    return (
        flags.where("success")
        .select("attempt_id", "provider", "scraped_at", "previous_scraped_at", "content_changed")
        .join(listed.select("attempt_id", "format", "_steps"), "attempt_id", "left")
        .where("_steps IS NOT NULL OR content_changed")
        .select("attempt_id", "provider", "scraped_at", "previous_scraped_at", "content_changed", "format", F.inline_outer(F.expr(steps)))
    )


def nest_report(report: DataFrame) -> DataFrame:
    """One row per reported attempt with its changes as an array.  The array is
    bounded: one pair of capped texts per format."""
    return report.groupBy("attempt_id", "provider", "scraped_at", "previous_scraped_at", "content_changed").agg(
        F.transform(
            F.array_sort(
                F.collect_list(F.when(F.col("change").isNotNull(), F.struct("format", "seq", "change", "line")))
            ),
            lambda c: F.struct(c["format"], c["change"], c["line"]),
        ).alias("changes")
    )


def checked_providers(requests: DataFrame, report: DataFrame) -> DataFrame:
    """For calls (call_id, provider) whose report is empty: every provider asked
    for, including those without data.  Calls with any change give no row."""
    changed = report.select("provider").distinct()
    with_changes = requests.join(changed, "provider", "left_semi").select("call_id").distinct()
    return requests.join(with_changes, "call_id", "left_anti").select("call_id", "provider")
