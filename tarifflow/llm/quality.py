"""Quality rules as a short-circuit cascade.

Each rule looks at one document and may reject it.  On a bounded sample every
rule's cost (seconds) and selectivity (share rejected) are measured, and rules run
in the order of rejections per second; a document leaves at the first rejection, so
costly measures are never taken of documents a cheap rule has refused.  The order
changes the work, never the verdict.

Words are runs of characters other than space and 0x09-0x0D.  Defined cases: a null
text has no words and is rejected as too short; empty and repeated rows are judged
like any other; columns are carried along, those named as the results are replaced.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clashing

MIN_WORDS = 50
# Shares in percent: whole numbers compare exactly.
MAX_REPEAT_SHARE = 50
MAX_SYMBOLS_PER_WORD = 10
MAX_DUP_LINES = 50
WORD_CHARS = (2, 12)
MIN_ALPHA_SHARE = 50
# Only the order of the rules is fitted on these rows.
SAMPLE_ROWS, SAMPLE_BYTES = 400, 1_000_000
_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured:
    """One text; each measure is taken when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        raw = self.raw
        # Code points are the bytes that do not continue one.
        points = len(raw) if raw.isascii() else int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
        return points - sum(raw.count(b) for b in _BLANKS)

    @cached_property
    def n_symbols(self) -> int:
        return sum(self.raw.count(b) for b in _SYMBOLS)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        words = np.empty(n, dtype=object)
        words[:] = self.words
        ids = pd.factorize(words)[0].astype(np.int64)
        pairs = pd.factorize(ids[:-1] * (int(ids.max()) + 1) + ids[1:])[0].astype(np.int64)
        windows = pairs[:-1] * (int(ids.max()) + 1) + ids[2:]
        no, counts = np.unique(windows, return_inverse=True, return_counts=True)[1:]
        often = counts[no] > 1
        covered = np.zeros(n, dtype=bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= often
        return int(covered.sum())

    @cached_property
    def n_alpha_words(self) -> int:
        """Words with a letter: an ASCII one, or any character beyond ASCII."""
        return sum(1 for w in self.words if not w.isascii() or any(65 <= c <= 90 or 97 <= c <= 122 for c in w))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Measured], bool]


RULES = (
    Rule("few_words", lambda m: m.n_words < MIN_WORDS),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > MAX_REPEAT_SHARE * m.n_words),
    Rule("symbols", lambda m: 100 * m.n_symbols > MAX_SYMBOLS_PER_WORD * m.n_words),
    Rule("repeated_lines", lambda m: 100 * m.n_dup_lines > MAX_DUP_LINES * len(m.lines)),
    Rule("word_length", lambda m: not WORD_CHARS[0] * m.n_words <= m.word_chars <= WORD_CHARS[1] * m.n_words),
    Rule("few_letters", lambda m: 100 * m.n_alpha_words < MIN_ALPHA_SHARE * m.n_words),
)


def ordered(rules: Sequence[Rule], texts: Sequence[bytes | None]) -> list[Rule]:
    """Rules by rejections per second on ``texts``, best first."""
    gain = {}
    for rule in rules:
        start = time.perf_counter()
        rejected = sum(rule.rejects(Measured(t)) for t in texts)
        gain[rule.name] = rejected / max(1e-9, time.perf_counter() - start)
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> list[Rule]:
    """Rules in the order to run them, from a bounded sample of ``docs``."""
    short = docs.where(F.coalesce(F.octet_length(text), F.lit(0)) < SAMPLE_BYTES)
    rows = short.select(F.col(text).cast("binary")).limit(SAMPLE_ROWS).collect()
    return ordered(rules, [None if r[0] is None else bytes(r[0]) for r in rows])


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, *, text: str = "text", measures: Sequence[str] = ()) -> DataFrame:
    """``docs`` with ``rejected_by`` (null: kept) and, if asked for, named measures of
    :class:`Measured`, which are then taken of every document."""
    docs = clashing(docs, [*measures, "rejected_by"])
    rules = cascade(docs, rules, text)
    added = [T.StructField(m, T.LongType()) for m in measures] + [T.StructField("rejected_by", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts: list[str | None] = []
            taken: list[list[int]] = [[] for _ in measures]
            for value in batch.column(batch.num_columns - 1):
                m = Measured(value.as_py())
                verdicts.append(next((r.name for r in rules if r.rejects(m)), None))
                for out, name in zip(taken, measures, strict=True):
                    out.append(getattr(m, name))
            cols = [*batch.columns[:-1], *[pa.array(x, pa.int64()) for x in taken], pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-1], *measures, "rejected_by"])

    return docs.withColumn("_raw", F.col(text).cast("binary")).mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
