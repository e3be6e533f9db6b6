"""Phrase collocations from n-gram counts kept as ordered streams.

Counting goes up by phrase length, in passes over the texts.  A phrase can only be
frequent if all shorter phrases inside it are, so each pass tests these in a filter of
fixed size and counts the others not at all.  The filter for pairs and triples is made
of their hashes, counted as numbers: a hash occurs at least as often as each of its
phrases.  False hits of a filter cost time only: what passes is counted exactly, by its
words.

The frequent phrases of all lengths of a language are then one stream.  In prefix order
each phrase stands directly behind its own prefixes, in suffix order behind its own
suffixes.  One scan of each order with a stack of at most MAX_WORDS entries therefore
meets, in lockstep, the counts of a phrase's left parts, its right parts and its
extensions; no count is looked up in a hash table.  The stream is cut into ranges, which
may begin inside a group of one prefix: each range is told the prefixes of its first row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarifflow.operators.ordered import durable

from .common import LOWER, UPPER, stage

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2_000
# Each pass: lengths counted by words, length counted by hashes, length of the phrases in
# the filter, which is made of the hashes of the pass before (of the words' at first).
PASSES = (((1,), 0, 0), ((), 2, 1), ((2,), 3, 2), ((3, 4, 5), 0, 3))
# Bits of the filter: 4 MB, whatever the number of phrases.
FILTER_BITS = 1 << 25
# Words that are counted together; phrases and hashes kept before they are sent on.
CHUNK_WORDS = 1_500_000
KEPT_PHRASES = 200_000
KEPT_HASHES = 2_000_000
_SALTS = 64

_SPLITS = b".,;:!?\n\x0b\x0c\r"
_END = b"\xff"  # in no UTF-8 text
_TABLE = bytes.maketrans(UPPER.encode() + _SPLITS, LOWER.encode() + _END * len(_SPLITS))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: bytes) -> list[bytes]:
    """Words in lower case, and ``_END`` where a piece ends."""
    return text.translate(_TABLE).replace(_END, b" \xff ").split()


def _spots(hashes: np.ndarray) -> np.ndarray:
    mixed = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - (FILTER_BITS.bit_length() - 1))


class Codes(dict):
    """Numbers of words in order of appearance; 0 ends a piece."""

    def __init__(self):
        super().__init__({_END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def _same(codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(first start, count) of each distinct run of ``length`` codes; exact for any codes."""
    bits = int(codes.max(initial=1)).bit_length()
    key, used = codes[starts].astype(np.int64), bits
    for k in range(1, length):
        if used + bits > 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            used = max(1, int(key.max(initial=1)).bit_length())
        key = (key << bits) | codes[starts + k]
        used += bits
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return starts[first], count


class Counts:
    """Partial counts of one task; what it holds is bounded, what it yields may repeat."""

    def __init__(self, lengths: Sequence[int], hashed: int, order: int, seen: np.ndarray | None):
        self.lengths, self.hashed, self.order, self.seen = lengths, hashed, order, seen
        self.codes, self.hashes = Codes(), [np.uint64(0)]
        self.waiting: dict[str, list[np.ndarray]] = {}
        self.words = 0
        self.found: Counter = Counter()
        self.hash_of: dict = {}
        self.numbers: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, lang: str, text: bytes) -> Iterator[pa.RecordBatch]:
        words = tokens(text)
        self.waiting.setdefault(lang, []).append(np.fromiter(map(self.codes.__getitem__, [*words, _END]), np.int32, len(words) + 1))
        self.words += len(words) + 1
        if self.words >= CHUNK_WORDS:
            yield from self.flush()

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        names = list(self.codes)
        self.hashes.extend(np.uint64(xxhash.xxh64_intdigest(w)) for w in names[len(self.hashes) :])
        hashes = np.array(self.hashes, np.uint64)
        for lang, parts in self.waiting.items():
            self._count(lang, np.concatenate(parts), names, hashes)
        self.waiting.clear()
        self.words = 0
        if len(self.codes) > KEPT_PHRASES:
            self.codes, self.hashes = Codes(), [np.uint64(0)]
        if last or len(self.found) > KEPT_PHRASES:
            yield self._phrases()
        if sum(len(h) for h, _ in self.numbers) > KEPT_HASHES or last:
            self._merge()
            if last or len(self.numbers[0][0]) > KEPT_HASHES // 2:
                yield self._numbers()

    def _count(self, lang: str, codes: np.ndarray, names: list[bytes], hashes: np.ndarray) -> None:
        """``rolling`` hashes the k words from each place on; ``may`` tells where all phrases
        of the filter's length inside these words are in the filter."""
        inside = codes != 0
        if 1 in self.lengths:
            self.found[lang, b""] += int(inside.sum())
            self.hash_of[lang, b""] = 0
        word_hash = hashes[codes]
        with np.errstate(over="ignore"):
            rolling = np.full(len(codes), np.uint64(xxhash.xxh64_intdigest(lang.encode())))
            may = np.ones(len(codes), bool)
            for k in range(1, max([*self.lengths, self.hashed]) + 1):
                n = len(codes) - k + 1
                if n <= 0:
                    break
                rolling = rolling[:n] * _FACTOR + word_hash[k - 1 :]
                may = (may[:n] if k <= self.order else may[:-1] & may[1:]) & inside[k - 1 :] if k > 1 else inside
                if k == self.order:
                    may = may & self._hits(rolling)
                starts = np.flatnonzero(may) if k in self.lengths or k == self.hashed else ()
                if len(starts) and k == self.hashed:
                    self.numbers.append(np.unique(rolling[starts], return_counts=True))
                elif len(starts):
                    self._note(lang, codes, names, rolling, starts, k)

    def _hits(self, rolling: np.ndarray) -> np.ndarray:
        at = _spots(rolling)
        return (self.seen[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def _note(self, lang: str, codes: np.ndarray, names: list[bytes], rolling: np.ndarray, starts: np.ndarray, length: int) -> None:
        if length == 1:
            count = np.bincount(codes[starts])
            for c in np.flatnonzero(count).tolist():
                self.found[lang, names[c]] += int(count[c])
            place = np.zeros(len(count), np.int64)
            place[codes[starts]] = starts
            self.hash_of.update(((lang, names[c]), rolling[place[c]]) for c in np.flatnonzero(count).tolist())
            return
        first, count = _same(codes, starts, length)
        for at, n in zip(first.tolist(), count.tolist(), strict=True):
            key = lang, b" ".join([names[c] for c in codes[at : at + length].tolist()])
            self.found[key] += n
            self.hash_of[key] = rolling[at]

    def _merge(self) -> None:
        if not self.numbers:
            self.numbers = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
        keys, counts = (np.concatenate(x) for x in zip(*self.numbers, strict=True))
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        self.numbers = [(keys[first], np.add.reduceat(counts, first) if len(first) else counts)]

    def _numbers(self) -> pa.RecordBatch:
        (keys, counts), self.numbers = self.numbers[0], []
        none = pa.nulls(len(keys), pa.string())
        return pa.RecordBatch.from_arrays([none, none, pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int64))], names=_COUNTED)

    def _phrases(self) -> pa.RecordBatch:
        keys = list(self.found)
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.binary()).cast(pa.string()),
                pa.array(np.array([self.hash_of[k] for k in keys], np.uint64).view(np.int64)),
                pa.array([self.found[k] for k in keys], pa.int64()),
            ],
            names=_COUNTED,
        )
        self.found, self.hash_of = Counter(), {}
        return batch


_COUNTED = ["lang", "phrase", "hash", "n"]


def _counted(texts: DataFrame, lengths: Sequence[int], hashed: int, order: int, seen: np.ndarray | None, least: int) -> DataFrame:
    """(lang, phrase, hash, n) of phrases of ``lengths`` words with ``least`` occurrences or
    more; hashes of ``hashed`` words without language and phrase.  Counting words adds the
    empty phrase, whose count is that of all words."""
    shared = None if seen is None else texts.sparkSession.sparkContext.broadcast(seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(lengths, hashed, order, None if shared is None else shared.value)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield from counts.add(lang, text.as_py())
        yield from counts.flush(last=True)

    partial = texts.mapInArrow(run, "lang string, phrase string, hash long, n long")
    summed = partial.groupBy("lang", "phrase", "hash").agg(F.sum("n").alias("n"))
    return stage(summed.where((F.col("n") >= least) | (F.col("phrase") == "")))


def _filter_of(phrases: DataFrame) -> np.ndarray:
    """Bits of the phrases' hashes: at most FILTER_BITS / 64 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = _spots(batch.column(0).to_numpy().view(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(spots >> 6), pa.array(spots & 63)], names=["at", "bit"])

    spots = phrases.select("hash").mapInArrow(run, "at long, bit long")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))
    bits = spots.groupBy("at").agg(F.bit_or(mask).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[bits.column("at").to_numpy()] = bits.column("bits").to_numpy()
    return out.view(np.uint8)


def frequent(docs: DataFrame, least: int = MIN_COUNT, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, words, n): phrases of up to MAX_WORDS words with ``least`` occurrences or more,
    and per language the empty phrase with the count of all words."""
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    seen, out = None, None
    for lengths, hashed, order in PASSES:
        found = _counted(texts, lengths, hashed, order, seen, least)
        if lengths:
            words = F.when(F.col("phrase") == "", F.array().cast("array<string>")).otherwise(F.split("phrase", " "))
            part = found.where("phrase IS NOT NULL").select("lang", words.alias("words"), "n")
            out = part if out is None else out.unionByName(part)
        if hashed or not order:
            seen = _filter_of(found.where("phrase IS NULL" if hashed else "phrase <> ''"))
    return out


class Scan:
    """One ordered stream: rows behind their own heads (prefixes, or suffixes read backwards).

    ``stack`` holds the heads of the row at hand, the empty phrase first.  A row leaves it
    with the greatest count among its extensions by one word; heads that this range was
    only told of leave with that alone.
    """

    def __init__(self, told: list[tuple]):
        self.stack: list[list] = [[lang, words, n, None, 0] for lang, words, n in told]
        self.out: list[tuple] = []

    def _pop(self) -> None:
        lang, words, _, row, longest = self.stack.pop()
        if row is None:
            if longest and words:
                self.out.append((lang, words, None, None, None, longest))
            return
        self.out.append((*row[:-1], max(row[-1], longest)))

    def put(self, lang: str, words: list[str], n: int | None, longest: int, finish) -> None:
        stack = self.stack
        while stack and not (stack[-1][0] == lang and words[: len(stack[-1][1])] == stack[-1][1]):
            self._pop()
        if stack and len(stack[-1][1]) == len(words):  # what another range has found about the same phrase
            stack[-1][4] = max(stack[-1][4], longest)
            return
        if words and n is not None:
            stack[-1][4] = max(stack[-1][4], n)
        row = None if n is None else finish([s[2] for s in stack])
        stack.append([lang, words, n, row, longest])

    def end(self) -> None:
        while self.stack:
            self._pop()


_STREAM = "lang string, words array<string>, n long, heads array<long>, tails array<long>, longest long"
_NAMES = ["lang", "words", "n", "heads", "tails", "longest"]
_TYPES = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]


def _scanned(rows: DataFrame, backwards: bool) -> DataFrame:
    """``rows`` with the counts of their heads (or tails, read backwards) in ascending length,
    the empty phrase first, and ``longest``: the greatest count of an extension seen."""
    order = F.reverse("words") if backwards else F.col("words")
    laid = rows.withColumn("key", order).repartitionByRange("lang", "key").sortWithinPartitions("lang", "key", F.col("n").isNull())
    laid = durable(laid.withColumn("range", F.spark_partition_id()))
    # The first row of each range, and its heads: at most MAX_WORDS rows a range.
    firsts = laid.groupBy("range").agg(F.min(F.struct("lang", "key")).alias("first"))
    heads = firsts.select("range", "first.lang", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("first.key") - 1, F.lit(0))), lambda k: F.slice("first.key", 1, k))).alias("key"))
    heads = heads.where(F.size("key") < MAX_WORDS).withColumnRenamed("range", "to")
    told = laid.where("n IS NOT NULL").join(F.broadcast(heads), ["lang", "key"]).select("to", "lang", "key", "n", "range")
    at: dict[int, list[tuple]] = {}
    for to, lang, key, n, held in sorted(told.collect(), key=lambda r: len(r["key"])):
        if held != to:
            at.setdefault(to, []).append((lang, key, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = None
        for batch in batches:
            for row in batch.to_pylist():
                scan = scan or Scan(at.get(row["range"], []))
                n, key, longest = row["n"], row["key"], row["longest"]

                def finish(counts, row=row, key=key):
                    whole = key[::-1] if backwards else key
                    return (row["lang"], whole, row["n"], row["heads"] if backwards else counts, counts if backwards else None, row["longest"])

                scan.put(row["lang"], key, n, longest, finish)
            if scan and len(scan.out) >= 10_000:
                yield _rows(scan)
        if scan:
            scan.end()
            yield _rows(scan)

    def _rows(scan: Scan) -> pa.RecordBatch:
        rows = [(lang, words[::-1] if backwards and n is None else words, n, *rest) for lang, words, n, *rest in scan.out]
        scan.out = []
        cols = list(zip(*rows, strict=True)) or [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)

    return laid.select("lang", "key", "n", "heads", "longest", "range").mapInArrow(run, _STREAM)


def measured(phrases: DataFrame) -> DataFrame:
    """(lang, words, n, heads, tails, longest): ``heads[k]`` and ``tails[k]`` count the first and
    the last k words, ``longest`` the most frequent extension by one word."""
    none = F.lit(None).cast("array<long>")
    rows = phrases.select("lang", "words", "n", none.alias("heads"), F.lit(0).cast("long").alias("longest"))
    forth = _scanned(rows, backwards=False).select("lang", "words", "n", "heads", "longest")
    back = _scanned(forth, backwards=True)
    # Only phrases at the border of a range have more than one row.
    return back.groupBy("lang", "words").agg(*[F.max(c).alias(c) for c in ("n", "heads", "tails", "longest")]).where("n IS NOT NULL")


def collocations(docs: DataFrame, top: int = TOP, least: int = MIN_COUNT, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    A phrase of 2 to MAX_WORDS words is a candidate if it occurs ``least`` times or more.
    Its score is that of its weakest cut into a first part (l occurrences) and the rest (r):
    floor(1000 * a * n / (l * r)), where a counts the phrase and n all words of the language.
    Phrases that only occur inside a longer candidate are left out.

    Defined cases: a null language is ``und``, a null text is empty; phrases never cross a
    document or a piece; repeated rows count again; ties of cuts go to the shorter first
    part, ties of phrases to the greater count, then to the phrase in byte order; an empty
    table gives no rows; other columns are ignored, whatever their names.  Products are
    decimals of 38 digits, so arithmetic is exact while 1000 * a * n and l * r stay below 10^38.
    """
    return ranked(measured(frequent(docs, least, text=text, lang=lang)), top)


def ranked(phrases: DataFrame, top: int) -> DataFrame:
    """Scores of the phrases of :func:`measured`, best first."""
    rows = phrases.where((F.size("words") >= 2) & (F.col("longest") < F.col("n")))
    wide = "CAST({} AS DECIMAL(19, 0))"
    score = f"({wide.format('1000 * n')} * {wide.format('heads[0]')}) div ({wide.format('heads[k]')} * {wide.format('tails[size(words) - k]')})"
    rows = rows.withColumn("cuts", F.expr(f"transform(sequence(1, size(words) - 1), k -> {score})"))
    rows = rows.withColumn("score", F.array_min("cuts")).withColumn("k", F.array_position("cuts", F.col("score")).cast("int"))
    rows = rows.select(
        "lang",
        F.array_join("words", " ").alias("phrase"),
        F.col("n").alias("a"),
        F.expr("heads[k]").alias("l"),
        F.expr("tails[size(words) - k]").alias("r"),
        F.expr("heads[0]").alias("n"),
        "score",
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    rows = rows.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
