"""Packing token sequences first-fit decreasing, in randomised groups of documents.

Documents are tokenized where they are read; only piece lengths are shuffled.  A
document of more than ``capacity`` ids is cut into full pieces and one remainder.
A hash deals documents out to groups of about GROUP_DOCS, so no task needs more than
a group, whatever ids or copies the table has, and each group is packed by itself: longest piece first, each into the first
sequence with room, which a tournament tree over the free space finds in log time.

Defined cases: a null or empty text is the end id alone; ids may be null or repeated
(a repeated row is packed again); extra columns are ignored.  Results depend only on
the rows, not on partitions or retries.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
GROUP_DOCS = 5_000
TOKENIZER = "word_bpe_49k.json"
# Ids of this many distinct chunks, twice over, are remembered per worker.
REMEMBERED = 700_000
# Of these, the first ones (mostly the common words) outlive a task in their worker.
KEPT = 300_000
# Longer chunks are tokenized each time they occur.
LONG_CHUNK = 64
# Closing punctuation that the tokenizer splits from a letter before it (it treats ' apart).
_ENDS = string.punctuation.replace("'", "")
# Below it are Latin letters only, which Python lower-cases as the tokenizer does and
# whose composed form is the letter itself.
_LATIN = "\u0250"
_DOTTED = "\u0130"  # the one letter whose lower case is a letter and a mark


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The tokenizer finds its special tokens, lower-cases, splits at white space and between
    letters and punctuation, and nothing crosses a split.  A text's ids are therefore those
    of its chunks between spaces and line ends, and a chunk's those of its letters and its
    closing punctuation.  (No special token holds a space or ends a word of letters.)
    Words repeat, so both are looked up; unknown ones are tokenized together.  Two
    generations of looked-up chunks are kept: what the newer one lacks is taken over from
    the older one, which goes when the newer one is full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        # Byte-level models write bytes that are no printable Latin-1 as characters from 256 on.
        odd = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.bytes = {b: 256 + i for i, b in enumerate(odd)}

    def _tokenized(self, chunks: list[str]) -> dict[str, bytes]:
        """Latin words go to the model at once; the rest takes all of the tokenizer's steps."""
        out, rest, tokenize = {}, [], self.tokenizer.model.tokenize
        for c in chunks:
            if c.isalpha() and max(c) < _LATIN and _DOTTED not in c:
                word = c if c.isascii() else c.encode().decode("latin-1").translate(self.bytes)
                out[c] = _packed([t.id for t in tokenize(word)])
            else:
                rest.append(c)
        got = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        return out | {c: _packed(e.ids) for c, e in zip(rest, got, strict=True)}

    def _parts(self, chunk: str) -> tuple[str, str]:
        """Letters (Latin ones in lower case) and closing punctuation, or the chunk as it is."""
        body = chunk.rstrip(_ENDS)
        # Only a letter at the border makes it a split of the tokenizer's own.
        if not body.isalpha() or _DOTTED in body:
            return chunk, ""
        return body.lower() if max(body) < _LATIN else body, chunk[len(body) :]

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Remember ``chunks``; those too long to remember are returned."""
        known, before = self.known, self.before
        long = [c for c in chunks if len(c) > LONG_CHUNK]  # as they are: never split or lower-cased
        short = {c for c in chunks if len(c) <= LONG_CHUNK} if long else chunks
        if before:
            taken = {c: before[c] for c in short if c in before}
            known.update(taken)
            short = short.difference(taken)
        parts = {c: self._parts(c) for c in short}
        new = {p for two in parts.values() for p in two if p not in known}
        if new:
            known.update({p: before[p] for p in new if p in before})
            known.update(self._tokenized([p for p in new if p not in known]))
        for chunk, (body, end) in parts.items():
            known[chunk] = known[body] + known[end] if end else known[body]
        if not long:
            return {}
        got = self.tokenizer.encode_batch_fast(long, add_special_tokens=False)
        return {c: np.array(e.ids, "<u4").tobytes() for c, e in zip(long, got, strict=True)}

    def rest(self) -> None:
        """Give back what the next task can learn again."""
        self.before = {}
        if len(self.known) > KEPT:
            self.known = dict(islice(self.known.items(), KEPT))

    def encode(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        if missing := set(chunks).difference(self.known):
            if len(self.known) > REMEMBERED:
                self.known, self.before, missing = {}, self.known, set(chunks)
            long, known = self._learn(missing), self.known
            if long:
                return b"".join([long[c] if c in long else known[c] for c in chunks])
        return b"".join(map(self.known.__getitem__, chunks))


def encoder(path: str) -> Encoder:
    """The worker's encoder: its tasks share what it has learned.

    Functions reach workers by value, so the package's own globals last for one task only;
    the tokenizer library's module lasts as long as the worker.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


class Bins:
    """First fit: a tournament tree whose nodes hold the most free space below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.free = [capacity] * (2 * self.leaves)

    def put(self, length: int) -> tuple[int, int]:
        """(bin, free space before) of the first bin with room for ``length``."""
        free, at = self.free, 1
        while at < self.leaves:
            at *= 2
            if free[at] < length:
                at += 1
        bin_, room = at - self.leaves, free[at]
        free[at] = room - length
        while at > 1:
            at //= 2
            most = max(free[2 * at], free[2 * at + 1])
            if free[at] == most:
                break
            free[at] = most
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; equal lengths go in the order given."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    full = lengths == capacity
    bins[full] = np.arange(full.sum())
    first, rest = int(full.sum()), np.flatnonzero(~full)
    rest = rest[np.argsort(-lengths[rest], kind="stable")]
    tree = Bins(len(rest), capacity)
    for i in rest:
        at, room = tree.put(int(lengths[i]))
        bins[i], offsets[i] = first + at, capacity - room
    return bins, offsets


PIECE_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
# The row a piece is from: rows alike in all columns are dealt to groups one by one.
ROW = "_row"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenized documents cut into pieces of at most ``capacity`` ids; ``_row`` numbers the rows."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = encoder(path)
        encode = worker.encode
        for batch in batches:
            out: list[tuple] = []
            for row, doc, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ids = encode(value.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = memoryview(ids)[4 * start : 4 * (start + capacity)]
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), total, row))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[*PIECE_NAMES, ROW])
        worker.rest()

    row = F.monotonically_increasing_id().alias(ROW)
    return docs.select(row, F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{PIECES}, {ROW} long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with ``sequence_id`` and ``offset``."""
    groups = max(1, round(docs.count() / group_docs))
    cut = pieces(docs, path or tokenizer_path(), capacity, id_col=id_col, text=text)
    # By row and place: copies, and the pieces of one long text, spread over all groups.
    cut = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", ROW), F.lit(groups)))

    def run(group: pa.Table) -> pa.Table:
        keys = ["doc_id", "start", "length", "ids_crc32", ROW]
        no = group.column("_group")[0].as_py()
        group = group.sort_by([(k, "ascending") for k in keys]).select(PIECE_NAMES)
        bins, offsets = first_fit_decreasing(group.column("length").to_numpy(), capacity)
        return group.append_column("sequence_id", pa.array(bins * groups + no)).append_column("offset", pa.array(offsets))

    return cut.groupBy("_group").applyInArrow(run, f"{PIECES}, sequence_id long, offset long")
