"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Fitting, on at most SAMPLE_ROWS labelled rows (the bound is a parameter; nothing else
is sampled):

* Terms are whole words and word beginnings of 3 to 7 letters.  Per term the labelled
  rows with and without toxicity are counted; terms that are much more frequent with it,
  by a log-likelihood ratio beyond chance, make the vocabulary.  Copies and near copies among the
  labelled rows count once, so a copied text cannot make its words look toxic.
* Examples are the TF-IDF vectors of the labelled rows over that vocabulary.
* Two folds score each other; a logistic fit on these held-out votes turns votes, amount
  of evidence and its density in the text into a calibrated score.

Scoring, on all rows: a text's exact nearest examples are found with an inverted index
whose postings are cut into blocks of examples with the largest weight of each block.
Blocks are visited by their bound until no bound can beat the k-th best cosine.  Votes
are weighted by distance.  The examples and terms found are the evidence.

The score reads the text alone.  Defined cases: null and empty texts, and texts without
any vocabulary term, get the calibrated score of no evidence; whole texts are read;
ids may be null or repeated; columns are carried along, those named as the results are
replaced.  Without labelled rows every score is 0.5 and no row is predicted toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clashing, stage

SAMPLE_ROWS = 20_000
MAX_TERMS = 4_000
PREFIXES = range(3, 8)
# Log-likelihood ratio that a term must reach: about the level at which one in a million
# unrelated terms passes.
MIN_RATIO = 20.0
# How many times as frequent among toxic rows a term must be.
MIN_LIFT = 20.0
NEIGHBOURS = 15
EXAMPLE_BLOCK = 64
THRESHOLD = 0.7
RESULTS = ("score", "predicted", "evidence_ids", "evidence_terms")
# Weight of the prior against the votes.
PRIOR = 0.05
_WORDS = re.compile(r"\w+")
_REMEMBERED = 200_000


def _terms_of(word: str) -> list[str]:
    return [f"={word}", *[f"^{word[:k]}" for k in PREFIXES if k <= len(word)]]


def _words(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def _sketch(text: str | None) -> list[int]:
    """Three minima of hashed five-word shingles: near copies share most of them."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").lower().split()
    shingles = [" ".join(words[i : i + 5]).encode() for i in range(max(1, len(words) - 4))]
    hashes = np.array([xxh3_64_intdigest(s) for s in shingles], np.uint64)
    return [int((hashes * np.uint64(m)).min().astype(np.int64)) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _sketched(rows: DataFrame, text: str) -> DataFrame:
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([_sketch(v.as_py()) for v in batch.column(names.index(text))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(got[:, i].copy()) for i in range(3)]], names=[*names, "_m0", "_m1", "_m2"])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(f"_m{i}", T.LongType()) for i in range(3)]])
    return rows.mapInArrow(run, schema)


def training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``sample_rows`` labelled rows (``id``, ``text``, ``y``, ``fold``), one of each
    set of copies or near copies.  A document with several labels counts as toxic if one says so."""
    named = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("y"))
    known = named.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(2 * sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    # Both tables of ids are bounded by the sample, so no text is shuffled.
    sketches = stage(_sketched(rows.join(F.broadcast(known), "id"), "text").drop("text"))
    for m in ("_m0", "_m1", "_m2"):
        # The same row of each set on every run, whatever order rows arrive in.
        others = [c for c in sketches.columns if c != m]
        first = F.min(F.struct(F.xxhash64("id").alias("_order"), *others)).alias("_row")
        sketches = sketches.groupBy(m).agg(first).select(m, *[F.col(f"_row.{c}").alias(c) for c in others])
    chosen = sketches.select("id", "y").distinct().orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    return rows.join(F.broadcast(chosen), "id").withColumn("fold", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(2)))


def _term_counts(train: DataFrame) -> DataFrame:
    """(``term``, and per fold and label the rows that have it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for text, y, fold in zip(*(batch.column(n).to_pylist() for n in ("text", "y", "fold")), strict=True):
                for term in {t for w in _words(text) for t in _terms_of(w)}:
                    counts.setdefault(term, [0, 0, 0, 0])[2 * fold + (1 if y else 0)] += 1
            cols = list(zip(*counts.values(), strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["term", "n0", "p0", "n1", "p1"])

    got = train.mapInArrow(run, "term string, n0 long, p0 long, n1 long, p1 long")
    return got.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("n0", "p0", "n1", "p1")])


def _ratio(p: int, n: int, pos: int, neg: int) -> float:
    """Log-likelihood ratio of a term in p of pos toxic and n of neg other rows; 0 if it does not go with toxicity."""
    if pos == 0 or neg == 0 or p * neg <= n * pos:
        return 0.0
    share = (p + n) / (pos + neg)

    def part(k: float, of: int, q: float) -> float:
        return (k * math.log(k / (of * q)) if k else 0.0) + ((of - k) * math.log((of - k) / (of * (1 - q))) if k < of else 0.0)

    return 2 * (part(p, pos, share) + part(n, neg, share)) if 0 < share < 1 else 0.0


class Example(NamedTuple):
    id: int | None
    toxic: int
    words: dict[str, int]
    total: int


class Index:
    """TF-IDF vectors of labelled examples with block maxima."""

    def __init__(self, examples: Sequence[Example], terms: Mapping[str, float]):
        self.terms = {t: i for i, t in enumerate(sorted(terms))}
        self.names = sorted(terms)
        self.weight = np.array([terms[t] for t in self.names])
        self.known: dict[str, tuple[int, ...]] = {}
        rows = [(e, self.vector(e.words)[0]) for e in examples]
        silent = [e.toxic for e, v in rows if not v]
        self.prior = (sum(silent) + 0.5) / (len(silent) + 1.0)
        rows = [(e, v) for e, v in rows if v]
        # Similar examples side by side make tight blocks: sort by strongest term.
        rows.sort(key=lambda r: (max(r[1], key=lambda t: (r[1][t], t)), r[0].toxic, r[0].id is None, r[0].id or 0))
        self.ids = [e.id for e, _ in rows]
        self.toxic = np.array([e.toxic for e, _ in rows], float)
        postings: dict[int, list[tuple[int, float]]] = {}
        for no, (_, v) in enumerate(rows):
            for t, w in v.items():
                postings.setdefault(t, []).append((no, w))
        self.blocks = -(-len(rows) // EXAMPLE_BLOCK)
        # Per term: its postings by block, and the largest weight in each block.
        self.postings: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        self.most: dict[int, np.ndarray] = {}
        for t, found in postings.items():
            nos, ws = np.array([n for n, _ in found]), np.array([w for _, w in found])
            most, by_block = np.zeros(self.blocks), {}
            for b in np.unique(nos // EXAMPLE_BLOCK):
                at = nos // EXAMPLE_BLOCK == b
                by_block[int(b)] = (nos[at] % EXAMPLE_BLOCK, ws[at])
                most[b] = ws[at].max()
            self.postings[t], self.most[t] = by_block, most

    def of_word(self, word: str) -> tuple[int, ...]:
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            got = self.known[word] = tuple(self.terms[t] for t in _terms_of(word) if t in self.terms)
        return got

    def vector(self, words: Mapping[str, int]) -> tuple[dict[int, float], float]:
        """(unit TF-IDF vector, its length before scaling)."""
        counts: dict[int, int] = {}
        for word, n in words.items():
            for t in self.of_word(word):
                counts[t] = counts.get(t, 0) + n
        if not counts:
            return {}, 0.0
        v = {t: (1 + math.log(n)) * float(self.weight[t]) for t, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}, length

    def nearest(self, v: Mapping[int, float], k: int = NEIGHBOURS, skip: int | None = None) -> list[tuple[float, int]]:
        """The ``k`` largest cosines and their examples, exactly; blocks that cannot matter are skipped."""
        terms = [t for t in v if t in self.most]
        if not terms:
            return []
        bounds = sum(v[t] * self.most[t] for t in terms)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or (len(best) == k and bounds[b] < best[-1][0] - 1e-12):
                break
            dots = np.zeros(EXAMPLE_BLOCK)
            for t in terms:
                if (found := self.postings[t].get(int(b))) is not None:
                    dots[found[0]] += v[t] * found[1]
            best += [(float(dots[i]), int(b) * EXAMPLE_BLOCK + int(i)) for i in np.flatnonzero(dots > 0)]
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[k:]
        return best

    def vote(self, words: Mapping[str, int], total: int) -> tuple[tuple[float, float, float], list[int], list[int]]:
        """((share of toxic votes, amount of evidence, its density), examples, terms) of a
        text of ``total`` words."""
        v, length = self.vector(words)
        found = self.nearest(v)
        if not found:
            return (0.0, 0.0, 0.0), [], list(v)
        hits = sum(n for w, n in words.items() if self.of_word(w))
        cos = np.array([c for c, _ in found])
        votes = 1.0 / (1.05 - np.minimum(1.0, cos))
        toxic = self.toxic[[i for _, i in found]]
        share = float((votes @ toxic + PRIOR * self.prior) / (votes.sum() + PRIOR))
        return (share, math.log1p(length), math.log1p(1000 * hits / (total + 50))), [i for _, i in found], sorted(v, key=lambda t: -v[t])


def _calibrated(rows: Sequence[tuple[float, float, float]], y: Sequence[int]) -> np.ndarray:
    """Logistic fit by Newton steps with a small ridge; slopes are kept at or above zero."""
    x, t = np.array([[1.0, *r] for r in rows]), np.array(y, float)
    b = np.zeros(x.shape[1])
    use = list(range(x.shape[1]))
    while True:
        b[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            step = np.zeros(len(b))
            xs = x[:, use]
            step[use] = np.linalg.solve((xs * (p * (1 - p))[:, None]).T @ xs + 0.05 * np.eye(len(use)), xs.T @ (t - p) - 0.05 * b[use])
            b += np.clip(step, -3, 3)
            if np.abs(step).max() < 1e-6:
                break
        if not (bad := [i for i in use if i and b[i] < 0]):
            return b
        use = [i for i in use if i not in bad]


class Model(NamedTuple):
    index: Index
    fit: np.ndarray | None

    def score(self, evidence: tuple[float, float, float]) -> float:
        if self.fit is None:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(np.array([1.0, *evidence]) @ self.fit, -30, 30))))


def _vocabulary(counts: Sequence[tuple], folds: Sequence[int], sizes: Mapping[tuple[int, int], int]) -> dict[str, float]:
    """Terms that go with toxicity, with inverse document frequency."""
    pos, neg = (sum(sizes.get((f, y), 0) for f in folds) for y in (1, 0))
    found = []
    for term, *c in counts:
        n, p = (sum(c[2 * f + y] for f in folds) for y in (0, 1))
        lift = (p + 0.5) / (pos + 1) * (neg + 1) / (n + 0.5)
        if (ratio := _ratio(p, n, pos, neg)) >= MIN_RATIO and lift >= MIN_LIFT:
            found.append((ratio, term, math.log((1 + pos + neg) / (1 + p + n))))
    found.sort(key=lambda x: (-x[0], x[1]))
    return {term: idf for _, term, idf in found[:MAX_TERMS]}


def fit(train: DataFrame) -> Model:
    """Vocabulary, examples and calibration from :func:`training_rows`."""
    sizes = {(r["fold"], 1 if r["y"] else 0): r["count"] for r in train.groupBy("fold", "y").count().collect()}
    # A term in fewer than three toxic rows cannot reach the ratio; the rest is bounded by the sample.
    counts = [tuple(r) for r in _term_counts(train).where("p0 + p1 >= 3").select("term", "n0", "p0", "n1", "p1").collect()]
    pos, neg = (sum(n for (_, y), n in sizes.items() if y == want) for want in (1, 0))
    counts = [c for c in counts if _ratio(c[2] + c[4], c[1] + c[3], pos, neg) >= MIN_RATIO / 2]
    vocabularies = [_vocabulary(counts, folds, sizes) for folds in ((0, 1), (0,), (1,))]
    wanted = {t for v in vocabularies for t in v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, totals = [], []
            for text in batch.column("text").to_pylist():
                counted = _words(text)
                found = {w: n for w, n in counted.items() if any(t in wanted for t in _terms_of(w))}
                words.append([{"word": w, "n": n} for w, n in found.items()])
                totals.append(counted.total())
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), batch.column("fold"), pa.array(words, kind), pa.array(totals, pa.int64())], names=["id", "y", "fold", "words", "total"])

    kinds = {f.name: f.dataType for f in train.schema.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in ("id", "y", "fold")]).add("words", T.ArrayType(T.StructType().add("word", "string").add("n", "long"))).add("total", "long")
    rows = train.mapInArrow(run, schema).orderBy(F.xxhash64("id"), "id").collect()  # at most the sample, a few words each
    examples = [(r["fold"], Example(r["id"], 1 if r["y"] else 0, {w["word"]: w["n"] for w in r["words"]}, r["total"])) for r in rows]
    votes, y = [], []
    for fold in (0, 1):
        index = Index([e for f, e in examples if f != fold], vocabularies[1 + (1 - fold)])
        for f, e in examples:
            if f == fold:
                votes.append(index.vote(e.words, e.total)[0])
                y.append(e.toxic)
    index = Index([e for _, e in examples], vocabularies[0])
    return Model(index, _calibrated(votes, y) if examples else None)


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score``, ``predicted``, ``evidence_ids`` and ``evidence_terms``."""
    docs = clashing(docs, RESULTS)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        at = names.index(text)
        for batch in batches:
            scores, ids, terms = [], [], []
            for v in batch.column(at).cast(pa.string()):
                words = _words(v.as_py())
                evidence, found, hit = model.index.vote(words, words.total())
                scores.append(model.score(evidence))
                ids.append([model.index.ids[i] for i in found])
                terms.append([model.index.names[t] for t in hit[:10]])
            cols = [
                *batch.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()),
                pa.array(ids, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, *RESULTS])
        model.index.known.clear()  # the worker lives on and has other work

    schema = T.StructType(list(docs.schema.fields)).add("score", "double").add("predicted", "integer")
    schema = schema.add("evidence_ids", T.ArrayType(T.LongType())).add("evidence_terms", T.ArrayType(T.StringType()))
    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from: crc32 of the id as text leaves 1 mod 3."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The production model: fitted on labels of rows that are not held out."""
    return fit(stage(training_rows(docs, labels.where(~held_out()), sample_rows)))
