"""Phrase collocations against brute force on a small table with awkward rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarifflow.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, words int, phrase string, n long, hash string, range int, key int, score double, k int, cuts int"
CLASH = (1, "x", 2, "y", 3, 4, 0.5, 6, 7)


def _rows():
    rng = random.Random(11)
    words = ["the", "of", "new", "york", "city", "stock", "market", "a\x01", "a", "é", "naïve", "\xa0x", "Zeit", "ZEIT", "x" * 300, "\U0001f600"]
    joins = [" ", " ", " ", "  ", "\t", ", ", ".", "!\n", "\r", "\x0b", ":"]
    out = []
    for i in range(240):
        text = "".join(rng.choice(words) + rng.choice(joins) for _ in range(rng.randrange(60)))
        if i % 3:
            text += " new york city " + rng.choice(["of the stock market", "Stock Market", "stock; market"])
        out.append((i, text, [None, "en", "en", "und", ""][i % 5]))
    out += [(500, None, "en"), (501, "", None), (502, " \t ", "xx"), (503, "alone", "one"), (504, "the of " * 4000, "en"), (505, ".,;" * 50, "en")]
    out += [out[3]] * 40
    return [(*r, *CLASH) for r in out]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(4).cache()


def _brute(rows, least, top):
    count, total = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, 6):
                count[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) >= 2 and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(b >= a and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), " ".join(p), f[p[:k]], f[p[k:]]))
        for rank, (score, a, _, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase, -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize("least, top", [(100, 2000), (7, 2000), (7, 5)])
def test_equals_brute_force(table, least, top):
    got = C.collocations(table, top, least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = _brute(table.collect(), least, top)
    assert len(want) > 5
    assert sorted(map(tuple, got.collect())) == want


def test_every_range_border(spark, table):
    """Ranges of a few rows: heads and extensions cross their borders."""
    phrases = C.frequent(table, 7)
    want = {(r["lang"], tuple(r["words"])): r[2:] for r in C.measured(phrases).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    try:
        got = {(r["lang"], tuple(r["words"])): r[2:] for r in C.measured(phrases).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == want
    count = {k: v[0] for k, v in want.items()}
    for (lang, words), (n, heads, tails, longest) in want.items():
        assert n == count[lang, words]
        assert heads == [count[lang, words[:k]] for k in range(len(words))]
        assert tails == [count[lang, words[len(words) - k :]] for k in range(len(words))]
        if words:
            longer = [n for (other, p), n in count.items() if other == lang and len(p) == len(words) + 1 and words in (p[1:], p[:-1])]
            assert longest == max(longer, default=0)


def test_runs_of_any_codes():
    rng = np.random.default_rng(4)
    for high in (3, 1 << 22, (1 << 31) - 2):
        codes = rng.integers(1, high, 12, dtype=np.int64).astype(np.int32)[rng.integers(0, 12, 500)]
        for length in range(1, 6):
            starts = np.arange(len(codes) - length + 1)
            first, count = C._same(codes, starts, length)
            got = Counter({tuple(codes[a : a + length].tolist()): int(n) for a, n in zip(first, count, strict=True)})
            assert got == Counter(tuple(codes[a : a + length].tolist()) for a in starts)


def test_large_products(spark):
    """1000 * a * n and l * r pass 64 bits."""
    big = 4_000_000_000
    rows = [("x", [], 5 * big), ("x", ["p"], 2 * big), ("x", ["q"], 3 * big - 1), ("x", ["p", "q"], big + 7)]
    phrases = spark.createDataFrame(rows, "lang string, words array<string>, n long")
    got = C.ranked(C.measured(phrases), 10).collect()
    assert [tuple(r) for r in got] == [("x", 1, "p q", big + 7, 2 * big, 3 * big - 1, 5 * big, 1000 * (big + 7) * 5 * big // (2 * big * (3 * big - 1)))]


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
