"""Training-text operators against brute force on small tables with awkward rows."""

import hashlib
import html
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tarifflow.llm import exact_dedup, html_main, mixing, packing, quality, repeats, sharding, simhash, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, kept boolean, score double, size string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCABULARY = ["the", "river", "stone", "Ärger", "über", "quick", "table", "of", "and", "LIGHT", "nuit", "été", "saw", "door"]


def _text(rng, words):
    return " ".join(rng.choice(VOCABULARY) for _ in range(words))


def _texts():
    rng = random.Random(5)
    base = [_text(rng, n) for n in (0, 1, 2, 3, 40, 60, 120, 400)]
    shared = _text(rng, 60)
    near = base[6].split()
    near[50] = "changed"
    return [
        None, "", " \n\t ", "A", "a", *base, base[5].upper(), base[5], base[5], base[5].lower(), " ".join(near),
        f"{_text(rng, 30)} {shared} {_text(rng, 30)}", f"{_text(rng, 9)} {shared}", f"{shared} {_text(rng, 20)}", "x" * 900, "x" * 450 + "y",
        "é" * 300, _text(rng, 9_000), "line one is here\n" * 40, "### $$$ *** " * 40,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i, t in enumerate(_texts()):
        doc = None if i == 7 else 3 * i % 50
        rows.append((doc, t, "en" if i % 3 else None, f"s{i % 3}" if i % 5 else None, None, 9, None, None, "clash"))
    rows += [rows[10], rows[12]]  # rows repeated in full
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "")


def test_exact_dedup(docs):
    got = exact_dedup.mark(docs).collect()
    groups = defaultdict(list)
    for r in got:
        groups[(r["text"] or "").translate(UPPER)].append(r)
    assert len(got) == docs.count()
    for text, rows in groups.items():
        ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
        assert {r["text_sha256"] for r in rows} == {hashlib.sha256(text.encode()).hexdigest()}
        assert {(r["keep_id"], r["group_size"]) for r in rows} == {(max(ids, default=None), len(rows))}
        assert [r["doc_id"] for r in rows if r["kept"]] == [max(ids, default=None)]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(map(_key, kept.collect())) == sorted(_key(r) for r in got if r["kept"])


def test_hot_keys_are_salted(spark):
    rows = spark.range(6000).selectExpr("id AS doc_id", "if(id < 4000, 'Same', concat('t', id % 1500)) AS text")
    got = exact_dedup.mark(rows)
    assert got.where("kept").count() == 1501
    assert got.where("lower(text) = 'same'").select("keep_id", "group_size").distinct().collect() == [(3999, 4000)]


def test_quality_measures_and_order(docs):
    got = quality.judge(docs, measures=quality.BASE).collect()
    for r in got:
        text = r["text"] or ""
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        repeated = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert [r[m] for m in quality.BASE] == [
            len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated),
        ]
        m = quality.Measured(text.encode())
        assert (r["rejected_by"] is None) == (not any(rule.rejects(m) for rule in quality.RULES))
    assert any(r["rejected_by"] is None for r in got)


def test_cascade_runs_cheap_selective_rules_first():
    slow = quality.Rule("slow", lambda m: sum(range(20_000)) < 0)
    good = quality.Rule("good", lambda m: m.n_words < 3)
    assert [r.name for r in quality.ordered([slow, good], [b"a", b"b c", b"d e f g"])] == ["good", "slow"]


def test_shards(docs):
    for n in (1, 3, 8):
        got = sharding.place(docs, n, ("lang", "source", "n_chars")).collect()
        assert len(got) == docs.count()
        slots = defaultdict(list)
        for r in got:
            assert r["size"] == len((r["text"] or "").encode()) + 1
            slots[r["shard"]].append(r["slot"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert set(slots) <= set(range(n))


def test_shards_are_even_and_keep_copies_together(spark):
    rows = spark.range(4000).selectExpr(
        "id AS doc_id", "if(id % 3 = 0, repeat('hot', 20), repeat(concat('w', id % 900), 5 + id % 60)) AS text", "concat('l', id % 3) AS lang", "'s' AS source"
    )
    got = sharding.place(rows).groupBy("shard").sum("size").collect()
    sizes = [r[1] for r in got]
    assert len(sizes) == 8 and max(sizes) / (sum(sizes) / 8) < 1.1
    cold = sharding.place(rows).where("doc_id % 3 <> 0").groupBy("text").agg({"shard": "max", "doc_id": "count"}).count()
    assert cold == sharding.place(rows).where("doc_id % 3 <> 0").select("text", "shard").distinct().count()


URLS = [
    None, "", "no scheme", "https://", "HTTP://WWW.Example.ORG/es/1", "http://example.org/en/12?x=1", "http://a.example.org/en/2", "http://xexample.org/es/",
    "http://x.com/fr/a", "http://x.com/de/a#f", "http://x.net/de/", "http://www.spam-farm.net/a/?utm_source=q&b=2", "http://spam-farm.net/a?b=2",
    "http://spam-farm.net/a?b=3#x", "a://b?c/d", "http://x.net\n/y",
]


def test_url_filter(spark):
    pages = spark.createDataFrame([(i, u, "v", "old") for i, u in enumerate(URLS)] + [(1, URLS[4], "v", "old")], "page_id int, url string, verdict string, canonical string")
    listed = spark.createDataFrame([("spam-farm.net/a?b=2",), ("spam-farm.net/a?b=2",), (None,)], "canonical string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, listed).collect()}
    assert got[None] == got[""] == got["no scheme"] == got["https://"] == ("", "", None, "allow")
    assert got[URLS[4]] == ("www.example.org", "/es/1", "example.org/es/", "block")
    assert got[URLS[5]] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[URLS[6]][2:] == got[URLS[7]][2:] == ("org/", "allow")
    assert got[URLS[8]][2:] == ("com/fr/", "allow") and got[URLS[9]][1:] == ("/de/a", "com/de/", "block")
    assert got[URLS[10]][2:] == (None, "allow") and got["a://b?c/d"][:2] == ("b", "")
    assert [got[u][3] for u in URLS[11:14]] == ["block", "block", "allow"]
    assert url_filter.judge(pages, listed).count() == len(URLS) + 1
    assert url_filter.judge(pages.limit(0), listed).count() == 0


def test_mixing_meets_every_deadline(docs):
    share = mixing.shares({"a": 5, "b": 1, None: 0.001, "c": 2.5}, 1000)
    assert sum(share.values()) == 1000 and min(share.values()) >= 1
    slots = mixing.period(share)
    owner = {x: s for s, xs in slots.items() for x in xs}
    done = Counter()
    for slot in range(1000):
        done[owner[slot]] += 1
        assert all(abs(done[s] - a * (slot + 1) / 1000) < 1 for s, a in share.items())
    got = mixing.mix(docs, block=4, quantum=50).collect()
    assert sorted(r["position"] for r in got) == list(range(len(got)))
    want = Counter((r["doc_id"], r["text"], r["source"]) for r in docs.collect())
    once = Counter((r["doc_id"], r["text"], r["source"]) for r in got if r["epoch"] == 0)
    assert once == want
    with pytest.raises(ValueError, match="without a weight"):
        mixing.mix(docs, {"s0": 1.0})


PAGES = {
    "<html><body><nav><a>Menu, here.</a></nav><article><h1>T</h1><p>One &amp; two,\n three.<p>Four <b>five</b>.</article><footer>x</footer>": "T\nOne & two, three.\nFour five.",
    "<body><div class='cookie-notice'>We use cookies, ok.</div><main><p>Main text is here, yes.</p></main><div id=comments><p>Nice post!</p></div>": "Main text is here, yes.",
    "<p>A<br>b</p><script>var x='</p>';</script><!-- c --><p>cut &copy": "A b\ncut ©",
    "<article><p>Whole sentence, with 1 < 2.</p><form>Go</form><aside>Ad</aside><p>End.</p></arti": "Whole sentence, with 1 < 2.\nEnd.",
    "": "", "<script>never closed": "",
}


def test_main_text(spark):
    for page, want in PAGES.items():
        assert html_main.main_text(page) == want
    links = "".join(f"<li><a href='{i}'>item {i}</a></li>" for i in range(40))
    body = "".join(f"<p>{'A long sentence, with signs; and more. ' * 8}</p>" for _ in range(5))
    assert html_main.main_text(f"<body><div><ul>{links}</ul></div><div>{body}</div>").count("\n") == 4
    pages = spark.createDataFrame([(1, "u", p, "old") for p in (*PAGES, None)], "page_id long, url string, html string, text string")
    got = html_main.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == sorted((t, len(t)) for t in (*PAGES.values(), ""))
    assert html.unescape("&amp") == "&"


def test_main_text_keeps_whole_sections():
    long, short = ("Words of a paragraph, " * 12 * 4)[:1000], ("Words of a shorter one, and more. " * 9)[:300]
    heads = [f"Heading number {i} of the article" for i in range(6)]
    items = [f"an item of the list, number {i}" for i in range(10)]
    cells = [f"cell {i}" for i in range(6)]
    links = "<div><ul>" + "".join(f"<li><a href='{i}'>item {i}</a></li>" for i in range(40)) + "</ul></div>"
    headed = f"<h1>{heads[0]}</h1>" + "".join(f"<h2>{h}</h2><p>{long}</p>" for h in heads[1:])
    listed = f"<h1>{heads[0]}</h1>" + f"<p>{short}</p>" * 5 + "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
    tabled = f"<p>{long}</p>" * 3 + "<table><tbody><tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr></tbody></table>"
    headed_text = [heads[0], *[x for h in heads[1:] for x in (h, long.strip())]]
    for body, want in ((headed, headed_text), (listed, [heads[0], *[short.strip()] * 5, *items]), (tabled, [*[long.strip()] * 3, *cells])):
        for tag in ("article", "main", "div"):
            assert html_main.main_text(f"<body>{links}<{tag}>{body}</{tag}></body>").split("\n") == want
        assert html_main.main_text(f"<body>{links}{body}</body>").split("\n") == want


def _covered(texts, span):
    seen = Counter(t[p : p + span] for t in texts for p in range(len(t) - span + 1))
    out = []
    for t in texts:
        marks = bytearray(len(t))
        for p in range(len(t) - span + 1):
            if seen[t[p : p + span]] > 1:
                marks[p : p + span] = b"\1" * span
        out.append(marks)
    return out


@pytest.mark.parametrize("large", [10_000, 1])
def test_repeats(docs, large):
    rows = docs.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    want = Counter()
    for r, t, marks in zip(rows, texts, _covered(texts, 60), strict=True):
        runs = sum(marks[i] and (i == 0 or not marks[i - 1]) for i in range(len(t)))
        want[(r["doc_id"], len(t), sum(marks), runs, bytes(b for b, m in zip(t, marks, strict=True) if not m))] += 1
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"])) for r in repeats.remove_repeats(docs, 60, 20, large).collect())
    assert got == want


def test_repeats_cut_long_texts_in_parts(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.randrange(97, 99) for _ in range(3000)), np.uint8)
    whole = repeats.Anchors(200, 50).of(data, np.array([len(data)]))
    windows = [w for a, b in zip(whole[3], whole[4], strict=True) for w in range(a, b + 1)]
    assert windows == list(range(3000 - 199))
    assert all(f <= a <= f + 150 for a, f in zip(whole[2], whole[3], strict=True))


def test_simhash(docs):
    rows = docs.collect()
    prints = [simhash.fingerprint((r["text"] or "").encode()) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[root[i]] += [r["doc_id"]] if r["doc_id"] is not None else []
    want = Counter((r["doc_id"], f"{prints[i]:016x}", min(least[root[i]], default=None)) for i, r in enumerate(rows))
    assert Counter(tuple(r) for r in simhash.near_duplicates(docs).collect()) == want
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(root))


@pytest.mark.parametrize("bucket_rows", [16, 2000])
def test_simhash_links_in_crowded_buckets(spark, bucket_rows):
    rng = random.Random(1)
    prints = set()
    for _ in range(3):
        seed = rng.getrandbits(64)
        for _ in range(60):
            prints.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "print long")
    root = {p: p for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame, bucket_rows=bucket_rows)).collect()}
    assert {p: got.get(p, p) for p in signed} == {p: find(p) for p in signed}


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs, capacity=64, group_docs=10).collect()
    rows, pieces, sequences = docs.collect(), Counter(), defaultdict(list)
    for r in rows:
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        for s in range(0, len(ids), 64):
            part = ids[s : s + 64]
            pieces[(r["doc_id"], s, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter(tuple(r)[:5] for r in got) == pieces
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing():
    rng = random.Random(4)
    lengths = np.array([rng.randint(1, 100) for _ in range(500)])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    free, want = [], {}
    for i in sorted(range(500), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(100)
        want[i] = (b, 100 - free[b])
        free[b] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(500)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    encoder, rng = packing.Encoder(packing.tokenizer_path()), random.Random(3)
    special = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "<|EndOfText|>", "a<|endoftext|>b"]
    pool = [*"abzABZ éÉßİŸÖ×ªſǅΣς \n\t'’'s't.,;-#*$%&<>|0½Ⅷ中ひ한\u0301ﬁ😀\xa0\x1c\x85", *special, "x" * 70]
    for _ in range(3000):
        text = "".join(rng.choices(pool, k=rng.randint(0, 12)))
        assert encoder.encode(text) == np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
    assert np.frombuffer(encoder.encode("hello <|endoftext|> world"), "<u4").tolist() == [3306, 49407, 1002]


def test_encoder_remembers_within_bounds(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    encoder, rng = packing.Encoder(packing.tokenizer_path()), random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice("abcdefgh") + rng.choice("ijkl") + rng.choice(",. ") for _ in range(rng.choice((3, 30, 200))))
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(encoder.before) <= 40 + 300


def test_packing_deals_copies_evenly(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 7, id) AS doc_id", "if(id < 2000, 'a b c', concat('t ', id)) AS text")
    got = packing.pack(rows, group_docs=100).collect()
    assert len(got) == 3000
    groups = Counter(r["sequence_id"] % 30 for r in got)
    assert len(groups) == 30 and max(groups.values()) < 200


def test_toxicity_learns_words_and_beginnings(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        words = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(60)]
        if i % 5 == 0:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vilething", "vileness", "vilemost"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.held_out()
    model = toxicity.fit_on(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    got = toxicity.score(frame, model).where(held).collect()
    assert len(got) > 100 and all(r["predicted"] == r["toxic"] for r in got)
    assert all(r["evidence_ids"] for r in got if r["toxic"])
    odd = spark.createDataFrame([(None, None, 0.0), (1, "", 1.0), (1, "vilegood " * 5000, None)], "doc_id long, text string, score double")
    scores = [r["score"] for r in toxicity.score(odd, model).orderBy("text").collect()]
    assert scores[0] == scores[1] < 0.1 and scores[2] > 0.7


def test_block_index_is_exact():
    rng = random.Random(9)
    terms = {f"=t{i}": rng.uniform(0.5, 4) for i in range(40)}
    examples = [toxicity.Example(i, i % 2, {f"t{rng.randrange(40)}": rng.randint(1, 5) for _ in range(4)}, 10) for i in range(500)]
    index = toxicity.Index(examples, terms)
    by_id = {e.id: index.vector(e.words)[0] for e in examples}
    for _ in range(50):
        v = index.vector({f"t{rng.randrange(40)}": 1 for _ in range(3)})[0]
        all_of_them = sorted((sum(w * by_id[i].get(t, 0) for t, w in v.items()) for i in by_id), reverse=True)[: toxicity.NEIGHBOURS]
        found = [c for c, _ in index.nearest(v)]
        assert np.allclose(found, [c for c in all_of_them if c > 0])


def test_empty_tables(spark, empty):
    listed = spark.createDataFrame([], "canonical string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert exact_dedup.mark(empty).count() == exact_dedup.deduplicate(empty).count() == 0
    assert quality.judge(empty).count() == sharding.place(empty).count() == mixing.mix(empty).count() == 0
    assert url_filter.judge(empty.selectExpr("doc_id page_id", "text url"), listed).count() == 0
    assert html_main.extract(empty.withColumnRenamed("source", "html")).count() == 0
    assert repeats.remove_repeats(empty).count() == packing.pack(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == simhash.deduplicate(empty).count() == 0
    model = toxicity.fit_on(empty, labels)
    assert toxicity.score(empty, model).count() == 0
