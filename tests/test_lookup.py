import json

from tarifflow.operators import lookup as lk
from tarifflow.sources import files as fl

# Three providers on one domain, as found in practice; one null title, one failure.
DOCUMENT = {
    "cloud": {"provider_name": "cloud", "url": "https://www.cloud.example/inference", "domain": "www.cloud.example",
              "scraped_at": "2026-08-18T00:30:10.878587", "formats": ["markdown", "html"], "success": "true",
              "content_files": {"markdown": "cloud_markdown.txt", "html": "cloud_html.txt"},
              "content_lengths": {"markdown": 2083, "html": 1547}, "truncated": False, "truncated_formats": [],
              "title": "Inference • API", "description": "d", "content_hash": "3c", "content_changed": False},
    "cloud_docs": {"provider_name": "cloud_docs", "url": "https://docs.cloud.example/a", "domain": "docs.cloud.example",
                   "scraped_at": "2026-08-18T00:30:11", "success": "true", "content_files": {"markdown": "cloud_docs_markdown.txt"},
                   "title": None, "content_changed": True, "previous_scraped_at": "2026-08-17T00:00:00"},
    "cloud_models": {"provider_name": "cloud_models", "url": "https://docs.cloud.example/b", "domain": "docs.cloud.example",
                     "scraped_at": "2026-08-18T00:30:12", "success": "false", "error": "timeout"},
}


def folder(tmp_path):
    (tmp_path / "scraped_metadata.json").write_text(json.dumps(DOCUMENT, indent=2))
    (tmp_path / "cloud_markdown.txt").write_bytes("A $1.00\r\nB".encode())
    (tmp_path / "cloud_markdown_prior.txt").write_text("A $0.90")
    (tmp_path / "cloud_html.txt").write_text("x" * 3000)
    return str(tmp_path)


def test_metadata_document_keeps_order_and_nulls(spark, tmp_path):
    where = folder(tmp_path)
    rows = fl.load_metadata(spark, f"{where}/scraped_metadata.json").orderBy("ord").collect()
    assert [(r.ord, r.provider_name, r.success) for r in rows] == [(0, "cloud", True), (1, "cloud_docs", True), (2, "cloud_models", False)]
    assert rows[0].content_lengths == {"markdown": 2083, "html": 1547} and rows[0].title == "Inference • API"
    assert rows[1].title is None and rows[1].content_changed and rows[2].error == "timeout"


def test_missing_or_broken_metadata_is_empty(spark, tmp_path):
    (tmp_path / "broken.json").write_text('{"a": {')
    assert fl.load_metadata(spark, str(tmp_path / "broken.json")).count() == 0
    assert fl.load_metadata(spark, str(tmp_path / "absent.json")).count() == 0


def test_content_files(spark, tmp_path):
    where = folder(tmp_path)
    rows = {(r.provider, r.format, r.is_prior): r.content for r in fl.load_content_files(spark, where).collect()}
    assert rows[("cloud", "markdown", False)] == "A $1.00\nB" and rows[("cloud", "markdown", True)] == "A $0.90"
    meta = fl.load_metadata(spark, f"{where}/scraped_metadata.json")
    content = {(r.provider, r.format): r.content for r in fl.load_content(spark, where, meta).collect()}
    assert content[("cloud_docs", "markdown")] == "" and len(content) == 3
    listed = {r.file_name: r.length for r in fl.file_inventory(spark, where, "*.txt").collect()}
    assert listed == {"cloud_markdown.txt": 10, "cloud_markdown_prior.txt": 7, "cloud_html.txt": 3000}


TEXTS = [("a/b %41= é", "html", "x\r\ny\n"), ("a/b %41= é", "markdown", "# é"), ("none", "html", None), ("empty", "html", "")]


def test_content_packs_hold_many_texts_in_few_files(spark, tmp_path):
    """Files grow with the bytes, not with the number of texts; names and texts come back."""
    where = str(tmp_path / "packs")
    many = TEXTS + [(f"p{i}", "html", f"text {i}") for i in range(500)]
    texts = spark.createDataFrame(many, "provider STRING, format STRING, content STRING").coalesce(2)
    fl.write_content_packs(texts, where)
    assert len(list((tmp_path / "packs").rglob("*.parquet"))) <= 2
    rows = {(r.provider, r.format): (r.content, r.file_size, r.file_time) for r in fl.load_content_packs(spark, where).collect()}
    assert len(rows) == len(many) and all(time for _, _, time in rows.values())
    assert rows["a/b %41= é", "html"][:2] == ("x\ny\n", 5) and rows["a/b %41= é", "markdown"][:2] == ("# é", 4)
    assert rows["none", "html"][:2] == rows["empty", "html"][:2] == ("", 0)
    meta = spark.createDataFrame([("p7", {"html": "p7"}), ("gone", {"html": "g"}), ("none", {"html": "n"})], "provider_name STRING, content_files MAP<STRING, STRING>")
    got = {r.provider: (r.content, r.file_size) for r in fl.load_content(spark, where, meta, packs=True).collect()}
    assert got == {"p7": ("text 7", 6), "gone": ("", None), "none": ("", 0)}


def test_content_folders_hold_one_file_per_text(spark, tmp_path):
    where = str(tmp_path / "folders")
    fl.write_content_files(spark.createDataFrame(TEXTS[:2], "provider STRING, format STRING, content STRING"), where)
    rows = {(r.provider, r.format): r.content for r in fl.load_content_folders(spark, where).collect()}
    assert rows == {("a/b %41= é", "html"): "x\ny\n", ("a/b %41= é", "markdown"): "# é"}
    assert len(list((tmp_path / "folders").rglob("*.txt"))) == 2


def test_load_content_query_makes_no_file_per_page(spark, tmp_path, monkeypatch):
    from tarifflow.plans import snapshot_queries as sq

    pages = spark.range(1, 401).selectExpr("id AS page_id", "concat('https://x.example/', id) AS url", "concat('<p>', id, '</p>') AS html")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(sq, "shared_path", lambda spark, kind: f"{tmp_path}/{kind}")
    rows = {r.provider: (r.content, r.has_file) for r in sq.load_content(spark, str(tmp_path)).collect()}
    assert len(rows) == 400 and rows["a/b %41=7 é"] == ("<p>7</p>", True) and rows["a/b %41=13 é"] == ("", False)
    stored = [p for p in (tmp_path / "content").rglob("*") if p.suffix in (".txt", ".parquet")]
    assert 0 < len(stored) <= 2 * spark.sparkContext.defaultParallelism


def test_resolve_by_name_url_domain(spark, tmp_path):
    meta = fl.load_metadata(spark, f"{folder(tmp_path)}/scraped_metadata.json")
    asked = ["cloud", "https://www.cloud.example/inference", "www.cloud.example", "docs.cloud.example", "Cloud", "nope"]
    ids = spark.createDataFrame([(a,) for a in asked], "identifier STRING")
    got = {r.identifier: (r.provider, r.message) for r in lk.resolve_provider(ids, meta).collect()}
    assert [got[a][0] for a in asked] == ["cloud", "cloud", "cloud", "cloud_docs", None, None]
    assert got["nope"][1] == "There's no saved information related to identifier 'nope'."
    assert got["cloud"][1] is None


def test_extract_info_caps_again_on_reading(spark, tmp_path):
    where = folder(tmp_path)
    meta = fl.load_metadata(spark, f"{where}/scraped_metadata.json")
    ids = spark.createDataFrame([("cloud",), ("nope",)], "identifier STRING")
    rows = {(r.identifier, r.format): r for r in lk.extract_info(ids, meta, fl.load_content(spark, where, meta), 2000).collect()}
    html = rows[("cloud", "html")]
    assert html.content == "x" * 2000 + "\n\n[...content truncated: showing 2,000 of 3,000 characters...]"
    assert (html.original_length, html.returned_length) == (3000, len(html.content))
    assert rows[("cloud", "markdown")].original_length is None
    assert rows[("nope", None)].message and rows[("nope", None)].provider is None


def test_text_capped_twice_keeps_the_stored_length(spark):
    from pyspark.sql import functions as F
    from tarifflow.functions import text as X

    once = spark.createDataFrame([("y" * 390_000,)], "t STRING").select(X.truncate_guard("t")["content"].alias("t"))
    twice = once.select(X.truncate_guard("t").alias("t")).select("t.*").first()
    assert twice.original_length == 50_065 and twice.was_truncated
    assert twice.content.endswith("showing 50,000 of 50,065 characters...]")
