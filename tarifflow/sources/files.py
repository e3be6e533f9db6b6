"""Content folders: stored text files, the metadata document, inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..schemas import METADATA_ENTRY

# Bytes of small files that one partition reads.
PACK_BYTES = 64 << 20
_PACKED = "provider STRING, format STRING, content STRING, file_size BIGINT, file_time TIMESTAMP"
_NAME = r"^(.*)_((?!prior\.)[^_]+)(_prior)?\.txt$"


def load_content_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``{provider}_{format}[_prior].txt``: provider, format,
    is_prior, content (newlines as a text-mode read gives them)."""
    files = (
        spark.read.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", "*.txt")
        .load(folder)
        .select(F.col("value").alias("_raw"), F.col("_metadata.file_name").alias("_name"))
    )
    name = F.expr("try_url_decode(_name)")
    return files.withColumn("_name", F.coalesce(name, "_name")).select(
        F.regexp_extract("_name", _NAME, 1).alias("provider"),
        F.regexp_extract("_name", _NAME, 2).alias("format"),
        (F.regexp_extract("_name", _NAME, 3) != "").alias("is_prior"),
        F.expr(text.read_text_sql("_raw")).alias("content"),
    )


def write_content_files(texts: DataFrame, folder: str) -> None:
    """One text file per (provider, format), in folders named after them.

    Spark escapes what a path cannot hold, so any name comes back as it was; an empty name
    comes back as null.  Rows must be unique; what the folder held is replaced.  A file costs
    some 20 ms to make and find again: for many texts use :func:`write_content_packs`.
    """
    rows = texts.select("provider", "format", "content")
    rows.write.mode("overwrite").partitionBy("provider", "format").text(folder)


def load_content_folders(spark: SparkSession, folder: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The files of :func:`write_content_files`, whole, with their size and time.

    Small files are packed: partitions are merged, without a shuffle, until each holds
    about ``pack_bytes``, but never to fewer than there are cores.
    """
    files = (
        spark.read.schema("value STRING, provider STRING, format STRING")
        .format("text")
        .option("wholetext", True)
        .load(folder)
        .select("provider", "format", "value", F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("file_time"))
    )
    total = files.agg(F.sum("file_size")).first()[0] or 0
    packed = files.coalesce(max(spark.sparkContext.defaultParallelism, -(-total // pack_bytes)))
    # The writer ends every file with one line end of its own.
    content = text.read_text_sql("regexp_replace(value, '\\n\\\\z', '')")
    return packed.select("provider", "format", F.expr(content).alias("content"), "file_size", "file_time")


def write_content_packs(texts: DataFrame, folder: str) -> None:
    """Texts under their (provider, format), many to a file, for more texts than a file
    system should hold files.

    A row stands for one text file, with its size in bytes and its time; a null text is
    an empty one.  Any name comes back as it was; what the folder held is replaced.
    """
    content = F.coalesce("content", F.lit(""))
    rows = texts.select(
        "provider", "format", content.alias("content"),
        F.octet_length(content).cast("bigint").alias("file_size"), F.current_timestamp().alias("file_time"),
    )
    rows.write.mode("overwrite").option("compression", "zstd").parquet(folder)


def load_content_packs(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of :func:`write_content_packs`, as :func:`load_content_folders` gives them."""
    stored = spark.read.schema(_PACKED).parquet(folder)
    return stored.withColumn("content", F.expr(text.read_text_sql("content")))


def load_content(spark: SparkSession, folder: str, metadata: DataFrame, folders: bool = False, packs: bool = False) -> DataFrame:
    """The content each metadata entry lists; a missing file reads as empty.  ``folders``
    says that the files are those of :func:`write_content_files`, ``packs`` that they are
    those of :func:`write_content_packs`."""
    wanted = metadata.where("content_files IS NOT NULL").select(
        F.col("provider_name").alias("provider"), F.explode("content_files").alias("format", "file")
    )
    if packs:
        stored = load_content_packs(spark, folder)
    elif folders:
        stored = load_content_folders(spark, folder)
    else:
        stored = load_content_files(spark, folder).where("NOT is_prior").drop("is_prior")
    return (
        wanted.join(stored, ["provider", "format"], "left")
        .withColumn("content", F.coalesce("content", F.lit("")))
    )


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A metadata document file as rows; an absent one has no entries."""
    empty = spark.range(0).select(F.lit("").alias("value"))
    try:
        docs = spark.read.format("text").option("wholetext", True).load(path)
    except Exception as problem:  # only a missing path may pass as "no entries"
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        docs = empty
    return parse_metadata(docs)


def parse_metadata(docs: DataFrame, column: str = "value") -> DataFrame:
    """Metadata documents (each one object keyed by provider) as rows in stored
    order (``ord``); other columns are kept.  An unreadable one has no entries."""
    schema = f"MAP<STRING, STRUCT<{_colons(METADATA_ENTRY)}>>"
    kept = [c for c in docs.columns if c != column]
    entries = docs.select(*kept, F.from_json(column, schema).alias("_m"))
    rows = entries.select(*kept, F.posexplode(F.map_entries("_m")).alias("ord", "e"))
    return rows.select(
        *kept,
        F.col("ord").cast("bigint").alias("ord"),
        F.coalesce("e.value.provider_name", "e.key").alias("provider_name"),
        *[F.col(f"e.value.{c}").alias(c) for c in _names(METADATA_ENTRY) if c not in ("provider_name", "success")],
        F.expr("coalesce(e.value.success = 'true', false)").alias("success"),
    )


def file_inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Name, size and modification time of stored files; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "length", "modificationTime")
        .withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    )


def _names(ddl: str) -> list[str]:
    return [part.split()[0] for part in _split(ddl)]


def _colons(ddl: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in _split(ddl))


def _split(ddl: str) -> list[str]:
    import re

    return re.split(r", (?=[a-z_]+ [A-Z])", ddl)
