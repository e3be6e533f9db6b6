"""Exact duplicates by progressive refinement, in DataFrame operations only.

Documents are grouped by byte length, then by a hash of their first characters,
then by a hash of the whole text.  Each step leaves the values that occur twice
or more in a Bloom filter of fixed size, so the next step hashes only documents
whose group may survive; a false hit costs one more hash and is removed by the
exact grouping of the last step.

Defined cases: a null text counts as empty; of equal texts the row with the
largest id stays (null ids are smaller than all others); of rows equal in id and
text one stays.  Other columns are carried along; columns named as the results
are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, bloom_hits, bloom_of, clashing, skew_join, stage

PREFIX_CHARS = 64
RESULTS = ("keep_id", "group_size", "kept", "text_sha256")


def _text(col: str):
    return F.coalesce(F.col(col), F.lit(""))


def _prefix(col: str):
    return F.xxhash64(ascii_lower(F.substring(_text(col), 1, PREFIX_CHARS)))


def full_hash(col: str):
    return F.sha2(ascii_lower(_text(col)), 256)


def suspects(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_suspect``: false where the text is surely the only one of its kind."""
    size = F.octet_length(_text(text))
    lengths = docs.select(size.alias("size")).groupBy("size").count().where("count > 1").select("size")
    by_length = bloom_hits(docs, [size], bloom_of(lengths), "_long_enough")
    heads = (
        by_length.where("_long_enough")
        .select(size.alias("size"), _prefix(text).alias("head"))
        .groupBy("size", "head").count().where("count > 1").select("size", "head")
    )
    heads = stage(bloom_of(heads))
    return bloom_hits(docs, [size, _prefix(text)], heads, "_suspect")


def copy_groups(marked: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text that occurs twice or more, from the output of :func:`suspects`."""
    return (
        marked.where("_suspect")
        .groupBy(full_hash(text).alias("text_sha256"))
        .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )


def _joined(docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows that are surely single, and the others with their group."""
    docs = clashing(docs, RESULTS)
    marked = suspects(docs, text)
    groups = stage(copy_groups(marked, id_col, text))
    single = marked.where("not _suspect").drop("_suspect")
    rest = marked.where("_suspect").drop("_suspect").withColumn("text_sha256", full_hash(text))
    rows = groups.agg(F.sum("group_size")).first()[0] or 0
    rest = skew_join(rest, groups, "text_sha256", "group_size", rows, F.col(id_col))
    lone = F.col("group_size").isNull()
    rest = rest.withColumn("keep_id", F.when(lone, F.col(id_col)).otherwise(F.col("keep_id")))
    return single, rest.withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))


def _one_row(candidates: DataFrame, id_col: str) -> DataFrame:
    """``_first``: the row is the first of those with this text and id, the same on every run."""
    plain = [f.name for f in candidates.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    order = Window.partitionBy("text_sha256", id_col).orderBy(F.xxhash64(*plain))
    return candidates.withColumn("_first", F.row_number().over(order) == 1)


def mark(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``."""
    single, rest = _joined(docs, id_col, text)
    single = single.withColumns(
        {"text_sha256": full_hash(text), "keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    )
    stays = F.col(id_col).eqNullSafe(F.col("keep_id")) & F.col("_first")
    rest = _one_row(rest, id_col).withColumn("kept", stays).drop("_first")
    return single.unionByName(rest)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with all their own columns.  Texts of single rows are not shuffled."""
    aside = {c: f"_own_{c}" for c in docs.columns if c.lower() in RESULTS}
    single, rest = _joined(docs.withColumnsRenamed(aside), id_col, text)
    rest = rest.where(F.col(id_col).eqNullSafe(F.col("keep_id")))
    rest = _one_row(rest, id_col).where("_first")
    own = [F.col(aside.get(c, c)).alias(c) for c in docs.columns]
    return single.select(own).unionByName(rest.select(own))
