"""Building blocks shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarifflow.operators.ordered import stage

__all__ = ["UPPER", "LOWER", "ascii_lower", "bloom_hits", "bloom_of", "clashing", "gapless_rank", "set_aside", "skew_join", "stage"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A key with more than 1/HOT_SHARE of the rows is hot, so there are at most
# HOT_SHARE of them: the table of hot keys has a proven size.
HOT_SHARE = 1000
SALTS = 64
RANK_BUCKET_ROWS = 20_000
BLOOM_BLOCKS = 1 << 16
_WORDS = 8


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def clashing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns of these names, which an operator is about to add."""
    wanted = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in wanted])


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """(``df`` under plain inner names, inner name of each column, the columns as they were).

    Whatever names an operator adds, none of the caller's columns clashes with them.
    """
    inner = {c: f"own{i}_" for i, c in enumerate(df.columns)}
    return df.toDF(*inner.values()), inner, [F.col(new).alias(old) for old, new in inner.items()]


def skew_join(big: DataFrame, groups: DataFrame, key: str, size: str, rows: int, salt: Column) -> DataFrame:
    """Left join on ``key`` where ``groups`` has one row per key and its ``size``.

    Hot keys are dealt out by ``salt``: their single row in ``groups`` is repeated
    SALTS times and each row of ``big`` meets one of the repeats.
    """
    least = max(1000, rows // HOT_SHARE)
    hot = groups.where(F.col(size) >= least).select(F.col(key).alias("_hot_key"))
    big = (
        big.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
        .withColumn("_salt", F.when(F.col("_hot_key").isNotNull(), F.pmod(F.xxhash64(salt), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
        .drop("_hot_key")
    )
    salts = F.when(F.col(size) >= least, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return big.join(groups.withColumn("_salt", F.explode(salts)), [key, "_salt"], "left").drop("_salt")


def gapless_rank(df: DataFrame, group: str, spot: str, ties: Sequence[Column | str], name: str, rows: int) -> DataFrame:
    """Rank from 0 within ``group`` in the order of ``spot`` (an evenly spread long).

    A group may hold most of the rows: it is cut into ranges of ``spot`` of about
    RANK_BUCKET_ROWS rows, each ranked alone and moved by the rows before it.
    """
    bits = max(1, (max(1, rows) // RANK_BUCKET_ROWS).bit_length())
    df = df.withColumn("_range", F.shiftright(F.col(spot), 64 - bits))
    starts = df.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    within = Window.partitionBy(group, "_range").orderBy(spot, *ties)
    return (
        df.join(starts, [group, "_range"])
        .withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_range", "_start")
    )


def _masks(keys: Sequence[Column]) -> list[Column]:
    spread = F.xxhash64(F.lit(11), *keys)
    return [_bit(spread, i) for i in range(_WORDS)]


def _bit(spread: Column, i: int) -> Column:
    at = F.shiftright(spread, 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom_of(keys: DataFrame, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """Blocked Bloom filter of all columns of ``keys``: one row of 512 bits per block.

    It has at most ``blocks`` rows of 72 bytes whatever the number of keys; more
    keys raise the share of false hits, which callers remove with exact keys.
    """
    cols = [F.col(c) for c in keys.columns]
    rows = keys.select(F.pmod(F.xxhash64(*cols), F.lit(blocks)).alias("_block"), *[m.alias(f"_w{i}") for i, m in enumerate(_masks(cols))])
    return rows.groupBy("_block").agg(*[F.bit_or(f"_w{i}").alias(f"_w{i}") for i in range(_WORDS)])


def bloom_hits(df: DataFrame, keys: Sequence[Column], bloom: DataFrame, name: str, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """Add boolean ``name``: whether the filter may hold ``keys`` (never false for one it holds)."""
    masks = [f"_m{i}" for i in range(_WORDS)]
    df = df.withColumns({"_at": F.pmod(F.xxhash64(*keys), F.lit(blocks)), **dict(zip(masks, _masks(keys), strict=True))})
    df = df.join(F.broadcast(bloom), F.col("_at") == F.col("_block"), "left")
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(F.col(m)) == F.col(m))
    return df.withColumn(name, F.coalesce(hit, F.lit(False))).drop("_at", "_block", *masks, *[f"_w{i}" for i in range(_WORDS)])
