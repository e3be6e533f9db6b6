"""Aggregation forms of "pick one row per group".

``row_number() = 1`` sorts each whole group inside one task.  ``min_by`` /
``max_by`` give the same row and combine on the map side, so a group with a third
of the rows sends one row per map task instead of all of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def last_per(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _pick(df, keys, order, F.max_by)


def _pick(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    chosen = pick(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(chosen.alias("_row")).select(*keys, "_row.*").select(*df.columns)
