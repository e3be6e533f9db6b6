"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in a fixed shuffled order, are cut into blocks of ``block``
documents.  A source with ``a`` of ``quantum`` shares releases its block ``j`` at
slot ``floor(j * quantum / a)`` and must have it placed before slot
``ceil((j + 1) * quantum / a)``.  Serving the released block with the earliest
deadline meets all deadlines, so at every slot each source is less than one block
away from its share.  As the windows repeat every ``quantum`` slots, so does the
schedule: one period of fixed length is computed and every block's slot follows
from it by arithmetic.

The largest sources are scheduled one by one, at most TASKS of them with GROUPS groups
that the others are dealt to.  A group is scheduled like a source of its members' weight;
inside it documents come in the order of their own deadlines, so each member is about one
document away from its share of the group.

Nothing is dropped.  The mixture is as long as the source that is scarcest in it
relative to its weight needs to appear once in full; the others start again from
their first document (``epoch`` 1, 2, ...), as often as their weight asks for.

Defined cases: a null source is a source of its own; null and repeated ids and
repeated rows are documents like any other; a weight for a source without
documents is left out and the rest scaled up; a source without a weight is an
error, as leaving it out would lose documents.  Columns are carried along, those
named as the results are replaced.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clashing, gapless_rank, stage

BLOCK = 16
QUANTUM = 10_000
# Sources and groups that are scheduled by themselves; this bounds what the driver holds.
TASKS = 5_000
GROUPS = 1_000
# Weights are the document shares to this power, unless given.
TEMPERATURE = 0.7
RESULTS = ("epoch", "block", "slot", "position")


# A source (its name, or null), or a group of small sources by its number.
Key = str | int | None


def _place(key: Key) -> tuple[int, str]:
    return (0, "") if key is None else (1, key) if isinstance(key, str) else (2, f"{key:09d}")


def shares(weights: Mapping[Key, float], quantum: int = QUANTUM) -> dict[Key, int]:
    """Weights as whole shares of ``quantum``, at least 1 each (largest remainders)."""
    total = sum(weights.values())
    spare = quantum - len(weights)
    exact = {s: spare * w / total for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (int(exact[s]) - exact[s], _place(s)))
    for s in order[: quantum - sum(out.values())]:
        out[s] += 1
    return out


def period(share: Mapping[Key, int]) -> dict[Key, list[int]]:
    """Slots of each source's blocks within one period, earliest deadline first."""
    quantum = sum(share.values())
    slots: dict[Key, list[int]] = {s: [] for s in share}
    waiting = [(0, i, s) for i, s in enumerate(share)]
    ready: list[tuple[int, int, Key]] = []
    for slot in range(quantum):
        while waiting and waiting[0][0] <= slot:
            _, i, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[s]) + 1) * quantum // share[s]), i, s))
        _, i, s = heapq.heappop(ready)
        slots[s].append(slot)
        if len(slots[s]) < share[s]:
            heapq.heappush(waiting, (len(slots[s]) * quantum // share[s], i, s))
    return slots


def _weights(sizes: Mapping[str | None, int], weights: Mapping[str | None, float] | None) -> dict[str | None, float]:
    if weights is None:
        return {s: n**TEMPERATURE for s, n in sizes.items()}
    if absent := [s for s in sizes if not weights.get(s)]:
        raise ValueError(f"sources without a weight: {absent[:5]}")
    return {s: weights[s] for s in sizes}


def _members(small: DataFrame, weights: Mapping[str | None, float] | None, groups: int) -> DataFrame:
    """Small sources with their group, weight ``_w`` and the group's weight ``_sum``.

    Weights are whole millionths, so sums do not depend on the order of rows."""
    if weights is None:
        weight = F.pow(F.col("_docs").cast("double"), F.lit(TEMPERATURE))
    else:
        given = small.sparkSession.createDataFrame(list(weights.items()), "_given string, _weight double")
        small = small.join(given, F.col("_source").eqNullSafe(F.col("_given")), "left").drop("_given")
        weight = F.when(F.col("_weight") > 0, F.col("_weight")).otherwise(F.raise_error(F.lit("a source without a weight")).cast("double"))
    small = small.withColumn("_w", F.greatest(F.lit(1).cast("long"), F.round(weight * 1e6).cast("long"))).drop("_weight")
    small = small.withColumn("_group", F.pmod(F.xxhash64("_source"), F.lit(groups)).cast("int"))
    sums = small.groupBy("_group").agg(F.sum("_w").alias("_sum"))
    return stage(small.join(F.broadcast(sums), "_group"))


def _one_by_one(docs: DataFrame, sources: DataFrame, source: str, id_col: str, count: int) -> DataFrame:
    """Documents of single sources with their place ``_at`` in the source's stream."""
    rows = docs.join(F.broadcast(sources), F.col(source).cast("string").eqNullSafe(F.col("_name"))).drop("_name")
    rows = gapless_rank(rows, "_no", "_spot", [F.col(id_col)], "_rank", count)
    rows = rows.withColumn("epoch", F.explode(F.expr("sequence(0L, (_length - 1 - _rank) div _docs)")))
    return rows.withColumn("_at", F.col("_rank") + F.col("epoch") * F.col("_docs")).drop("_rank", "_docs")


def _in_groups(docs: DataFrame, members: DataFrame, groups: DataFrame, source: str, id_col: str, count: int) -> DataFrame:
    """Documents of small sources with their place ``_at`` in the group's stream.

    A member of weight w in a group of weight W owes its i-th document (from 0) by place
    (i + 1) * W / w, and offers as many as the group's length can ask it for.
    """
    known = members.join(F.broadcast(groups), F.col("_group") == F.col("_name")).drop("_name", "_group")
    rows = docs.join(known, F.col(source).cast("string").eqNullSafe(F.col("_source")))
    rows = rows.withColumn("_member", F.when(F.col("_source").isNull(), "").otherwise(F.concat(F.lit("s"), "_source"))).drop("_source")
    rows = gapless_rank(rows, "_member", "_spot", [F.col(id_col)], "_rank", count)
    asked = "CAST(ceil(_length * (_w / _sum)) AS BIGINT)"
    rows = rows.withColumn("epoch", F.explode(F.expr(f"sequence(0L, ({asked} - _rank) div _docs)")))
    rows = rows.withColumn("_i", F.col("_rank") + F.col("epoch") * F.col("_docs"))
    # No deadline is beyond three lengths: a group's length covers each member once.
    due = F.expr("(_i + 1) * (_sum / _w) / (3 * _length + 1)")
    rows = rows.withColumn("_spot", (due * float(1 << 62)).cast("long") * 2)
    rows = gapless_rank(rows, "_no", "_spot", ["_member", "_i"], "_at", 2 * count).where("_at < _length")
    return rows.drop("_member", "_rank", "_i", "_w", "_sum", "_docs")


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    *,
    block: int = BLOCK,
    quantum: int = QUANTUM,
    source: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
    tasks: int = TASKS,
    groups: int = GROUPS,
) -> DataFrame:
    """``docs`` repeated and placed: ``epoch``, ``block`` (of its source or group), ``slot``
    and ``position`` (from 0, without gaps) in the mixture."""
    spark = docs.sparkSession
    docs = clashing(docs, RESULTS)
    counted = stage(docs.groupBy(F.col(source).cast("string").alias("_source")).agg(F.count(F.lit(1)).alias("_docs")))
    n_sources, count = counted.agg(F.count(F.lit(1)), F.coalesce(F.sum("_docs"), F.lit(0))).first()
    single = counted if n_sources <= tasks else counted.orderBy(F.desc("_docs"), "_source").limit(tasks - groups)
    rows = single.collect()  # at most ``tasks``
    sizes: dict[Key, int] = {r[0]: r[1] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or ""))}
    weight: dict[Key, float] = dict(_weights(sizes, weights))
    members = None
    if n_sources > tasks:
        single = spark.createDataFrame([(s,) for s in sizes], "_known string")
        small = counted.join(F.broadcast(single), F.col("_source").eqNullSafe(F.col("_known")), "left_anti")
        members = _members(small, weights, groups)
        need = F.max(F.expr("CAST(ceil(_docs * (_sum / _w)) AS BIGINT)"))
        for g, total, most in members.groupBy("_group").agg(F.first("_sum"), need).orderBy("_group").collect():  # at most ``groups``
            sizes[g], weight[g] = most, total / 1e6
    share = shares(weight, max(quantum, 2 * len(sizes))) if sizes else {}
    slots, total = period(share), sum(share.values())
    end = 0
    for s, n in sizes.items():
        last = -(-n // block) - 1
        end = max(end, last // share[s] * total + slots[s][last % share[s]] + 1)
    info, plan = [], []
    for no, (s, n) in enumerate(sizes.items()):
        blocks = end // total * share[s] + sum(x < end % total for x in slots[s])
        info.append((no, s, n, share[s], blocks * block))
        plan += [(no, j, slot) for j, slot in enumerate(slots[s])]
    # Tables of a fixed bound: ``tasks`` rows and one period of slots.
    alone = [x for x in info if not isinstance(x[1], int)]
    sources = spark.createDataFrame(alone, "_no int, _name string, _docs long, _share long, _length long")
    slot_of = spark.createDataFrame(plan, "_no int, _turn long, _slot long")
    docs = docs.withColumn("_spot", F.xxhash64(F.col(id_col), F.col(text) if text in docs.columns else F.lit(0)))
    placed = _one_by_one(docs, sources, source, id_col, count)
    if members is not None:
        grouped = spark.createDataFrame([(no, g, sh, n) for no, g, _, sh, n in info if isinstance(g, int)], "_no int, _name int, _share long, _length long")
        placed = placed.unionByName(_in_groups(docs, members, grouped, source, id_col, count))
    placed = placed.withColumn("block", F.expr(f"_at div {block}")).withColumn("_turn", F.expr("block % _share"))
    placed = placed.join(F.broadcast(slot_of), ["_no", "_turn"])
    slot = F.expr(f"(block div _share) * {total} + _slot")
    return placed.withColumn("slot", slot).withColumn("position", F.expr(f"slot * {block} + _at % {block}")).drop(
        "_no", "_turn", "_spot", "_share", "_length", "_at", "_slot"
    )
