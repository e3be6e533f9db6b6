"""Sharding by a k-d tree over document metadata.

The points of the tree are groups of equal texts, so copies share a shard.  A node
is split along the metadata dimension it is widest in, at the weighted median (for
an uneven number of shards: the matching quantile) of the bytes, until each leaf is
one shard and holds the target bytes.  Medians are found by histograms over all
points: every round a job sums bytes per (node, bucket) and the driver reads at
most BUCKETS sums per node to narrow the interval.

A group larger than HEAVY of a shard's target would make a median jump.  There are
at most shards / HEAVY of those; they are given to the emptiest shards first and
the medians leave room for them.  A group too large for that (more than a quarter of
a target) is cut into pieces by document.

Defined cases: a null text has no bytes (size 1); null metadata sorts first; ids are
only carried, so null and repeated ids and repeated rows are placed like any other
row.  Columns are carried along, those named as the results are replaced.  An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clashing, gapless_rank, skew_join, stage

SHARDS = 8
DIMENSIONS = ("lang", "source", "size")
HEAVY = 0.005
PIECE = 0.25
# Sums the driver reads per round, over all nodes of a level.
BUCKETS = 1 << 15
# A cut this close to the wanted bytes, as a share of a shard's target, is taken.
CLOSE = 0.0005
_COORD_BITS, _TIE_BITS = 20, 32
RESULTS = ("size", "shard", "slot")


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _coordinate(df: DataFrame, name: str) -> Column:
    """A number that sorts like the column: its value, or a string's first six bytes."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType):
        return F.coalesce(F.nanvl(F.col(name).cast("double"), F.lit(0.0)), F.lit(0.0))
    head = F.rpad(F.hex(F.substring(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def _spots(points: DataFrame, dims: int) -> DataFrame:
    """Each coordinate as an integer, scaled to its range, with ties spread by the key."""
    ends = points.agg(*[f(f"_c{d}") for d in range(dims) for f in (F.min, F.max)]).first()
    for d in range(dims):
        lo, hi = ends[2 * d] or 0.0, ends[2 * d + 1] or 0.0
        scaled = (F.col(f"_c{d}") - lo) / (hi - lo) * (2**_COORD_BITS - 1) if hi > lo else F.lit(0.0)
        tie = F.pmod(F.xxhash64(F.lit(d), "_key", "_piece"), F.lit(2**_TIE_BITS))
        points = points.withColumn(f"_s{d}", scaled.cast("long") * 2**_TIE_BITS + tie)
    return points.select("_key", "_piece", "_docs", "_bytes", *[f"_s{d}" for d in range(dims)])


def _narrowed(points: DataFrame, cuts: Mapping[int, dict]) -> None:
    """Find ``cut`` of each node: points below it hold about ``want`` bytes."""
    spark = points.sparkSession
    while todo := {n: c for n, c in cuts.items() if "cut" not in c}:
        buckets = max(256, BUCKETS // len(todo))
        for c in todo.values():
            c["step"] = max(1, -(-(c["hi"] - c["lo"] + 1) // buckets))
        table = spark.createDataFrame([(n, c["dim"], c["lo"], c["hi"], c["step"]) for n, c in todo.items()], "_node int, _dim int, _lo long, _hi long, _step long")
        rows = points.join(F.broadcast(table), "_node").withColumn("_spot", F.expr("element_at(_spots, _dim + 1)"))
        sums = rows.where("_spot between _lo and _hi").groupBy("_node", F.expr("(_spot - _lo) div _step").alias("b")).agg(F.sum("_bytes").alias("w"), F.count(F.lit(1)).alias("n"))
        found: dict[int, list] = {n: [] for n in todo}
        for r in sums.collect():
            found[r["_node"]].append((r["b"], r["w"], r["n"]))
        for n, c in todo.items():
            below = c["below"]
            for b, w, points_in in sorted(found[n]):
                if below + w >= c["want"]:
                    break
                below += w
            else:
                c["cut"] = c["hi"] + 1
                continue
            lo = c["lo"] + b * c["step"]
            if c["step"] == 1 or points_in == 1 or w <= c["close"]:
                c["cut"] = lo if c["want"] - below < below + w - c["want"] else lo + c["step"]
            c |= {"lo": lo, "hi": min(c["hi"], lo + c["step"] - 1), "below": below}


def _leaves(points: DataFrame, shards: int, room: Sequence[float], dims: int) -> DataFrame:
    """``points`` with ``shard``; shard ``s`` gets about ``room[s]`` bytes."""
    spark = points.sparkSession
    points = points.withColumn("_spots", F.array(*[f"_s{d}" for d in range(dims)])).withColumn("_node", F.lit(0))
    nodes, leaves = {0: (0, shards)}, {}
    while nodes:
        leaves |= {n: lo for n, (lo, hi) in nodes.items() if hi - lo == 1}
        nodes = {n: x for n, x in nodes.items() if x[1] - x[0] > 1}
        if not nodes:
            break
        ends = points.where(F.col("_node").isin(list(nodes))).groupBy("_node").agg(
            F.sum("_bytes").alias("w"), *[f(f"_s{d}").alias(f"{k}{d}") for d in range(dims) for k, f in (("lo", F.min), ("hi", F.max))]
        )
        seen, cuts = {r["_node"]: r for r in ends.collect()}, {}
        for n, (lo, hi) in nodes.items():
            if n not in seen:
                cuts[n] = {"dim": 0, "cut": 0}
                continue
            r, mid = seen[n], (lo + hi) // 2
            dim = max(range(dims), key=lambda d, r=r: (r[f"hi{d}"] - r[f"lo{d}"]) >> _TIE_BITS)
            part = sum(room[lo:mid]) / max(1e-9, sum(room[lo:hi]))
            cuts[n] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"], "below": 0, "want": r["w"] * part, "close": CLOSE * sum(room) / shards}
        _narrowed(points, cuts)
        table = spark.createDataFrame([(n, c["dim"], c["cut"]) for n, c in cuts.items()], "_node int, _dim int, _cut long")
        points = points.join(F.broadcast(table), "_node", "left").withColumn(
            "_node", F.expr("case when _dim is null then _node when element_at(_spots, _dim + 1) < _cut then 2 * _node + 1 else 2 * _node + 2 end")
        ).drop("_dim", "_cut")
        nodes = {m: x for n, (lo, hi) in nodes.items() for m, x in ((2 * n + 1, (lo, (lo + hi) // 2)), (2 * n + 2, ((lo + hi) // 2, hi)))}
    shard_of = spark.createDataFrame(list(leaves.items()), "_node int, shard int")
    return points.join(F.broadcast(shard_of), "_node")


def group_of(text: str = "text") -> Column:
    """Equal texts share it; should two texts ever do, they merely share a shard."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def place(
    docs: DataFrame,
    shards: int = SHARDS,
    dimensions: Sequence[str] = DIMENSIONS,
    *,
    id_col: str = "doc_id",
    text: str = "text",
    size: str | None = None,
    group: str | None = None,
) -> DataFrame:
    """``docs`` with ``size`` (bytes plus 1), ``shard`` and ``slot`` (from 0 within it).

    ``size`` and ``group`` name columns with precomputed values; then ``text`` is not read.
    """
    spark, dims = docs.sparkSession, len(dimensions)
    docs = docs.withColumns({"_size": F.col(size) if size else size_of(text), "_key": F.col(group) if group else group_of(text)})
    docs = clashing(docs, RESULTS).withColumnRenamed("_size", "size")
    coords = [_coordinate(docs, d) for d in dimensions]
    groups = stage(
        docs.groupBy("_key").agg(F.count(F.lit(1)).alias("_docs"), F.sum("size").alias("_bytes"), *[F.min(c).alias(f"_c{d}") for d, c in enumerate(coords)])
    )
    rows, total = groups.agg(F.sum("_docs"), F.sum("_bytes")).first()
    target = (total or 0) / shards
    # Groups in pieces: at most PIECE of a target each, by whole documents.
    pieces = F.greatest(F.lit(1), F.least(F.col("_docs"), F.ceil(F.col("_bytes") / F.lit(max(1.0, PIECE * target))))).cast("int")
    points = groups.withColumn("_pieces", pieces)
    points = points.withColumn("_piece", F.explode(F.expr("sequence(0, _pieces - 1)")))
    points = points.withColumn("_bytes", F.expr("_bytes div _pieces"))
    heavy = points.where(F.col("_bytes") > HEAVY * target).select("_key", "_piece", "_docs", "_bytes").collect()  # at most shards / HEAVY
    load, given = [0] * shards, []
    for r in sorted(heavy, key=lambda r: (-r["_bytes"], r["_key"], r["_piece"])):
        s = min(range(shards), key=lambda i: (load[i], i))
        load[s] += r["_bytes"]
        given.append((r["_key"], r["_piece"], r["_docs"], s))
    light = _spots(points.where(F.col("_bytes") <= HEAVY * target), dims)
    leaves = _leaves(light, shards, [max(1.0, target - x) for x in load], dims).select("_key", "_piece", "_docs", "shard")
    placed = leaves.unionByName(spark.createDataFrame(given, "_key long, _piece int, _docs long, shard int"))
    # One row per group: the shard of each of its pieces, in order.
    placed = placed.groupBy("_key").agg(F.max("_docs").alias("_docs"), F.sort_array(F.collect_list(F.struct("_piece", "shard"))).alias("_at"))
    out = skew_join(docs, stage(placed), "_key", "_docs", rows or 0, F.col(id_col))
    mine = F.pmod(F.xxhash64(F.lit(3), id_col), F.size("_at")).cast("int")
    out = out.withColumn("shard", F.element_at("_at", mine + 1)["shard"]).withColumn("_spot", F.xxhash64(F.lit(5), id_col, "_key"))
    out = gapless_rank(out, "shard", "_spot", [F.col(id_col)], "slot", rows or 0)
    return out.drop("_key", "_docs", "_at", "_spot")
