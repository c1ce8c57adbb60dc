"""Sharding by histogram sort.

Rows are ordered by (hash of the content, row id), so equal contents lie together.
Splitters that cut this order into shards of near equal bytes are found by rounds:
each counts the exact bytes between the probes of all partitions and draws new
probes from the rows that lie beside a wanted boundary, until every splitter is
within the tolerance or stands between two neighbouring rows.  Rows are then
exchanged once.  Only counts between probes reach the driver, a few for each cell.

Defined cases: null contents count as empty; a null id sorts first; rows equal in
content and id are never parted, so a boundary inside them stays where they end;
an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .common import longs, places_before

SHARDS = 8
#: Share of a shard's bytes by which a boundary may be off.
TOLERANCE = 0.001
#: Probes drawn beside each wanted boundary in a round.
DRAWS = 6
#: Rows of one cell, the part of a shard that one task orders.
CELL_ROWS = 1_000_000
LEAST = -(1 << 63)


def _slot(keys: list[tuple[int, int]]) -> Column:
    """How many of the sorted ``keys`` are at or before the row."""
    return places_before(keys, F.struct(F.col("_h").alias("col1"), F.col("_k").alias("col2")))


def _splitters(rows: DataFrame, targets: list[float], slack: list[float]) -> list[tuple[int, int]]:
    """For each target the key at which the bytes before it are nearest."""
    probes: list[tuple[int, int]] = []
    for turn in range(200):
        seeds = [F.expr(f"min_by(struct(_h, _k), xxhash64(_h, _k, {turn * DRAWS + i}))").alias(f"d{i}") for i in range(DRAWS)]
        got = {r["_i"]: r for r in rows.groupBy(_slot(probes).alias("_i")).agg(F.sum("_b").alias("b"), F.min(F.struct("_h", "_k")).alias("lo"), F.max(F.struct("_h", "_k")).alias("hi"), *seeds).take(1 << 24)}
        below, total = [], 0
        for i in range(len(probes) + 1):
            total += got[i]["b"] if i in got else 0
            below.append(total)  # bytes before probe i
        best, fresh = [], set()
        for want, give in zip(targets, slack, strict=True):
            i = bisect_right(below, want)  # the interval in which the target lies
            sides = [(abs(below[j] - want), probes[j]) for j in (i - 1, i) if 0 <= j < len(probes)]
            near = min(sides, default=(float("inf"), None))
            r = got.get(i)
            if near[0] > give and r is not None:
                known = set(probes)
                for key in {(x[0], x[1]) for x in (r["lo"], r["hi"], *(r[f"d{k}"] for k in range(DRAWS)))} - known:
                    fresh.add(key)
            best.append(near[1])
        if not fresh:
            return [x if x is not None else (LEAST, LEAST) for x in best]
        wanted = {x for x in best if x is not None}
        edges = {probes[j] for want in targets for j in (bisect_right(below, want) - 1, bisect_right(below, want)) if 0 <= j < len(probes)}
        probes = sorted(wanted | edges | fresh)
    raise ValueError("splitters did not settle")


def histogram_shards(df: DataFrame, content: Column, row_id: Column, size: Column, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``df`` with ``shard`` and ``slot`` (gapless from 0 in each shard) appended.

    The added columns replace columns of these names.
    """
    own = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = cut(
        df.select(
            F.struct(*own).alias("_row"),
            F.xxhash64(F.coalesce(content.cast("string"), F.lit(""))).alias("_h"),
            F.coalesce(row_id.cast("long"), F.lit(LEAST).cast("long")).alias("_k"),
            size.cast("long").alias("_b"),
        )
    )
    keys = rows.select("_h", "_k", "_b")
    n, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("_b"), F.lit(0))).first()
    parts = max(8, -(-n // (shards * CELL_ROWS)))
    cells = shards * parts
    targets = [total * j / cells for j in range(1, cells)]
    slack = [total / shards * tolerance if j % parts == 0 else total / cells / 4 for j in range(1, cells)]
    found = _splitters(keys, targets, slack) if n else []
    marks = [found[j - 1] for j in range(parts, cells, parts)] if n else []
    edges = sorted(set(found))
    slots = rows.withColumn("_cell", _slot(edges))
    held = {r["_cell"]: r["n"] for r in slots.groupBy("_cell").agg(F.count(F.lit(1)).alias("n")).take(1 << 24)}
    shard_of, before, gone = [], [], {}
    for i in range(len(edges) + 1):
        s = sum(1 for m in marks if i and m <= edges[i - 1])
        shard_of.append(s)
        before.append(gone.get(s, 0))
        gone[s] = gone.get(s, 0) + held.get(i, 0)
    w = W.partitionBy("_cell").orderBy("_h", "_k", "_b")
    at = lambda values: F.get(longs(values), F.col("_cell"))
    return slots.select("_row.*", at(shard_of).cast("int").alias("shard"), (at(before) + F.row_number().over(w) - 1).cast("long").alias("slot"))


def document_shards(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Shards of documents by the bytes of their texts plus one; equal texts lie together."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).cast("string").alias("_content"))
    return histogram_shards(rows, F.col("_content"), F.col("doc_id"), F.col("size"), shards, tolerance).drop("_content")
