"""Merkle manifest of a table: places from bitmap ranks, levels from keyed slot arrays.

Leaves of a group ascend by id.  Their places are not found by sorting them: ids are set
in bitmaps, one word of 64 bits a row and only words that hold an id, merged by a
bitwise or before and after the exchange.  Over the words lies a directory of popcounts
in four levels (1024 words, then 65 536 children each), so one rank query - a join to the
id's own word and a bit count below it - gives a leaf its slot.  No directory node has
more than 65 536 children, whatever the ids.  Rows without an id come first and take
their digest's leading bits for an id in a bitmap of their own.

Slots are then cut into arrays of ``3**8``, keyed by group and slot range.  One round
reduces each array by eight levels, so ten thousand million leaves take three rounds of
ever smaller tables.  The way back hands every array the path above it once; each leaf's
proof, and its root folded from the leaf as it is seen now, are made inside its array.

Defined cases: every field may be null; a null group is a group, first of all; rows of
one id are ordered by their digests and equal rows lie side by side, in any order; an
empty table gives no rows; a group or a table of one leaf is its own root.  Ids must be
integers, other types raise.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import cut

#: Children of a node, and levels that one array reduces (it holds ``ARITY**LEVELS`` slots).
ARITY, LEVELS = 3, 8
#: Bits of an id below each directory level: 64 ids a word, 1024 words, then 65 536 children.
WORD_BITS, DIRECTORY = 6, (10, 16, 16)
#: Fields of a leaf.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of groups (under 300 bytes each) up to which they are broadcast.
BROADCAST_GROUPS = 50_000


def encoded(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**fields: Column) -> Column:
    return F.sha2(F.concat(*(encoded(x) for x in fields.values())), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _heights(total: int, most: int) -> int:
    """Levels that an array of a tree with ``total`` nodes is reduced by, ``most`` if there are more arrays."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // ARITY), levels + 1
    return levels


def _tree(nodes: list[str], levels: int) -> list[list[str]]:
    rows = [nodes]
    for _ in range(levels):
        rows.append([_hash(rows[-1][i : i + ARITY]) for i in range(0, len(rows[-1]), ARITY)])
    return rows


def _paths(rows: list[list[str]], i: int) -> list[tuple[str, str]]:
    """For each level the digests left and right of node ``i`` in its run."""
    out = []
    for row in rows[:-1]:
        first = i - i % ARITY
        out.append(("".join(row[first:i]), "".join(row[i + 1 : first + ARITY])))
        i //= ARITY
    return out


def _packed(path: list[tuple[str, str]]) -> str:
    return "".join(f"{a}|{b};" for a, b in path)


def _unpacked(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split("|")) for x in path.split(";")[:-1]]


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``df`` of distinct values with their gapless place ``sid``, null first."""
    dealt = cut(df.repartitionByRange(F.col(column).asc_nulls_first()).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    own = F.row_number().over(W.partitionBy("_p").orderBy(F.col(column).asc_nulls_first()))
    return cut(dealt.join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p").select(column, (F.col("_b") + own - 1).alias("sid")))


def bitmap_words(keys: DataFrame) -> DataFrame:
    """``sid, nul, at, word, n, more``: the words of the bitmaps of keys ``sid, nul, u``.

    ``n`` counts rows, ``more`` lists bits whose key has more rows than one.
    """
    mask = F.expr("shiftleft(1L, cast(u & 63 as int))")
    each = keys.groupBy("sid", "nul", "u").agg(F.count(F.lit(1)).alias("n"))
    more = F.collect_list(F.when(F.col("n") > 1, F.struct(F.expr("cast(u & 63 as int)").alias("bit"), (F.col("n") - 1).alias("n"))))
    by = each.groupBy("sid", "nul", F.shiftrightunsigned("u", WORD_BITS).alias("at"))
    return by.agg(F.bit_or(mask).alias("word"), F.sum("n").alias("n"), more.alias("more"))


def popcount_directory(words: DataFrame) -> DataFrame:
    """``sid, nul, at, below, total``: rows of the group before a word, and in all of it."""
    up = lambda bits: F.shiftrightunsigned("at", bits).alias("at")
    levels = [words.select("sid", "nul", "at", "n")]
    for bits in DIRECTORY:
        levels.append(levels[-1].groupBy("sid", "nul", up(bits)).agg(F.sum("n").alias("n")))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    top = W.partitionBy("sid")
    known = levels[-1].select("sid", "nul", "at", before(top.orderBy(F.desc("nul"), "at")).alias("below"), F.sum("n").over(top).alias("total"))
    for bits, level in zip(reversed(DIRECTORY), reversed(levels[:-1]), strict=True):
        inside = W.partitionBy("sid", "nul", "_up").orderBy("at")
        own = level.withColumn("_up", F.shiftrightunsigned("at", bits)).withColumn("_own", before(inside))
        known = own.join(known.withColumnRenamed("at", "_up"), ["sid", "nul", "_up"]).select("sid", "nul", "at", (F.col("below") + F.col("_own")).alias("below"), "total")
    return known


def with_slots(rows: DataFrame) -> DataFrame:
    """``rows`` of ``sid, _id, leaf, seen`` with ``slot`` in their group and the group's ``total``."""
    nul = F.col("_id").isNull().cast("int")
    # the sign bit turned, so that ids ascend as unsigned keys; without an id 60 bits of the digest
    key = F.coalesce(F.col("_id").bitwiseXOR(F.lit(-(1 << 63)).cast("long")), F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long"))
    keyed = rows.withColumn("nul", nul).withColumn("u", key)
    words = cut(bitmap_words(keyed.select("sid", "nul", "u")))
    found = words.join(popcount_directory(words), ["sid", "nul", "at"]).drop("n")
    ranked = keyed.withColumn("at", F.shiftrightunsigned("u", WORD_BITS)).join(found, ["sid", "nul", "at"])
    low = F.expr("bit_count(word & ~shiftleft(-1L, cast(u & 63 as int)))")
    extra = F.expr("aggregate(filter(more, x -> x.bit < (u & 63)), 0L, (s, x) -> s + x.n)")
    ranked = cut(
        ranked.select("sid", "_id", "leaf", "seen", "total", "nul", "u", (F.col("below") + low + extra).alias("slot"), F.expr("exists(more, x -> x.bit = (u & 63))").alias("_tied"))
    )
    same = F.row_number().over(W.partitionBy("sid", "nul", "u").orderBy("leaf", "seen")) - 1
    tied = ranked.filter("_tied").withColumn("slot", F.col("slot") + same)
    return ranked.filter("NOT _tied").unionByName(tied).drop("nul", "u", "_tied")


def _arrays(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("g", F.floor(F.col("slot") / ARITY**levels).cast("long"))


def _reduce(pdf: pd.DataFrame, levels: int) -> pd.DataFrame:
    first = pdf.iloc[0]
    total = int(first["total"])
    top = _tree(pdf.sort_values("slot")["node"].tolist(), _heights(total, levels))[-1]
    return pd.DataFrame({"sid": [first["sid"]], "slot": [first["g"]], "total": [-(-total // ARITY**levels)], "node": top})


def climb(nodes: DataFrame, levels: int = LEVELS) -> list[DataFrame]:
    """The tables of nodes ``sid, slot, total, node`` from ``nodes`` up to one node a tree."""
    tables = [nodes]
    most = nodes.agg(F.max("total")).first()[0] or 0
    while most > 1:
        arrays = _arrays(tables[-1], levels).groupBy("sid", "g")
        tables.append(cut(arrays.applyInPandas(lambda pdf: _reduce(pdf, levels), "sid long, slot long, total long, node string")))
        most = -(-most // ARITY**levels)
    return tables


def _inner(nodes: pd.DataFrame, above: pd.DataFrame, levels: int) -> pd.DataFrame:
    nodes = nodes.sort_values("slot")
    rows = _tree(nodes["node"].tolist(), _heights(int(nodes["total"].iloc[0]), levels))
    path = above["path"].iloc[0]
    return pd.DataFrame({"sid": nodes["sid"], "slot": nodes["slot"], "path": [_packed(_paths(rows, i)) + path for i in range(len(nodes))]})


def descend(tables: list[DataFrame], above: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``sid, slot, path`` of the nodes of the first of ``tables``; ``above`` gives those of the last one."""
    for nodes in reversed(tables[:-1]):
        down = _arrays(nodes, levels).groupBy("sid", "g").cogroup(above.withColumnRenamed("slot", "g").groupBy("sid", "g"))
        above = cut(down.applyInPandas(lambda a, b: _inner(a, b, levels), "sid long, slot long, path string"))
    return above


def _leaves(nodes: pd.DataFrame, above: pd.DataFrame, levels: int) -> pd.DataFrame:
    nodes = nodes.sort_values("slot")
    up = above.iloc[0]
    rows, higher = _tree(nodes["node"].tolist(), _heights(int(nodes["total"].iloc[0]), levels)), _unpacked(up["path"])
    proofs, roots = [], []
    for i, now in enumerate(nodes["seen"]):
        path = _paths(rows, i) + higher
        proofs.append(_hash([x for pair in path for x in pair]))
        for left, right in path:
            now = _hash([left, now, right])
        roots.append(now)
    out = nodes[["_id", "node"]].rename(columns={"node": "leaf"})
    out["subroot"], out["root"], out["proof_sha256"], out["folded_root"] = up["subroot"], up["root"], proofs, roots
    out["_id"] = out["_id"].astype("Int64")
    return out


def merkle_manifest(rows: DataFrame, group: str, row_id: str, leaf: Column, seen: Column, levels: int = LEVELS) -> DataFrame:
    """``row_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    ``leaf`` is the digest a row is entered with, ``seen`` the one it has now.
    """
    kind = rows.schema[row_id].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{row_id} must be an integer column, not {kind.simpleString()}")
    leaves = cut(rows.select(F.col(group).cast("string").alias("_group"), F.col(row_id).cast("long").alias("_id"), leaf.alias("leaf"), seen.alias("seen")))
    groups = numbered(leaves.select("_group").distinct(), "_group")
    many = groups.count()
    known = F.broadcast(groups) if many <= BROADCAST_GROUPS else groups
    placed = leaves.join(known, leaves["_group"].eqNullSafe(groups["_group"])).select("sid", "_id", "leaf", "seen")
    slots = cut(with_slots(placed).withColumnRenamed("leaf", "node"))

    trees = climb(slots.select("sid", "slot", "total", "node"), levels)
    subroots = trees[-1].select("sid", "node")
    tops = climb(subroots.select(F.lit(0).cast("long").alias("sid"), F.col("sid").alias("slot"), F.lit(many).cast("long").alias("total"), "node"), levels)
    head = tops[-1].select(F.lit(0).cast("long").alias("sid"), "slot", F.lit("").alias("path"))
    entry = descend(tops, head, levels).select(F.col("slot").alias("sid"), F.lit(0).cast("long").alias("slot"), "path")
    above = descend(trees[1:], entry, levels) if len(trees) > 1 else entry
    root = tops[-1].select(F.col("node").alias("root"))
    ends = subroots.withColumnRenamed("node", "subroot").join(F.broadcast(root))  # one row
    heads = above.join(ends, "sid").select("sid", F.col("slot").alias("g"), "path", "subroot", "root")
    fold = _arrays(slots, levels).groupBy("sid", "g").cogroup(heads.groupBy("sid", "g"))
    out = fold.applyInPandas(lambda a, b: _leaves(a, b, levels), "_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.select(F.col("_id").cast(kind).alias(row_id), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def document_manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Manifest of documents by source; documents whose id has an even checksum are seen without their line ends."""
    fields = {c: F.col(c) for c in FIELDS}
    kept = leaf_digest(**fields)
    cut_text = leaf_digest(**(fields | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}))
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle_manifest(docs, "source", "doc_id", kept, F.when(even, cut_text).otherwise(kept), levels)
