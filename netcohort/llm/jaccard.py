"""Exact n-gram Jaccard join by a token-group matrix.

A document's set holds the hashes of its word shingles.  Documents of equal sets are
one class.  The order of tokens puts rare ones first, by a counting sketch of fixed
size over all documents; any order gives the same links, a good one short lists.  In
that order two similar sets share ``NEED`` tokens of their beginnings (prefixes), so
only prefixes are exchanged.

1. Groups: every token's documents are compared with one leader; verified links
   join them into components.  A leader and the documents that shared most tokens with
   it, linked or not, are one family of similar documents.
2. Matrix: each family keeps the union of its members' prefix tokens with the range of
   their set sizes.  A document's overlap with the union bounds its overlap with any
   member; only families that reach the bound are opened.
3. Opening: a family's members lie in blocks of about ``BLOCK`` documents, those of one
   component together.  A document that opens a family is sent to its blocks, once to
   each, and counted against all members of a block at a time, whole set with whole
   set.  First every document meets one block of its best family; the links found are
   joined before the other blocks are opened, and a block whose members all are in the
   document's own component is skipped.

So pairs are never rows: a family of copies around the limit costs a row for each
document and block, and members of one component cost nothing more.  No link between
different components can be missed.

Copies are collapsed before lists are made.  A block that very many documents open is
repeated for every ``CROWD`` of them.  Each round is written to the shared folder.

Defined cases: null texts and texts without words have an empty set, are linked with
nothing and are their own component; fewer words than a shingle make one shingle;
repeated rows have one class; an empty table gives no rows.  Rows without an id link as
others do and take the component's least id, null where no row of it has one.  Ids may
be of any type that has an order.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .common import WORD, gram_hashes, lower_ascii, mix, short_batches, span_hashes, word_spans

SHINGLE = 5
#: Least likeness: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Prefix tokens that two similar documents must share (fewer if a set is tiny).
NEED = 4
#: Counters of the sketch and parts it is moved in: 4 MB, whatever the corpus.
COUNTERS, PARTS, LOTS = 1 << 20, 16, 8
#: Documents of a block and tokens of their sets, documents that one copy of a block is opened by.
BLOCK, BLOCK_TOKENS, CROWD = 64, 1 << 20, 4096
#: Rows up to which a table of ids (24 bytes a row) is broadcast; beyond, it is joined by exchange.
BROADCAST_ROWS = 400_000


def shingle_set(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending."""
    buf = lower_ascii(np.frombuffer(text, np.uint8))
    starts, ends = word_spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64)
    words = span_hashes(buf, starts, ends)
    return np.unique(gram_hashes(words, min(size, len(words))) ^ np.uint64(min(size, len(words))))


def digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "big", signed=True)


def prefix_lengths(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """Prefix of a set as the smaller of a pair, and as the larger one."""
    need = min(NEED, -(-percent * n // 100))
    return min(n, n - -(-2 * percent * n // (100 + percent)) + need), min(n, n - -(-percent * n // 100) + need)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
    return zip(batch.column("doc_id").to_pylist(), (x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()), strict=True)


def _sets_and_counts(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(COUNTERS, np.int32), set()
        names, kinds = ["doc_id", "key", "n", "digest", "part", "counts"], [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        make = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        for batch in batches:
            ids, sizes, digests, fresh = [], [], [], []
            for doc, text in _texts(batch):
                tokens = shingle_set(text)
                d = digest(tokens)
                ids.append(doc)
                sizes.append(len(tokens))
                digests.append(d)
                if d not in seen:
                    seen.add(d)
                    fresh.append(tokens)
            if fresh:
                np.add.at(counts, (np.concatenate(fresh) & np.uint64(COUNTERS - 1)).astype(np.int64), 1)
            none = [None] * len(ids)
            yield make([ids, batch.column("key"), sizes, digests, none, none])
        if seen:
            yield make([[None] * PARTS, [None] * PARTS, [None] * PARTS, [min(seen) % LOTS] * PARTS, list(range(PARTS)), [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]])

    return run


def _add_counts(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // PARTS, np.int64)
    for x in pdf["counts"]:
        raw = np.frombuffer(zlib.decompress(x), np.int64 if pdf["wide"].iloc[0] else np.int32)
        total += raw
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)], "wide": [True]})


def token_levels(counts: np.ndarray) -> np.ndarray:
    """How far above chance each counter is, in powers of two (0: not above)."""
    usual = counts.mean()
    over = counts - (usual + 6 * np.sqrt(usual) + 8)
    return np.where(over > 0, np.floor(np.log2(np.maximum(over, 1))) + 1, 0).astype(np.uint8)


def _prefixes(levels):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, seen = np.frombuffer(zlib.decompress(levels.value), np.uint8), set()
        for batch in batches:
            tokens_of, n_of, d_of, at_of = [], [], [], []
            for _, text in _texts(batch):
                tokens = shingle_set(text)
                n, d = len(tokens), digest(tokens)
                if not n or d in seen:
                    continue
                seen.add(d)
                order = np.lexsort((mix(tokens), level[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)]))
                p = prefix_lengths(n)[1]
                tokens_of.append(tokens[order[:p]])
                n_of.append(np.full(p, n, np.int32))
                d_of.append(np.full(p, d, np.int64))
                at_of.append(np.arange(p, dtype=np.int32))
            if tokens_of:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens_of], d_of, n_of, at_of)], ["token", "digest", "n", "at"])

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of every node of the links ``a, b``; the root is the least node.

    Large-star and small-star rounds until nothing changes; each round is written.
    """
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = mark(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("v", "m").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return cut(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """``df`` to be broadcast if it is known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block brings its members first, then the documents that open it, one after the other."""
    block, names, groups, sizes, tokens, owners, known = None, [], [], None, [], None, {}

    def root(g: int) -> int:
        while (up := known.get(g, g)) != g:
            known[g] = known.get(up, up)
            g = known[g]
        return g

    for batch in batches:
        found = []
        columns = (batch.column(c).to_pylist() for c in ("block", "salt", "query", "own", "g"))
        for one, salt, query, own, g, text in zip(*columns, (x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()), strict=True):
            if (one, salt) != block:
                block, names, groups, sizes, tokens, owners, known = (one, salt), [], [], None, [], None, {}
            mine = shingle_set(text)
            if digest(mine) != own:  # another text of the same id
                continue
            if not query:
                if own not in names:
                    names.append(own)
                    groups.append(g)
                    tokens.append(mine)
                continue
            if sizes is None:
                sizes = np.array([len(x) for x in tokens], np.int64)
                owners = np.repeat(np.arange(len(names)), sizes)
                tokens = np.concatenate(tokens) if names else np.zeros(0, np.uint64)
                order = np.argsort(tokens, kind="stable")
                tokens, owners = tokens[order], owners[order]
            low, high = np.searchsorted(tokens, mine, "left"), np.searchsorted(tokens, mine, "right")
            width = high - low
            at = np.repeat(low - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
            shared = np.bincount(owners[at], minlength=len(names))
            for i in np.flatnonzero(100 * shared >= PERCENT * (sizes + len(mine) - shared)).tolist():
                a, b = root(groups[i]), root(g)
                if a != b:
                    known[a] = b
                    found.append((names[i], own))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def verified(cells: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links ``a, b`` that the cells ``block, salt, query, own, g`` find and their components lack.

    A block's members are compared with the queries sent to it, set with set.
    """
    wanted = cut(cells.join(classes, F.col("own") == F.col("digest")).select("block", "salt", "query", "own", "g", "doc", "key"))
    n = wanted.count()
    if not n:
        return wanted.select(F.col("own").alias("a"), F.col("own").alias("b"))
    texts = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_key"), "text")
    met = texts.join(_sized(wanted, n), (F.col("key") == F.col("_key")) & F.col("doc").eqNullSafe(F.col("_doc")))
    placed = met.repartition("block", "salt").sortWithinPartitions("block", "salt", "query")
    return cut(placed.select("block", "salt", "query", "own", "g", "text").mapInArrow(_compare_blocks, "a long, b long").distinct())


def crowded(opened: DataFrame, members: DataFrame) -> DataFrame:
    """Cells of ``opened`` (``block, own, g``) with the ``members`` of their blocks, crowds of one block apart."""
    crowds = cut(opened.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("crowds")))
    sent = opened.join(crowds, "block").select("block", F.pmod(F.xxhash64("own"), F.col("crowds")).cast("int").alias("salt"), F.lit(True).alias("query"), "own", "g")
    held = members.join(crowds, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("salt"), F.lit(False).alias("query"), "own", "g")
    return sent.unionByName(held)


def _need(n: str):
    return F.least(F.lit(NEED), F.ceil(PERCENT * F.col(n) / 100))


def _with_groups(rows: DataFrame, group: DataFrame | None) -> DataFrame:
    """``rows`` of digests with their component ``g``."""
    if group is None:
        return rows.withColumn("g", F.col("digest"))
    known = rows.join(_sized(group, group.count()), F.col("digest") == F.col("node"), "left")
    return known.withColumn("g", F.coalesce("root", "digest")).drop("node", "root")


def blocked(placed: DataFrame) -> DataFrame:
    """``placed`` (``digest, n, g, f``) with the ``block`` of each document.

    Documents of one family and component share blocks; components of less than half a
    block are pooled within the family.
    """
    own = placed.groupBy("f", "g").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    own = own.withColumn("pooled", F.col("c") < BLOCK // 2)
    pool = own.filter("pooled").groupBy("f").agg(F.sum("c").alias("pc"), F.sum("s").alias("ps"))
    many = lambda c, s: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(s) / BLOCK_TOKENS)).cast("long")
    dealt = placed.join(cut(own.join(pool, "f", "left")), ["f", "g"])
    by_group = F.xxhash64("f", "g", F.pmod(F.xxhash64("digest"), many("c", "s")))
    by_pool = F.xxhash64("f", F.pmod(F.xxhash64("digest", "g"), many("pc", "ps")))
    return dealt.select("digest", "n", "g", "f", F.when(F.col("pooled"), by_pool).otherwise(by_group).alias("block"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id``; the component is the least id that links reach."""
    spark = docs.sparkSession
    short_batches(spark)
    kind = docs.schema["doc_id"].dataType
    docs = docs.select("doc_id", "text")
    read = cut(docs.withColumn("key", F.xxhash64("text")).mapInArrow(_sets_and_counts(to_arrow_type(kind)), f"doc_id {kind.simpleString()}, key long, n long, digest long, part int, counts binary"))
    sets = read.filter("part IS NULL").select("doc_id", "key", "n", "digest")
    # one row of each class brings its text: that of the least id, of rows without an id only where there is no other
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc"), "key"))
    classes = cut(sets.filter("n > 0").groupBy("digest").agg(first.alias("_r")).select("digest", "_r.doc", "_r.key"))
    parts = read.filter("part IS NOT NULL").select("part", "counts", F.col("digest").alias("lot"), F.lit(False).alias("wide"))
    some = parts.groupBy("part", "lot").applyInPandas(_add_counts, "part int, counts binary, wide boolean")
    total = some.groupBy("part").applyInPandas(_add_counts, "part int, counts binary, wide boolean").take(1 << 24)
    counts = np.zeros((PARTS, COUNTERS // PARTS), np.int64)
    for r in total:
        counts[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    levels = spark.sparkContext.broadcast(zlib.compress(token_levels(counts.reshape(-1)).tobytes(), 1))

    prefixes = docs.mapInArrow(_prefixes(levels), "token long, digest long, n int, at int")
    by_token = W.partitionBy("token")
    lists = prefixes.withColumn("_lo", F.min("digest").over(by_token)).withColumn("_hi", F.max("digest").over(by_token)).withColumn("m", F.count(F.lit(1)).over(by_token))
    lists = cut(lists.filter("_lo <> _hi").drop("_lo", "_hi").distinct())
    weight = cut(lists.groupBy("digest").agg(F.sum("m").alias("weight"), F.first("n").alias("n")))
    lists = lists.drop("m")

    links = group = None

    def join_groups(found: DataFrame) -> None:
        nonlocal links, group
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            group = components(links)

    # the leader of a token shares most with others, so an original leads its copies
    led = lists.join(_sized(weight.select("digest", "weight"), weight.count()), "digest")
    led = led.withColumn("lead", F.max(F.struct("weight", "digest", "n")).over(by_token)).select("digest", "n", F.col("lead.digest").alias("lead"), F.col("lead.n").alias("lead_n"))
    met = led.filter(f"digest <> lead AND 100 * least(n, lead_n) >= {PERCENT} * greatest(n, lead_n)").groupBy("digest", "lead").agg(F.count(F.lit(1)).alias("c"), F.min(F.least("n", "lead_n")).alias("n"))
    best = met.filter(F.col("c") >= _need("n")).groupBy("digest").agg(F.max(F.struct("c", "lead")).alias("b"))
    best = cut(best.select("digest", F.col("b.lead").alias("lead")))
    leaders = best.select(F.col("lead").alias("own")).distinct()
    join_groups(verified(crowded(best.select(F.col("lead").alias("block"), F.col("digest").alias("own"), F.col("digest").alias("g")), leaders.select(F.col("own").alias("block"), "own", F.col("own").alias("g"))), classes, docs))

    # families: a leader with its documents, leaders always their own
    follows = best.join(leaders.withColumnRenamed("own", "digest"), "digest", "left_anti")
    family = weight.select("digest", "n").join(follows, "digest", "left").select("digest", "n", F.coalesce("lead", "digest").alias("f"))
    placed = cut(blocked(_with_groups(family, group)))
    small = F.col("n") - F.ceil(2 * PERCENT * F.col("n") / (100 + PERCENT)) + _need("n")
    rows = lists.join(_sized(placed.select("digest", "g", "f"), placed.count()), "digest")
    rows = rows.withColumn("_lo", F.min("g").over(by_token)).withColumn("_hi", F.max("g").over(by_token)).filter("_lo <> _hi")
    grouped = cut(rows.select("token", "digest", "n", "g", "f", (F.col("at") < small).alias("as_small")))

    # matrix: which families does a document's prefix reach that are not all in its component?
    matrix = grouped.filter("as_small").groupBy("token", "f").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("g").alias("g_lo"), F.max("g").alias("g_hi"))
    query = grouped.select("token", F.col("digest").alias("q"), F.col("n").alias("qn"), F.col("g").alias("qg"))
    reach = query.join(matrix, "token").filter(f"lo <= qn AND 100 * hi >= {PERCENT} * qn AND NOT (g_lo = qg AND g_hi = qg)")
    opened = reach.groupBy("q", "f").agg(F.first("qn").alias("qn"), F.count(F.lit(1)).alias("c"), F.least(F.min("lo"), F.first("qn")).alias("_n"))
    opened = cut(opened.filter(F.col("c") >= _need("_n")).select("q", "f", "qn", "c"))
    blocks = placed.groupBy("f", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    blocks = cut(blocks.withColumn("i", F.row_number().over(W.partitionBy("f").orderBy("block"))))
    counts = cut(blocks.groupBy("f").agg(F.max("i").alias("blocks")))

    def open_blocks(asked: DataFrame, on: list[str]) -> DataFrame:
        """Cells of the documents ``asked`` (``q, f, qn``) with the family's blocks, or with its block ``i`` only."""
        known = _with_groups(asked.withColumnRenamed("q", "digest"), group)
        now = cut(_with_groups(placed.select("digest", "block"), group))
        range_of = now.groupBy("block").agg(F.min("g").alias("g_lo"), F.max("g").alias("g_hi"))
        fresh = blocks.join(range_of, "block")
        sent = known.join(fresh, on).filter(f"lo <= qn AND 100 * hi >= {PERCENT} * qn AND NOT (g_lo = g AND g_hi = g)")
        sent = cut(sent.select("block", F.col("digest").alias("own"), "g"))
        members = now.join(sent.select("block").distinct(), "block", "left_semi").select("block", F.col("digest").alias("own"), "g")
        return crowded(sent, members)

    most = opened.groupBy("q").agg(F.max(F.struct("c", "f", "qn")).alias("b")).select("q", "b.f", "b.qn")
    drawn = most.join(counts, "f").select("q", "f", "qn", (F.pmod(F.xxhash64("q"), F.col("blocks")) + 1).cast("int").alias("i"))
    join_groups(verified(open_blocks(drawn, ["f", "i"]), classes, docs))
    join_groups(verified(open_blocks(opened.select("q", "f", "qn"), ["f"]), classes, docs))

    if group is None:
        group = spark.createDataFrame([], "node long, root long")
    placed = sets.join(group, (F.col("digest") == F.col("node")) & (F.col("n") > 0), "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("root", "digest")).alias("root"))
    least = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "root", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, that of the least id, all columns kept.

    Documents without words all stay.  Rows of one id and one text count as one document.
    """
    found = cut(jaccard_components(docs))
    stays = cut(found.filter(F.col("n_shingles").eqNullSafe(0) | F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stays")).distinct())
    own = F.row_number().over(W.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
    kept = docs.join(_sized(stays, stays.count()), docs["doc_id"].eqNullSafe(F.col("_stays")), "left_semi")
    empty = ~F.coalesce("text", F.lit("")).rlike(WORD)
    return kept.withColumn("_nth", own).filter((F.col("_nth") == 1) | empty).select(*docs.columns)
