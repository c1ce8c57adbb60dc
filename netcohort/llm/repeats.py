"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted both ways.

In every window of ``SPREAD`` runs of ``RUN`` words, which is ``LEAST`` words, the run
of least hash is the minimiser; equal windows have equal minimisers.  The suffixes that
begin at minimisers are retained, each with the words after its start and, reversed, the
words before it, as far as the windows of this minimiser reach (its block).

Equal blocks are one suffix, with the least and the greatest document.  A first sort of
all suffixes by minimiser parts those that stand alone.  The others are sorted by what
follows, and once more by what precedes; in each order a suffix is compared with both
neighbours.  No suffix of the table matches it further to the right than its neighbours
in the first order, none further to the left than its neighbours in the second.  The
match is extended by both bounds: a window of ``LEAST`` words within them is named by
two 64-bit hashes, of its words before and from the minimiser on, and is a repeat if two
documents have both.  This check decides where one neighbour reaches far to the right and
another far to the left but none does both, so no order, range or common run hides a
passage.  Repeated windows of a document that overlap or touch are merged.

The sorts are range exchanges by the whole order, so a minimiser that a third of all
documents have is cut like any other; what lies beyond a range's edge is unknown there,
so the two suffixes at its edges are bounded by their blocks alone.  Joins by window and
by block take the at most ``HOT`` keys that hold more than one row in ``HOT`` from a
broadcast table of that many rows and exchange the rest.

Defined cases: null and empty texts and texts of fewer than ``LEAST`` words give no
rows; rows without an id are left out; passages repeated only inside one document give no rows; of rows that share an
id and differ in text each is matched by its own words; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .common import gram_hashes, map_batches, mix, short_batches, span_hashes, texts_of, word_spans

#: Words of a run, runs of a window, words of the shortest passage.
RUN, SPREAD, LEAST = 12, 39, 50
#: Suffixes of one range of a sort (the mean); a cluster's partitions are used anyway.
RANGE_ROWS = 500_000
#: A key with more than one row in so many is hot; there are at most as many such keys.
HOT = 1024
#: Sets the second hash of a block apart from the first.
OTHER = np.uint64(0xD6E8FEB86659FD93)


def names_of(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of spans of words, from the words' hashes."""
    return span_hashes(words, starts, ends).view(np.int64), span_hashes(mix(words ^ OTHER), starts, ends).view(np.int64)


def words_of(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, np.uint8)
    return span_hashes(buf, *word_spans(buf))


def blocks_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each block the minimiser's hash, the first window, the number of windows and
    the words from the first window to the minimiser."""
    if len(words) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    runs = gram_hashes(words, RUN)
    at = np.lib.stride_tricks.sliding_window_view(runs, SPREAD).argmin(1) + np.arange(len(runs) - SPREAD + 1)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    return runs[at[first]].view(np.int64), first, np.diff(first, append=len(at)), at[first] - first


def _blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts: list[tuple] = []
    for i, text in enumerate(texts_of(batch)):
        words = words_of(text)
        keys, first, n, left = blocks_of(words)
        parts.append((keys, *names_of(words, first, first + n + LEAST - 1), np.full(len(first), i), *(x.astype(np.int32) for x in (first, n, left))))
    key, one, two, i, first, n, left = (np.concatenate(p) for p in zip(*parts, strict=True))
    doc = batch.column("doc_id").take(pa.array(i.astype(np.int64)))
    return pa.RecordBatch.from_arrays([*map(pa.array, (key, one, two)), doc, *map(pa.array, (first, n, left))], ["key", "one", "two", "doc_id", "start", "n", "left"])


def _suffixes(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The words after and before the starts of the wanted suffixes, as ordered bytes."""
    out: list[dict] = []
    for text, wanted in zip(texts_of(batch), batch.column("wanted").to_pylist(), strict=True):
        words = words_of(text)
        for x in wanted:
            start, end = x["start"], x["start"] + x["n"] + LEAST - 1
            if end > len(words):
                continue  # of another text of this id
            block = words[start:end]
            if [int(h[0]) for h in names_of(block, np.array([0]), np.array([len(block)]))] != [x["one"], x["two"]]:
                continue
            ordered = block.astype(">u8")
            out.append({**{k: x[k] for k in ("key", "one", "two", "lo", "hi")}, "after": ordered[x["left"] :].tobytes(), "before": ordered[: x["left"]][::-1].tobytes()})
    if not out:
        return None
    kind = batch.schema.field("doc_id").type
    types = {"key": pa.int64(), "one": pa.int64(), "two": pa.int64(), "lo": kind, "hi": kind, "after": pa.binary(), "before": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in types.items()], list(types))


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """Sorted batches with the row before and the row after each, and the place and the
    number of the batch's own rows; at the range's edges there is no such row."""
    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield _joined(last, held, batch.slice(0, 1))
            last = held.slice(held.num_rows - 1)
        held = batch
    if held is not None:
        yield _joined(last, held, None)


def _joined(before: pa.RecordBatch | None, own: pa.RecordBatch, after: pa.RecordBatch | None) -> tuple[pa.RecordBatch, int, int]:
    rows = pa.Table.from_batches([b for b in (before, own, after) if b is not None]).combine_chunks().to_batches()[0]
    return rows, int(before is not None), own.num_rows


def flat_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows one after another, each row's first and its number."""
    rows = column.to_pylist()
    n = np.array([len(x) // 8 for x in rows], np.int64)
    return np.frombuffer(b"".join(rows), ">u8").astype(np.uint64), np.cumsum(n) - n, n


def matches(rows: pa.RecordBatch, column: str, at: int, own: int) -> np.ndarray:
    """Words of ``column`` each own row shares with that neighbour of its minimiser with
    which it shares more; beside an edge, all of them."""
    flat, first, n = flat_words(rows.column(column))
    width = int(n.max(initial=0)) + 1
    grid = np.zeros((len(n), width), np.uint64)
    there = np.arange(width) < n[:, None]
    grid[there] = flat
    same = (grid[1:] == grid[:-1]) & there[1:] & there[:-1]
    key = rows.column("key").to_numpy()
    shared = np.where(key[1:] == key[:-1], np.logical_and.accumulate(same, axis=1).sum(1), 0)
    left, right = np.full(len(n), -1), np.full(len(n), -1)
    left[1:], right[:-1] = shared, shared
    best = np.maximum(left, right)
    if at == 0:
        best[0] = n[0]
    if at + own == len(n):
        best[-1] = n[-1]
    return best[at : at + own]


def _companions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks the suffixes that have a neighbour with their minimiser, or an edge."""
    for rows, at, own in with_neighbours(batches):
        key = rows.column("key").to_numpy()
        with_next = np.append(key[1:] == key[:-1], at + own == len(key))
        with_last = np.append(at == 0, key[1:] == key[:-1])
        yield rows.slice(at, own).append_column("near", pa.array((with_next | with_last)[at : at + own]))


def _reach_right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds how far to the right a suffix is matched; those too short either way leave."""
    for rows, at, own in with_neighbours(batches):
        kept = rows.slice(at, own)
        reach = matches(rows, "after", at, own)
        two = np.array([a != b for a, b in zip(kept.column("lo").to_pylist(), kept.column("hi").to_pylist(), strict=True)], bool)
        reach = np.where(two, LEAST, reach).astype(np.int32)
        before = flat_words(kept.column("before"))[2]
        yield kept.append_column("reach", pa.array(reach)).filter(pa.array(before + reach >= LEAST))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of ``LEAST`` words within both bounds, named by their two parts."""
    for rows, at, own in with_neighbours(batches):
        kept = rows.slice(at, own)
        words, first, n = flat_words(kept.column("before"))
        ahead, start, m = flat_words(kept.column("after"))
        two = np.array([a != b for a, b in zip(kept.column("lo").to_pylist(), kept.column("hi").to_pylist(), strict=True)], bool)
        most = np.where(two, n, matches(rows, "before", at, own))
        least = np.maximum(LEAST - np.minimum(kept.column("reach").to_numpy(), m), 0)
        count = np.maximum(most - least + 1, 0)
        i = np.repeat(np.arange(own), count)
        if not len(i):
            continue
        before = least[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        w1 = span_hashes(words, first[i], first[i] + before).view(np.int64)
        w2 = span_hashes(ahead, start[i], start[i] + LEAST - before).view(np.int64)
        whose = kept.select(["one", "two", "lo", "hi"]).take(pa.array(i))
        yield pa.RecordBatch.from_arrays([*map(pa.array, (w1, w2, before.astype(np.int32), (n[i] - before).astype(np.int32))), *whose.columns], ["w1", "w2", "before", "at", "one", "two", "lo", "hi"])


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df``, a written table, sorted by ``order`` in ranges of it."""
    short_batches(df.sparkSession)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // RANGE_ROWS))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def join_spread(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of the written ``rows`` with ``few``, a written table of one row a key
    whose ``c`` is at most the number of ``rows`` with this key, without gathering hot keys."""
    hot = F.col("c") * HOT > rows.count()
    often = F.broadcast(few.filter(hot))
    rest = rows.join(F.broadcast(few.filter(hot).select(*on)), on, "left_anti")
    return rows.join(often.drop("c"), on).unionByName(rest.join(few.filter(~hot).drop("c"), on))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id, start_word, end_word, n_words, other_doc_id``: a row for each passage of a
    document, as large as its repeats reach, that another document (``other_doc_id``, the
    least met; where that is the document itself, the greatest) repeats.  Words count from
    0, the end is exclusive."""
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")
    kind = docs.schema["doc_id"].dataType.simpleString()
    ends = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    picked = cut(map_batches(docs, _blocks, f"key long, one long, two long, doc_id {kind}, start int, n int, left int"))
    each = cut(picked.groupBy("key", "one", "two", "n", "left").agg(F.count("*").alias("c"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.min(F.struct("doc_id", "start")).alias("own")))
    marked = cut(ranged(each, ["key", "one", "two"]).mapInArrow(_companions, f"key long, one long, two long, n int, left int, c long, lo {kind}, hi {kind}, own struct<doc_id:{kind},start:int>, near boolean"))

    fields = F.struct("key", "one", "two", "n", "left", F.col("own.start").alias("start"), "lo", "hi")
    wanted = marked.filter("near").groupBy(F.col("own.doc_id").alias("doc_id")).agg(F.collect_list(fields).alias("wanted"))
    shape = f"key long, one long, two long, lo {kind}, hi {kind}, after binary, before binary"
    suffixes = cut(map_batches(docs.join(wanted, "doc_id"), _suffixes, shape))
    reached = cut(ranged(suffixes, ["key", "after", "before"]).mapInArrow(_reach_right, shape + ", reach int"))
    windows = cut(ranged(reached, ["key", "before", "after"]).mapInArrow(_windows, f"w1 long, w2 long, before int, at int, one long, two long, lo {kind}, hi {kind}"))

    name = ["w1", "w2", "before"]
    shared = cut(windows.groupBy(*name).agg(F.count("*").alias("c"), *ends).filter("lo <> hi"))
    found = join_spread(windows.drop("lo", "hi"), shared, name).select("one", "two", "at", "lo", "hi")
    found = found.repartition("one", "two").groupBy("one", "two", "at").agg(*ends)
    found = found.withColumn("_i", F.col("at") - F.row_number().over(W.partitionBy("one", "two").orderBy("at")))
    spans = found.groupBy("one", "two", "_i").agg(F.min("at").alias("a"), F.max("at").alias("b"), *ends)
    spans = spans.groupBy("one", "two").agg(F.collect_list(F.struct("a", "b", "lo", "hi")).alias("spans"))
    alone = marked.filter("NOT near AND lo <> hi").select("one", "two", F.array(F.struct(F.lit(0).alias("a"), (F.col("n") - 1).alias("b"), "lo", "hi")).alias("spans"))
    counts = marked.select("one", "two", "c")
    parts = cut(spans.unionByName(alone).join(counts, ["one", "two"]))
    held = join_spread(picked.select("one", "two", "doc_id", "start"), parts, ["one", "two"]).select("doc_id", "start", F.explode("spans").alias("s"))

    other = F.when(F.col("doc_id") == F.col("s.lo"), F.col("s.hi")).otherwise(F.col("s.lo")).alias("other")
    held = held.select("doc_id", (F.col("start") + F.col("s.a")).alias("start"), (F.col("start") + F.col("s.b") + LEAST).alias("end"), other)
    w = W.partitionBy("doc_id").orderBy("start", "end")
    island = held.withColumn("_new", F.coalesce(F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True)).cast("int"))
    island = island.withColumn("_i", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    out = island.groupBy("doc_id", "_i").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc_id"))
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "other_doc_id")
