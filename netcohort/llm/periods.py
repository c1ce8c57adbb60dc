"""Periodic runs of words by scale-tiled distribution.

Periods are taken octave by octave.  For the octave of periods 2**k to 2**(k+1) - 1 a
document is exploded into overlapping tiles around boundaries 2**(k+1) words apart; a
tile reaches that far to either side of its boundary, and one period further.  Every run
of an octave crosses a boundary.  Each tile is solved by itself: its boundary
Z-functions, forward from the boundary and backward before it, tell for every period of
the octave how far the words agree with those one period later.  Offsets whose Z-value
cannot reach half a tile are ruled out by window hashes, all offsets of many tiles at
once; the Z-values of the rest are exact, word for word.  An offset that is a multiple
of a shorter period there is dropped.

What a tile gives is a fragment of an interval.  Fragments are shuffled by document and
period, and stitched where they touch or overlap.  Tiles of one document stay with the
task that read it, in groups of bounded size, since moving them would cost the corpus
times the number of octaves; only fragments move.

A run needs at least four periods, so a fragment is as long as its boundary distance.

Defined cases: null and empty texts have no words and no runs; repeated rows give equal
rows; rows of one id and different texts are told apart by their texts; ids of any type
pass through; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import cut
from .common import WORD, _powers, map_batches, mix, span_hashes, texts_of, word_spans

#: A run is at least so many periods and so many words long.
PERIODS, LEAST_WORDS = 4, 6
#: Cells of one group of tiles that are compared at once.
GROUP = 1 << 21


@lru_cache(maxsize=4)
def _sieve(n: int) -> np.ndarray:
    """Least prime factor of each number below ``n``."""
    least = np.zeros(n, np.int64)
    for p in range(2, n):
        if p * p > n:
            break
        if least[p] == 0:
            part = least[p * p :: p]
            part[part == 0] = p
    return np.where(least == 0, np.arange(n), least)


def _primitive(spans, x: np.ndarray, length: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether the ``length`` words from ``x``, which have period ``q``, have no period that divides it."""
    least = _sieve(1 << int(q.max()).bit_length())
    out, rest = np.ones(len(q), bool), q.copy()
    while True:
        open_ = np.flatnonzero(out & (rest > 1))
        if not len(open_):
            return out
        p = least[rest[open_]]
        d = q[open_] // p
        n = length[open_] - d
        out[open_] = spans(x[open_], n) != spans(x[open_] + d, n)
        while True:
            more = rest[open_] % p == 0
            if not more.any():
                break
            rest[open_[more]] //= p[more]


def _reach(words: np.ndarray, at: np.ndarray, q: np.ndarray, limit: int, step: int) -> np.ndarray:
    """Z-values: how many words from ``at`` on, in steps of ``step``, equal those ``q`` later; at most ``limit``."""
    out = np.zeros(len(at), np.int64)
    rows = max(1, GROUP // limit)
    along = np.arange(limit) * step
    for i in range(0, len(at), rows):
        here = at[i : i + rows, None] + along
        same = words[here] == words[here + q[i : i + rows, None]]
        out[i : i + rows] = np.where(same.all(1), limit, same.argmin(1))
    return out


def fragments(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``document, period, from, to``: intervals of words that equal the word one period later."""
    lengths = np.array([len(d) for d in docs], np.int64)
    order = np.argsort(-lengths, kind="stable")
    top = int(lengths.max(initial=0))
    none = np.zeros(0, np.int64)
    if top < LEAST_WORDS:
        return none, none, none, none
    n_of = lengths[order]
    starts = np.concatenate([[0], np.cumsum(n_of + 1)])[:-1]
    total = int(n_of.sum()) + len(docs)
    # longest documents first; a word of its own ends each, so no window of two documents agrees
    words = mix(np.arange(total + 2 * top + 8, dtype=np.uint64) + np.uint64(1 << 62))
    for o, i in zip(starts, order, strict=True):
        words[o : o + lengths[i]] = docs[i]
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers("up", len(words)), out=sums[1:])
    down = _powers("down", len(words) + 1)

    def spans(x: np.ndarray, n) -> np.ndarray:
        return (sums[x + n] - sums[x]) * down[x]

    found = []
    half = 1
    while PERIODS * half <= top:
        apart = 2 * half
        many = int(np.searchsorted(-n_of, -PERIODS * half, side="right"))  # documents long enough for this octave
        o, n = starts[:many], n_of[:many]
        tiles = (n - 1) // apart
        owner = np.repeat(np.arange(many), tiles)
        bounds = o[owner] + apart * (np.arange(len(owner)) - np.repeat(np.cumsum(tiles) - tiles, tiles) + 1)
        end = int(o[-1] + n[-1]) + 3 * half if many else 0
        hashes = spans(np.arange(min(end, len(words) - half)), half) if many else None
        periods = np.arange(half, apart)
        rows = max(1, GROUP // half)
        for i in range(0, len(bounds), rows):
            b = bounds[i : i + rows]
            ahead = hashes[b[:, None] + periods] == hashes[b][:, None]
            back = hashes[b[:, None] - half + periods] == hashes[b - half][:, None]
            r, c = np.nonzero(ahead | back)
            if not len(r):
                continue
            at, q = b[r], periods[c]
            keep = _primitive(spans, np.where(ahead[r, c], at, at - half), half + q, q)
            at, q, who = at[keep], q[keep], owner[i : i + rows][r[keep]]
            lo = at - _reach(words, at - 1, q, apart, -1)
            hi = at + _reach(words, at, q, apart, 1)
            keep = hi - lo >= apart
            found.append((who[keep], q[keep], lo[keep] - starts[who[keep]], hi[keep] - starts[who[keep]]))
            # neighbouring tiles of this group that touch are one fragment
            who, q, lo, hi = found[-1]
            rank = np.lexsort((lo, q, who))
            who, q, lo, hi = who[rank], q[rank], lo[rank], hi[rank]
            new = np.ones(len(who), bool)
            new[1:] = (who[1:] != who[:-1]) | (q[1:] != q[:-1]) | (lo[1:] > hi[:-1])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(who)]]) - 1
            found[-1] = (who[first], q[first], lo[first], hi[last]) if len(who) else (none, none, none, none)
        half *= 2
    if not found:
        return none, none, none, none
    who, q, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    return order[who], q, lo, hi


def _words(text: bytes) -> np.ndarray:
    buf = np.frombuffer(text, np.uint8)
    return span_hashes(buf, *word_spans(buf))


def _tiled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each document, and one for each fragment of its runs."""
    texts = texts_of(batch)
    who, q, lo, hi = fragments([_words(x) for x in texts])
    has = set(who.tolist())
    split = [x.split() for x in texts]  # the white space of bytes is that of words
    plain = [b" ".join(x) for x in split]
    n, m = len(texts), len(who)
    keys = batch.column("k").to_pylist()
    ids = batch.column("doc_id")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys + [keys[i] for i in who]),
            pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
            pa.array([len(x) for x in split] + [None] * m, pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in plain] + [None] * m, pa.string()),
            pa.array([x if i in has else None for i, x in enumerate(plain)] + [None] * m, pa.binary()).cast(pa.string()),
            *(pa.array([None] * n + x.tolist(), pa.int64()) for x in (q, lo, hi)),
        ],
        ["k", "doc_id", "n_words", "plain_sha256", "words", "period", "lo", "hi"],
    )


def _collapse(batch: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for words, runs in zip(texts_of(batch, "words"), batch.column("runs").to_pylist(), strict=True):
        if not runs:
            out.append(None)
            continue
        split = words.split(b" ")
        edge = np.zeros(len(split) + 1, np.int64)
        for r in runs:
            edge[r["start"] + r["period"]] += 1
            edge[r["start"] + r["length"]] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        out.append(b" ".join([w for w, x in zip(split, gone.tolist(), strict=True) if not x]))
    at = batch.schema.get_field_index("words")
    columns = [c for i, c in enumerate(batch.columns) if i != at]
    return pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.binary()).cast(pa.string())], [*(x for x in batch.schema.names if x != "words"), "collapsed"])


def stitched(pieces: DataFrame) -> DataFrame:
    """``k, start, period, length`` of the runs whose fragments ``k, period, lo, hi`` are given."""
    order = W.partitionBy("k", "period").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    islands = pieces.withColumn("_new", F.coalesce((F.col("lo") > reach).cast("int"), F.lit(1))).withColumn("_i", F.sum("_new").over(order))
    runs = islands.groupBy("k", "period", "_i").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    return runs.filter(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), PERIODS * F.col("period"))).select("k", "start", "period", "length")


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed, plain_sha256`` of each document.

    ``runs`` are structs of first word, period and length, by first word and period.
    ``collapsed`` is the text without the words that repeat a run's first period, null
    where there are none; ``plain_sha256`` is the digest of all words, a space between two.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\n"), F.coalesce("text", F.lit("")))).alias("k"), "doc_id", "text")
    read = cut(map_batches(keyed, _tiled, f"k string, doc_id {kind}, n_words long, plain_sha256 string, words string, period long, lo long, hi long"))
    runs = stitched(read.filter("period IS NOT NULL").select("k", "period", "lo", "hi"))
    of = runs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    rows = read.filter("period IS NULL")
    clear = rows.filter("words IS NULL").select("doc_id", "n_words", "plain_sha256", F.lit(None).cast("array<struct<start:bigint,period:bigint,length:bigint>>").alias("runs"), F.lit(None).cast("string").alias("collapsed"))
    held = rows.filter("words IS NOT NULL").join(of, "k", "left").select("doc_id", "n_words", "plain_sha256", "runs", "words")
    done = map_batches(held, _collapse, f"doc_id {kind}, n_words long, plain_sha256 string, runs array<struct<start:bigint,period:bigint,length:bigint>>, collapsed string")
    return clear.unionByName(done).select("doc_id", "n_words", F.coalesce("runs", F.array()).alias("runs"), "collapsed", "plain_sha256")


def looped(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with a loop planted in about a tenth of the documents, drawn by their id's checksum."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    g, n = F.floor(h / 10), F.size("_w")
    chosen = docs.select("doc_id", "text", h.alias("_h"), F.when((h % 10 == 0) & F.col("text").isNotNull(), words).alias("_w"))
    a = F.when(n > 0, g % n)
    marked = chosen.withColumn("_a", a).withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + g % 8)))
    h = F.col("_h")
    loop = F.transform("_w", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return marked.select("doc_id", F.when(n > 0, F.array_join(loop, " ")).otherwise(F.col("text")).alias("text"))
