"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases: each phrase is the shortest run of
characters not seen as a phrase before, so its prefix is an earlier phrase.  The
phrases are hashed as a set; the signature holds the ``SLOTS`` smallest hashes, and
two signatures are compared by the share of the smallest hashes of their union that
both hold, an estimate of the phrase sets' Jaccard likeness.

The edited copy of a document needs its successor in falling order of id.  The rows
are cut into ranges of the id; the first row of a range goes along to the range
before it, so one exchange of the texts is all.  An edited text shares the parse of
its unchanged beginning with the original.

Defined cases: a null text is empty and its fingerprint is the empty string; two
empty fingerprints are alike (1), an empty and another are not (0); ids that repeat
are ordered by text, null ids come last; a single row is its own successor; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import BATCH_ROWS, longs, places_before, short_batches, span_hashes

SLOTS = 128
#: Documents of one range of ids (the mean) and ranges in all, which the driver sees.
RANGE_ROWS, MAX_RANGES = 2000, 4096


def parse(text: str, phrases: set[str], begin: int = 0) -> list[int]:
    """Ends of the phrases of ``text`` from ``begin`` on; ``phrases`` gathers them."""
    ends, start, add = [], begin, phrases.add
    for end in range(begin + 1, len(text) + 1):
        run = text[start:end]
        if run not in phrases:
            add(run)
            ends.append(end)
            start = end
    if start < len(text):
        ends.append(len(text))
    return ends


def signature(text: str, ends: list[int]) -> np.ndarray:
    """The smallest hashes (32 bits) of the set of phrases, ascending."""
    if not ends:
        return np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    stops = np.array(ends)
    hashes = (span_hashes(points, np.concatenate([[0], stops[:-1]]), stops) >> np.uint64(32)).astype(np.uint32)
    if len(hashes) > 4 * SLOTS:  # a few more than the slots, since a last phrase may repeat
        hashes = np.partition(hashes, 2 * SLOTS)[: 2 * SLOTS]
    return np.unique(hashes)[:SLOTS]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[: max(len(a), len(b))]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / len(union)


def show(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def edited(text: str, after: str) -> tuple[str, int]:
    """The edited text and the length of its unchanged beginning."""
    k = len(text) // 3
    return text[: len(text) - k] + after[:k], len(text) - k


def both_signatures(text: str, after: str) -> tuple[np.ndarray, str, np.ndarray]:
    """Signature of the text, its edited copy, signature of that."""
    changed, same = edited(text, after)
    phrases: set[str] = set()
    head = parse(text[:same], phrases)
    if head and len(head) > len(phrases):  # the last phrase was broken off, it may go on
        head.pop()
    begin = head[-1] if head else 0
    other = set(phrases)
    return (
        signature(text, head + parse(text, phrases, begin)),
        changed,
        signature(changed, head + parse(changed, other, begin)),
    )


FIELDS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _finish(waiting: tuple, following: np.ndarray) -> tuple:
    doc_id, text, own, changed, other = waiting
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), digest, show(own), show(other), likeness(own, other), likeness(own, following)


def _walk(id_type: pa.DataType):
    kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", *(f.split(" ")[0] for f in FIELDS.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order, each range with its guest last; of tied guests the first counts."""
        held = waiting = None
        for batch in batches:
            done = []
            for doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_guest")), strict=True):
                if guest and held is None:
                    continue
                if held is not None:
                    own, changed, other = both_signatures(held[1], text)
                    if waiting is not None:
                        done.append(_finish(waiting, own))
                    waiting = (*held, own, changed, other)
                held = None if guest else (doc_id, text)
                if guest:
                    done.append(_finish(waiting, signature(text, parse(text, set()))))
                    waiting = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*done, strict=True), kinds, strict=True)], names)

    return run


def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``FIELDS``: fingerprints of each text and of its edited copy."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_key"))
    ids = cut(rows.select("_key"))
    n = ids.count()
    ranges = min(MAX_RANGES, -(-n // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("_key", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else []
    places = sorted(set(cuts))
    where = F.lit(len(places)) - places_before([(c,) for c in places], F.struct(F.col("_key").alias("col1")))
    firsts = {r["_range"]: r["_key"] for r in ids.groupBy(where.alias("_range")).agg(F.max("_key").alias("_key")).take(1 << 24)}
    order = sorted(firsts)
    # the first row of a range is the guest of the one before, that of the first range of the last
    host = {r: order[i - 1] for i, r in enumerate(order)}
    first, before = [[of.get(r) for r in range(len(places) + 1)] for of in (firsts, host)]
    guest_of = F.when(F.get(longs(first), where) == F.col("_key"), F.get(longs(before), where)).cast("int")
    seats = F.array_compact(F.array(F.struct(where.cast("int").alias("r"), F.lit(False).alias("g")), F.when(guest_of.isNotNull(), F.struct(guest_of.alias("r"), F.lit(True).alias("g")))))
    placed = rows.withColumn("_at", F.explode(seats)).select("doc_id", "text", "_key", F.col("_at.r").alias("_range"), F.col("_at.g").alias("_guest"))
    ranged = placed.repartition(max(1, ranges), "_range").sortWithinPartitions("_range", "_guest", F.desc("_key"), "text")
    short_batches(spark, BATCH_ROWS)
    kind = docs.schema["doc_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind.simpleString()]
    return ranged.select("doc_id", "text", "_guest").mapInArrow(_walk(arrow), f"doc_id {kind.simpleString()}, {FIELDS}")
