"""Shared pieces of the corpus operators: reading, Arrow batches, word arrays, hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python: texts may be long, so batches are short.
BATCH_ROWS = 256

#: Words everywhere in this subpackage: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
#: An odd multiplier and its inverse modulo 2**64, for position-free substring hashes.
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def longs(values: list[int | None]) -> Column:
    """A constant array of longs."""
    return F.expr("array(" + ", ".join("CAST(NULL AS LONG)" if v is None else f"{v}L" for v in values) + ")")


def places_before(keys: list[tuple[int, ...]], own: Column) -> Column:
    """How many of the sorted ``keys`` are at or before the struct ``own``.

    The keys lie in blocks of about the square root of their number: a row looks through
    the blocks' first keys and then through one block.
    """
    if not keys:
        return F.lit(0)
    step = isqrt(len(keys)) + 1
    one = lambda key: "struct(" + ", ".join(f"{v}L" for v in key) + ")"
    blocks = [keys[i : i + step] for i in range(0, len(keys), step)]
    firsts = F.expr("array(" + ", ".join(one(b[0]) for b in blocks) + ")")
    held = F.expr("array(" + ", ".join("array(" + ", ".join(map(one, b)) + ")" for b in blocks) + ")")
    before = F.size(F.filter(firsts, lambda p: p <= own)) - 1
    return F.when(own < F.expr(one(keys[0])), 0).otherwise(before * step + F.size(F.filter(F.get(held, before), lambda p: p <= own)))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``mapInArrow`` that hands ``fn`` slices of at most ``rows`` rows.

    Spark's own batch length is lowered too, so that a batch of long texts stays
    small on both sides of the pipe.
    """
    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def short_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values evenly."""
    x = x ^ (x >> _S)
    x = x * _M1
    x = x ^ (x >> _S)
    x = x * _M2
    return x ^ (x >> _S)


def _powers(which: str, n: int) -> np.ndarray:
    have = _POWERS[which]
    if len(have) < n:
        by = _BASE if which == "up" else _UNBASE
        while len(have) < n:
            step = np.uint64(pow(by, len(have), 1 << 64))
            have = np.concatenate([have, have * step])
        _POWERS[which] = have
    return have[:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``symbols[start:end]`` for each span, free of its position."""
    n = len(symbols)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * _powers("up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers("down", n + 1)[starts])


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of a UTF-8 text."""
    gap = np.ones(len(buf) + 2, np.int8)
    gap[1:-1] = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.diff(gap)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each window of ``n`` words, from the words' hashes."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out += words[k : k + m] * _powers("up", n + 2)[k + 1]
    return mix(out)


def repeated(hashes: np.ndarray, first: bool = True) -> np.ndarray:
    """Mask of the values that occur more than once, with or without their first time."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = True
    if first:
        out[order[:-1][same]] = True
    return out


def covered(starts_mask: np.ndarray, n: int, length: int) -> np.ndarray:
    """Positions covered by windows of ``n`` that start where the mask is set."""
    edge = np.zeros(length + 1, np.int32)
    at = np.flatnonzero(starts_mask)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


def code_points(buf: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte offset (length + 1 entries)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out

