"""Best-fit packing under conflicts.

Documents are cut into pieces of at most the capacity and dealt by hash into cells
of bounded size, each packed by itself.  In a cell the pieces go by falling size.
Open bins are kept in the order of their residual; a search starts at the smallest
residual that holds the piece and goes on to its successors until it finds the
tightest bin whose bitmaps of sources and of duplicate clusters share no bit with
the piece.  So a bin never holds two documents of one source or of one cluster.

Only ids, sizes, sources and cluster ids are shuffled, never texts.  A hot source or
cluster is spread over all cells by the hash.

Defined cases: documents without words are not packed and give no rows; a null
source is a source of its own; repeated rows are pieces of one cluster and so lie in
different bins; a document longer than the capacity fills bins alone with its full
pieces; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .mixing import word_count

#: Words of a bin, pieces of a cell (the mean), bins looked at together in a search.
CAPACITY, CELL_PIECES, BLOCK = 4096, 4096, 128

PACKED = "bin_id long, place int, start int, size int, residual int"


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and residual at its end of each piece, the pieces in the given order.

    ``sources`` and ``clusters`` are numbers from 0; a cluster below 0 meets nothing.
    """
    n = len(sizes)
    words = int(sources.max(initial=0)) // 64 + 1
    residual = np.zeros(n, np.int64)  # of open bins, ascending
    label = np.zeros(n, np.int64)
    held = np.zeros((words, n), np.uint64)  # bitmap of sources, in the order of residual
    cluster_bits = [0] * n
    where = np.zeros(n, np.int64)
    left = np.zeros(n, np.int64)
    count = made = 0
    for i in range(n):
        size, word, bit = sizes[i], sources[i] // 64, np.uint64(1 << int(sources[i] % 64))
        own = 1 << int(clusters[i]) if clusters[i] >= 0 else 0
        at, found = int(np.searchsorted(residual[:count], size)), -1
        while at < count and found < 0:
            free = np.flatnonzero((held[word, at : min(at + BLOCK, count)] & bit) == 0)
            for k in free:
                if not cluster_bits[label[at + k]] & own:
                    found = at + int(k)
                    break
            at += BLOCK
        if found < 0:
            name, rest, bits = made, capacity - size, np.zeros(words, np.uint64)
            made += 1
        else:
            name, rest, bits = int(label[found]), residual[found] - size, held[:, found].copy()
            residual[found : count - 1] = residual[found + 1 : count]
            label[found : count - 1] = label[found + 1 : count]
            held[:, found : count - 1] = held[:, found + 1 : count]
            count -= 1
        bits[word] |= bit
        cluster_bits[name] |= own
        where[i], left[name] = name, rest
        if rest > 0:
            to = int(np.searchsorted(residual[:count], rest))
            residual[to + 1 : count + 1] = residual[to:count]
            label[to + 1 : count + 1] = label[to:count]
            held[:, to + 1 : count + 1] = held[:, to:count]
            residual[to], label[to], held[:, to] = rest, name, bits
            count += 1
    return where, left[where]


def _pack_cell(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_size", "_tie", "_piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sources = pd.factorize(pdf["_source"].fillna("\0null"))[0]
        numbers, values = pd.factorize(pdf["_cluster"])
        often = np.bincount(numbers, minlength=len(values)) > 1  # a cluster met once needs no bit
        bit_of = np.where(often, np.cumsum(often) - 1, -1)
        where, left = pack(pdf["_size"].to_numpy(), sources.astype(np.int64), bit_of[numbers], capacity)
        pdf["bin_id"] = pdf["_cell"].to_numpy() * (1 << 32) + where
        pdf["residual"] = left.astype(np.int32)
        by = pdf.groupby("bin_id")["_size"]
        pdf["place"] = pdf.groupby("bin_id").cumcount().astype(np.int32)
        pdf["start"] = (by.cumsum() - pdf["_size"]).astype(np.int32)
        pdf["size"] = pdf["_size"].astype(np.int32)
        return pdf[["_id", "_source", "_cluster", "_piece", "_pieces", "bin_id", "place", "start", "size", "residual"]]

    return run


def pack_rows(df: DataFrame, row_id: Column, source: Column, cluster: Column, size: Column, capacity: int = CAPACITY, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """``row_id, source, cluster, piece, pieces`` and ``PACKED``, one row a piece.

    ``start`` is the piece's first word in its bin, ``residual`` what the bin leaves free.
    """
    rows = cut(df.select(row_id.alias("_id"), source.cast("string").alias("_source"), cluster.cast("long").alias("_cluster"), size.cast("long").alias("_words")).filter("_words > 0"))
    n = rows.agg(F.coalesce(F.sum(F.ceil(F.col("_words") / capacity)), F.lit(0)).alias("n")).first()["n"]
    cells = max(1, -(-n // cell_pieces))
    pieces = rows.withColumn("_pieces", F.ceil(F.col("_words") / capacity).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)).alias("_piece")
    )
    pieces = pieces.withColumn("_size", F.least(F.lit(capacity).cast("long"), F.col("_words") - F.col("_piece").cast("long") * capacity))
    key = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_piece", "_words", F.lit("cell"))
    tie = F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), "_piece")
    pieces = pieces.select("_id", "_source", "_cluster", "_piece", "_pieces", "_size", tie.alias("_tie"), F.pmod(key, F.lit(cells)).alias("_cell"))
    kind = rows.schema["_id"].dataType.simpleString()
    out = pieces.groupBy("_cell").applyInPandas(_pack_cell(capacity), f"_id {kind}, _source string, _cluster long, _piece int, _pieces int, {PACKED}")
    return out.withColumnsRenamed({"_id": "row_id", "_source": "source", "_cluster": "cluster", "_piece": "piece", "_pieces": "pieces"})


def pack_documents(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pack documents by words; documents with equal texts are one duplicate cluster."""
    packed = pack_rows(docs, F.col("doc_id"), F.col("source"), F.xxhash64(F.col("text")), word_count(F.col("text")), capacity)
    return packed.withColumnRenamed("row_id", "doc_id")
