"""Token counts of whole texts, huge ones by overlapping chunks that are spliced.

A huge text is encoded chunk by chunk.  Neighbouring chunks overlap; they are
spliced at a position where both have a token start and that is proven stable: a
space after a character that is no white space.  The vocabulary's word pattern
never crosses such a position and looks neither back over it nor further ahead
than it, so tokens on either side do not depend on the other.  Where the overlap
holds no such position, it is doubled, up to the whole chunk, then the chunk grows.

Shorter texts are cut at the same proven positions into pieces whose counts are
remembered, since most pieces recur.

Defined cases: null and empty texts have no tokens; repeated rows count alike; a
text without white space is encoded as one piece.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Code points of a chunk and of the overlap it starts with.
CHUNK, OVERLAP = 1 << 15, 1 << 9
LIMIT = 512
#: Remembered pieces; the memory is emptied when it is full.
MEMORY = 400_000

_STABLE = re.compile(r"(?<=\S) ")
_UNSTABLE = re.compile(r"\s ")
_LOADED: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens with one tokenizer file; one for each worker and file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}

    def starts(self, text: str, at: int) -> list[int]:
        """Where the tokens of ``text`` start, ``at`` added."""
        return [at + a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def short(self, text: str) -> int:
        """Count by remembered pieces; a piece begins with the space before it."""
        if not text:
            return 0
        pieces = _STABLE.split(text) if _UNSTABLE.search(text) else text.split(" ")
        if len(pieces) > 1 and not pieces[0]:  # the text begins with a space, which no character precedes
            pieces[:2] = [" " + pieces[1]]
        first, rest = pieces[0], pieces[1:]
        known = self.known
        new = list({p for p in rest if p not in known})
        if new:
            if len(known) + len(new) > MEMORY:
                known.clear()
                new = list(set(rest))
            known.update(zip(new, map(len, self.tokenizer.encode_batch_fast([" " + p for p in new], add_special_tokens=False)), strict=True))
        return len(self.tokenizer.encode(first, add_special_tokens=False)) + sum(map(known.__getitem__, rest))

    def long(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """Count by overlapping chunks with offsets, spliced at stable positions."""
        n, total = len(text), 0
        begin, end = 0, min(chunk, len(text))
        left = self.starts(text[begin:end], begin)
        while end < n:
            lap = min(overlap, end - begin)
            while True:
                low = end - lap
                high = min(n, low + max(chunk, 2 * lap))
                right = self.starts(text[low:high], low)
                mine, at = set(left[bisect_left(left, low) :]), None
                for x in reversed(right[: bisect_left(right, end)]):
                    if x > low and x in mine and text[x] == " " and not text[x - 1].isspace():
                        at = x
                        break
                if at is not None or lap >= end - begin:
                    break
                lap = min(2 * lap, end - begin)
            if at is None:  # no stable position in the whole chunk: let it grow
                end = min(n, begin + 2 * (end - begin))
                left = self.starts(text[begin:end], begin)
                continue
            total += bisect_left(left, at)
            left = right[bisect_left(right, at) :]
            begin, end = at, high
        return total + len(left)

    def count(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        return self.long(text, chunk, overlap) if len(text) > chunk else self.short(text)


def counter(path: str) -> PieceCounter:
    if path not in _LOADED:
        _LOADED[path] = PieceCounter(path)
    return _LOADED[path]


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of each document.

    ``path`` names the tokenizer file; each worker opens it by itself.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = counter(path)
        texts = [x or "" for x in batch.column("text").to_pylist()]
        counts = [own.count(x, chunk, overlap) for x in texts]
        sizes = [len(x.encode()) for x in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
