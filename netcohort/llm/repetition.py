"""Repetition coverage: how much of a text sits inside repeated word windows and lines.

Every text is hashed once; windows of several word lengths come from rolling sums
of the word hashes, and a window seen earlier in the text covers its characters.
Nothing is shuffled.

Defined cases: null and empty texts have no words and fail the base rule; repeated
rows are judged alike; a text of one long word has no windows; other columns pass
through unchanged in :func:`drop_repetitive`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import code_points, covered, gram_hashes, map_batches, repeated, span_hashes, texts_of, word_spans

#: Published limits for the share of characters in repeated windows, by words a window.
WINDOW_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Fixed value: published limit for the share of characters in repeated lines.  The
#: count of lines is no rule: one repeated line of three says little.
LINE_CHAR_SHARE = 0.20
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

PROFILE = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_share double, line_char_share double, "
    + ", ".join(f"cover_{n} double" for n in WINDOW_LIMITS)
    + ", base_failed boolean, kept boolean"
)


def profile(text: bytes) -> tuple:
    """The row of ``PROFILE`` for one text."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(buf)
    n = len(starts)
    symbols = sum(text.count(bytes([c])) for c in SYMBOLS)
    if not n:
        return (0, 0, symbols, 0, 0, 0.0, 0.0, *[0.0] * len(WINDOW_LIMITS), True, False)
    points = code_points(buf)
    chars = points[ends] - points[starts]
    total = int(chars.sum())
    seen: set[bytes] = set()
    lines = dup_lines = dup_chars = 0
    for line in text.split(b"\n"):
        if not line.split():
            continue
        lines += 1
        if line in seen:
            dup_lines += 1
            dup_chars += len(line.decode("utf-8", "replace"))
        else:
            seen.add(line)
    words = span_hashes(buf, starts, ends)
    twice = repeated(gram_hashes(words, 3))
    repeat_words = int(covered(twice, 3, n).sum()) if twice.any() else 0
    cover = dict.fromkeys(WINDOW_LIMITS, 0.0)
    if repeat_words:
        for size in WINDOW_LIMITS:
            twice = repeated(gram_hashes(words, size), first=False)
            if not twice.any():  # then no longer window is found twice
                break
            cover[size] = int(chars[covered(twice, size, n)].sum()) / total
    line_share, line_char_share = dup_lines / max(lines, 1), dup_chars / max(int(points[-1]), 1)
    failed = n < MIN_WORDS or 100 * repeat_words > 50 * n
    kept = not failed and line_char_share <= LINE_CHAR_SHARE and all(cover[k] <= v for k, v in WINDOW_LIMITS.items())
    return (n, total, symbols, dup_lines, repeat_words, line_share, line_char_share, *cover.values(), failed, kept)


def repetition_profile(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the profile of each document, one row a row of ``docs``."""
    names = [f.split(" ")[0] for f in PROFILE.split(", ")]
    kinds = [{"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[f.split(" ")[1]] for f in PROFILE.split(", ")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = list(zip(*map(profile, texts_of(batch)), strict=True))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=True))], ["doc_id", *names])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PROFILE}")


def drop_repetitive(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text fails, all columns kept."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = pa.array([profile(x)[-1] for x in texts_of(batch)], pa.bool_())
        return batch.filter(keep)

    return map_batches(docs, run, docs.schema)

