"""Byte-pair encoding and decoding by an index of pair occurrences.

All words that a batch brings and the worker has not met are laid out as one chain of
symbols.  An index maps each mergeable pair to its positions in that chain.  The active
ranks are taken in ascending order: a rank's pair is merged at all its positions at
once, from left to right, and only the lists of the neighbouring pairs are updated.  A
merge that brings a lower rank to life puts its own remaining positions back first, so
every word sees its merges in exactly the order of a word-by-word encoder.

Texts are cut at spaces and line ends, which no word crosses; pieces and words keep their
ids while the worker remembers them, so a batch costs what is new in it.  Normalisation
and the split into words are those of the tokenizer file, with the library's tables of
characters; pieces of printable ASCII are split by the file's own pattern.

Defined cases: null and empty texts have no tokens and decode to an empty text; repeated
rows encode alike; strings of special tokens inside a text are special tokens, as is the
library's default; a word of any length is one chain; an empty table gives no rows; ids
of any type pass through.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches

#: Remembered pieces of text, and words; either memory is emptied when it is full.
MEMORY = 500_000
_LOADED: dict[str, PairIndexCodec] = {}


class PairIndexCodec:
    """One tokenizer file with word ends, opened once for each worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        known = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
        if model["type"] != "BPE" or any((model.get(k) or v) != v for k, v in known.items()) or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"{path}: only plain pair merging without a decoder is understood")
        tokenizer = Tokenizer.from_file(path)
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.vocab: dict[str, int] = model["vocab"]
        self.tail: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        special = spec["added_tokens"]
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] or re.search(r"\s", x["content"]) for x in special):
            raise ValueError(f"{path}: only plain added tokens are understood")
        self.special = {x["content"]: x["id"] for x in special}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        names = dict(self.vocab) | self.special
        self.names: list[str] = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.plain = self._plain_split(spec)

    @staticmethod
    def _plain_split(spec: dict) -> Callable[[str], list[str]] | None:
        """The file's split for lower-case printable ASCII, if it is of the usual form."""
        steps = [x["type"] for x in spec["normalizer"].get("normalizers", [])]
        first, *rest = spec["pre_tokenizer"].get("pretokenizers", [{}])
        if steps != ["NFC", "Replace", "Lowercase"] or first.get("type") != "Split" or [x["type"] for x in rest] != ["ByteLevel"]:
            return None
        pattern = first["pattern"].get("Regex", "").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9")
        return re.compile(pattern, re.ASCII).findall if pattern and r"\p" not in pattern else None

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by the pair occurrence index over all of them."""
        symbols: list[int] = []
        firsts = []
        after: list[int] = []
        for w in words:
            firsts.append(len(symbols))
            symbols += [self.vocab[c] for c in w[:-1]]
            symbols.append(self.vocab[w[-1] + self.tail])
            after += range(firsts[-1] + 1, len(symbols))
            after.append(-1)
        before = [-1] * len(symbols)
        for p, q in enumerate(after):
            if q >= 0:
                before[q] = p
        merges: dict[tuple[int, int], tuple[int, int]] = self.merges
        places: dict[tuple[int, int], list[int]] = {}
        for p, pair in enumerate(zip(symbols, symbols[1:])):
            if pair in merges and after[p] >= 0:
                if pair in places:
                    places[pair].append(p)
                else:
                    places[pair] = [p]
        active = [(merges[pair][0], pair) for pair in places]
        heapq.heapify(active)
        while active:
            rank, pair = heapq.heappop(active)
            at = sorted(places.pop(pair))
            one, two = pair
            new = merges[pair][1]
            for k, p in enumerate(at):
                q = after[p]
                if symbols[p] != one or q < 0 or symbols[q] != two:
                    continue  # a neighbour was merged meanwhile
                left, right = before[p], after[q]
                symbols[p], symbols[q], after[p] = new, -1, right
                if right >= 0:
                    before[right] = p
                lower = False
                if left >= 0 and (fresh := (symbols[left], new)) in merges:
                    if fresh in places:
                        places[fresh].append(left)
                    else:
                        places[fresh] = [left]
                        heapq.heappush(active, (merges[fresh][0], fresh))
                    lower = merges[fresh][0] < rank
                if right >= 0 and (fresh := (new, symbols[right])) in merges:
                    if fresh in places:
                        places[fresh].append(p)
                    else:
                        places[fresh] = [p]
                        heapq.heappush(active, (merges[fresh][0], fresh))
                    lower = lower or merges[fresh][0] < rank
                if lower and k + 1 < len(at):
                    places[pair] = at[k + 1 :]
                    heapq.heappush(active, (rank, pair))
                    break
        out = []
        for p in firsts:
            ids = []
            while p >= 0:
                ids.append(symbols[p])
                p = after[p]
            out.append(ids)
        return out

    def split_piece(self, piece: str) -> list[str | int]:
        """Words of a piece in the byte alphabet, and ids of special tokens."""
        if self.plain is not None and piece.isascii() and piece.isprintable() and not (self.cut and self.cut.search(piece)):
            return self.plain(piece.lower())
        out: list[str | int] = []
        for i, x in enumerate(self.cut.split(piece) if self.cut else [piece]):
            if i % 2:
                out.append(self.special[x])
            elif x:
                out += [w for w, _ in self.split(self.normalize(x)) if w]
        return out

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode the pieces that are not remembered, all their new words together."""
        new = list({x for x in pieces if x not in self.known})
        parts = [self.split_piece(x) for x in new]
        if len(self.words) > MEMORY:
            self.words.clear()
        ids = self.words
        words = list({x for part in parts for x in part if x not in ids and isinstance(x, str)})
        for w, x in zip(words, self.encode_words(words), strict=True):
            ids[w] = struct.pack(f"<{len(x)}I", *x)
        for piece, part in zip(new, parts, strict=True):
            self.known[piece] = b"".join([x.to_bytes(4, "little") if isinstance(x, int) else ids[x] for x in part])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [x.replace("\n", " ").split(" ") for x in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        self.learn(chain.from_iterable(cut))
        return [b"".join(map(self.known.__getitem__, x)) for x in cut]

    def decode(self, ids: bytes) -> str:
        """What the library's ``decode`` gives without a decoder: the tokens, a space between two."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def codec(path: str) -> PairIndexCodec:
    if path not in _LOADED:
        _LOADED[path] = PairIndexCodec(path)
    return _LOADED[path]


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` of each document; ``ids`` are little-endian unsigned 32-bit integers."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec(path).encode([x or "" for x in batch.column("text").to_pylist()])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text ``decoded`` that its ``ids`` stand for."""
    own = [c for c in encoded.columns if c.lower() != "decoded"]
    schema = encoded.select(*own).schema.add("decoded", "string")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [None if x is None else codec(path).decode(x) for x in batch.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*own, "decoded"])

    return map_batches(encoded.select(*own), run, schema)
