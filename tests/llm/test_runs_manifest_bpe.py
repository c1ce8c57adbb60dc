"""Periodic runs, the Merkle manifest and pair-index coding against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netcohort.llm import bpe, merkle, periods, queries
from test_operators import SF, empty, odd  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# periodic runs


def runs_of(words):
    """Every run, by comparing the words with themselves at each distance."""
    ids = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    runs = {}
    for q in range(1, len(x) // 4 + 1):
        edge = np.diff(np.concatenate([[0], (x[q:] == x[:-q]).astype(int), [0]]))
        for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
            if b - a + q >= max(6, 4 * q):
                runs.setdefault((int(a), int(b - a) + q), q)
    return sorted((a, q, n) for (a, n), q in runs.items())


def collapsed(words, runs):
    gone = set()
    for a, q, n in runs:
        gone |= set(range(a + q, a + n))
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = WORD.findall(text or "")
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def loops():
    r = random.Random(9)
    fib = ["a", "b"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    words = [f"v{i}" for i in range(50)]
    texts = ["a " * n for n in (5, 6, 7, 300)] + [" ".join(fib[-1]), " ".join("abab" * 40 + "c" + "ba" * 50)]
    texts += [" ".join(r.choices("ab", k=k)) for k in (40, 400, 2500)]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            unit = r.choices(words, k=r.choice([1, 2, 3, 4, 7, 8, 16, 31, 33, 100]))
            parts += r.choices(words, k=r.randint(0, 9)) + unit * r.randint(2, 6) + unit[: r.randint(0, len(unit))]
        texts.append(" ".join(parts))
    # loops of loops: a period that holds a run itself
    texts.append(" ".join(("x y " * 5 + "z ").split() * 6))
    return texts


def test_every_run_is_found_whole(spark):
    texts = loops()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    for row in periods.periodic_runs(docs).collect():
        words = WORD.findall(texts[row["doc_id"]])
        want = runs_of(words)
        assert [(x["start"], x["period"], x["length"]) for x in row["runs"]] == want, row["doc_id"]
        assert row["n_words"] == len(words)
        assert (sha(row["collapsed"]) if row["collapsed"] is not None else row["plain_sha256"]) == sha(collapsed(words, want))


def test_groups_of_tiles_are_stitched(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "a " * 5000 + "b " + "c d e " * 900)], "doc_id long, text string")
    whole = periods.fragments([periods._words(b"a " * 5000)])
    monkeypatch.setattr(periods, "GROUP", 64)
    parts = periods.fragments([periods._words(b"a " * 5000)])
    assert len(whole[0]) == 1 and len(parts[0]) > 10 and set(parts[1]) == {1}
    pieces = spark.createDataFrame([("k", int(q), int(a), int(b)) for q, a, b in zip(*parts[1:])], "k string, period long, lo long, hi long")
    assert [tuple(x) for x in periods.stitched(pieces).collect()] == [("k", 0, 1, 5000)]
    assert [(x["start"], x["period"], x["length"]) for x in periods.periodic_runs(docs).first()["runs"]] == [(0, 1, 5000), (5001, 3, 2700)]


def digest_row(doc_id, text):
    words = planted(doc_id, text)
    runs = runs_of(words)
    best = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
    head = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(runs), *head, sha("".join(f"{a},{n},{q}\n" for a, q, n in runs)), sha(collapsed(words, runs)))


def test_registered_runs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, queries.op11(spark, SF).collect()))
    assert got == sorted(digest_row(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").collect())
    assert any(x[1] for x in got)


def test_runs_of_odd_rows(odd, empty):  # noqa: F811
    got = periods.periodic_runs(periods.looped(odd)).select("doc_id", "n_words", "runs").collect()
    want = [(x["doc_id"], planted(x["doc_id"], x["text"])) for x in odd.select("doc_id", "text").collect()]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1:])
    rows = sorted(((x[0], x[1], [(r["start"], r["period"], r["length"]) for r in x[2]]) for x in got), key=key)
    assert rows == sorted(((i, len(w), runs_of(w)) for i, w in want), key=key)
    assert periods.periodic_runs(periods.looped(empty)).count() == 0
    texts = odd.selectExpr("cast(doc_id as string) AS doc_id", "text")
    assert periods.periodic_runs(periods.looped(texts)).count() == len(want)


# Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def coded(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    rows = [nodes]
    while len(rows[-1]) > 1:
        rows.append([H(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def manifest(rows):
    leaf = lambda r, t: H(*map(coded, (r["doc_id"], r["source"], r["lang"], r["n_chars"], t)))
    of = {}
    for r in rows:
        seen = r["text"]
        if seen is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
            seen = seen.replace("\n", "")
        of.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), leaf(r, seen), r["doc_id"]))
    names = sorted(of, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(of[s])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, now, doc) in enumerate(sorted(of[s])):
            proof = []
            for levels, j in ((trees[s], i), (top, k)):
                for row in levels[:-1]:
                    first = j - j % 3
                    left, right = row[first:j], row[j + 1 : first + 3]
                    proof += left + right
                    now = H(*left, now, *right)
                    j //= 3
            out.append((doc, own, trees[s][-1][0], top[-1][0], H(*proof), now, now == top[-1][0]))
    return sorted(out, key=lambda x: (x[0] is not None, x))


def found(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.columns == names
    return sorted((tuple(x) for x in df.collect()), key=lambda x: (x[0] is not None, x))


FIELDS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, sid long, slot long, other int"


def made(n, seed, sources=5):
    r = random.Random(seed)
    ids = r.sample([*range(-40, 400), 70_000, 1 << 40, -(1 << 62), (1 << 63) - 1, -(1 << 63)], n)
    source = lambda: r.choice([None, "", "s", "S", "é", "z|;"][: sources + 1])
    return [(i, source(), r.choice([None, "en"]), r.choice([None, 7]), r.choice([None, "", "a\nb", "plain", "x\n" * 50]), "l", 3, 4, None) for i in ids]


@pytest.mark.parametrize("levels", [merkle.LEVELS, 2])
def test_manifest_equals_the_trees(spark, levels):
    rows = made(260, 4)
    rows += rows[:7] + [(rows[0][0], rows[0][1], "other", 1, "same id", "l", 3, 4, None)] + [(None, "s", None, i % 2, str(i // 3), None, None, None, None) for i in range(9)]
    docs = spark.createDataFrame(rows, FIELDS).repartition(5)
    assert found(merkle.document_manifest(docs, levels)) == manifest([dict(zip(docs.columns, r)) for r in rows])


def test_small_manifests(spark, odd, empty):  # noqa: F811
    assert merkle.document_manifest(empty).count() == 0
    one = spark.createDataFrame([(5, None, None, None, None, None, None, None, None)], FIELDS)
    got = found(merkle.document_manifest(one))
    assert got == manifest([one.first().asDict()]) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == sha("")
    assert found(merkle.document_manifest(odd)) == manifest([x.asDict() for x in odd.collect()])
    with pytest.raises(TypeError, match="integer"):
        merkle.document_manifest(odd.withColumn("doc_id", odd["doc_id"].cast("string")))


def test_registered_manifest(spark):
    got = found(queries.op12(spark, SF))
    assert got == manifest([x.asDict() for x in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    assert 0 < sum(x[-1] for x in got) < len(got)


# pair-index coding


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def coded_texts():
    r = random.Random(3)
    alphabet = ["a", "b", "e", "t", "s", "'", "'s", "'LL", "İ", "Σ", "ß", "é", "é", "́", "中", "文", "👍", "9", "½", "!", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "  ", "\n", " ", " ", "\u0000", "_", "-", "@"]
    texts = ["".join(r.choices(alphabet, k=r.randint(1, 60))) for _ in range(400)]
    return texts + ["a" * 4000, "abcab" * 900, "ha" * 777, "x" * 70_001, "the " * 500, "<|endoftext|>" * 3, "", " ", "\n\n"]


def test_coding_equals_the_library(spark, library):
    texts = coded_texts()
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [("n", None), (None, "no id")], "doc_id string, text string").repartition(3)
    got = {x["doc_id"]: x for x in bpe.bpe_decode(bpe.bpe_encode(docs, PATH), PATH).collect()}
    assert len(got) == len(texts) + 2 and got["n"]["n_tokens"] == 0 and got["n"]["decoded"] == ""
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[str(i)]["ids"], "<u4").tolist() == want, t[:80]
        assert got[str(i)]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_ranks_that_come_to_life_late():
    """A merge may make a pair of a lower rank; the word's other places wait for it."""
    codec = bpe.PairIndexCodec(PATH)
    names = ["a", "b", "c", "ab", "abc", "bc"]
    codec.vocab, codec.tail = {x: i for i, x in enumerate(names)}, ""
    codec.merges = {(3, 0): (0, 4), (0, 1): (5, 3)}  # "ab"+"a" before "a"+"b"

    def slow(word):
        at = [codec.vocab[c] for c in word]
        while True:
            ranked = [(codec.merges[p][0], i) for i, p in enumerate(zip(at, at[1:])) if p in codec.merges]
            if not ranked:
                return at
            i = min(ranked)[1]
            at[i : i + 2] = [codec.merges[at[i], at[i + 1]][1]]

    r = random.Random(1)
    words = ["".join(r.choices("abc", k=r.randint(1, 30))) for _ in range(300)]
    assert codec.encode_words(words) == [slow(w) for w in words]


def test_memory_may_be_emptied(library, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 10)
    codec = bpe.PairIndexCodec(PATH)
    for i in range(6):
        texts = [f"word{i} some other text number {k}" for k in range(9)]
        assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)] == [library.encode(t).ids for t in texts]


def test_coding_of_odd_rows(odd, empty):  # noqa: F811
    assert bpe.bpe_encode(odd, PATH).count() == odd.count()
    assert bpe.bpe_decode(bpe.bpe_encode(empty, PATH), PATH).count() == 0
    assert len(queries.QUERIES) >= 13
