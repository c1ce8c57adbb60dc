"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fingerprints, jaccard, merkle, mixing, packing, periods, repeats, repetition, revisits, secrets, shards, tokens
from .common import documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: The tokenizer file that the token counts use.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: The tokenizer file that texts are encoded and decoded with.
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return wrap


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), TOKENIZER)


_COVERED = "\nUNION ALL ".join(
    f"""SELECT doc_id, {n} AS size, sum(chars) AS c FROM words w WHERE EXISTS (
      SELECT 1 FROM grams{n} g WHERE g.doc_id = w.doc_id AND w.pos - g.pos BETWEEN 0 AND {n - 1} AND g.{'k' if n == 3 else 'again'} > 1) GROUP BY doc_id"""
    for n in (3, *repetition.WINDOW_LIMITS)
)
OP5_SQL = (
    r"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, pos, word, length(word) AS chars FROM (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM texts))),
"""
    + ",\n".join(
        f"""grams{n} AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS k, row_number() OVER (PARTITION BY doc_id, g ORDER BY pos) AS again FROM (SELECT doc_id, pos, """
        + " || ' ' || ".join(f"lead(word, {i}) OVER (PARTITION BY doc_id ORDER BY pos)" if i else "word" for i in range(n))
        + " AS g FROM words) WHERE g IS NOT NULL)"
        for n in (3, *repetition.WINDOW_LIMITS)
    )
    + ",\ncovers AS ("
    + _COVERED.replace("SELECT doc_id, 3 AS size, sum(chars) AS c", "SELECT doc_id, 3 AS size, count(*) AS c", 1)
    + r"""),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup, sum(length(line)) - sum(CASE WHEN first THEN length(line) ELSE 0 END) AS dup_chars
  FROM (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line) = 1 AS first FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')) GROUP BY doc_id),
base AS (SELECT doc_id, length(text) AS total_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM texts),
counts AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars FROM words GROUP BY doc_id),
row_of AS (SELECT b.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce((SELECT c FROM covers v WHERE v.doc_id = b.doc_id AND size = 3), 0)::BIGINT AS n_repeat_words,
  coalesce(dup, 0) / greatest(coalesce(l.n, 0), 1) AS line_share, coalesce(dup_chars, 0) / greatest(total_chars, 1) AS line_char_share
  FROM base b LEFT JOIN counts c USING (doc_id) LEFT JOIN lines l USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM row_of)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND line_char_share <= """
    + f"{repetition.LINE_CHAR_SHARE}"
    + " AND NOT EXISTS (SELECT 1 FROM covers v WHERE v.doc_id = j.doc_id AND ("
    + " OR ".join(f"size = {n} AND c / word_chars > {x}" for n, x in repetition.WINDOW_LIMITS.items())
    + ")) AS kept FROM judged j"
)


@query("op5_repetition_coverage", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repetition.repetition_profile(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_histogram_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = shards.document_shards(documents(spark, sf_dir))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_source_mix")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix_documents(documents(spark, sf_dir))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


@query("op6_conflict_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


@query("op2_phrase_fingerprints")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.phrase_fingerprints(documents(spark, sf_dir))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(documents(spark, sf_dir))


OP8_SQL = r"""WITH bare AS (SELECT page_id, coalesce(html, '') AS html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS b FROM pages),
parts AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
  regexp_replace(regexp_extract(b, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)='))) AS asked FROM bare),
p AS (SELECT page_id, html, host || path || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END AS url, '"' || md5(html) || '"' AS tag FROM parts),
responses AS (SELECT page_id * 2 AS id, page_id * 10 AS ts, url, tag, strlen(html) AS n FROM p WHERE page_id % 17 <> 0),
revisits AS (SELECT page_id * 2 + 1 AS record_id, page_id * 10 + (page_id % 5 - 1) * 10 + 5 AS ts, url, page_id % 100 AS age,
  CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN '"0"' WHEN page_id % 3 = 0 THEN 'W/' || tag ELSE tag END AS asked FROM p),
ranked AS (SELECT v.*, r.id, r.tag, r.n, row_number() OVER (PARTITION BY v.record_id ORDER BY r.ts DESC, r.id DESC) AS k FROM revisits v LEFT JOIN responses r ON v.url = r.url AND r.ts < v.ts),
judged AS (SELECT *, CASE WHEN id IS NULL THEN 'no earlier response' WHEN asked IS NULL THEN 'no validator'
  WHEN regexp_replace(asked, '^W/', '') = tag THEN 'resolved' ELSE 'validator differs' END AS outcome FROM ranked WHERE k = 1)
SELECT record_id, url, CASE WHEN outcome = 'resolved' THEN id END AS response_id, outcome, CASE WHEN outcome = 'resolved' THEN
  'cache-control: max-age=' || age || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'etag: ' || asked END AS headers FROM judged"""


@query("op8_revisit_resolution", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve_revisits(revisits.page_captures(table(spark, sf_dir, "pages")))


OP9_SQL = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s FROM words WHERE len(ws) > 0),
grams AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * c >= 75 * (len(x.s) + len(y.s) - c)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(len(s), 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN least USING (doc_id)"""


@query("op9_ngram_jaccard_join", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir))


@query("op1_repeated_passages")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(documents(spark, sf_dir))


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periods.periodic_runs(periods.looped(documents(spark, sf_dir)))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return got.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("(1000 * _best.length) div -_best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.coalesce(F.sha2("collapsed", 256), F.col("plain_sha256")).alias("collapsed_sha256"),
    )


def _tree_sql(name: str, levels: int, by: str) -> str:
    """Levels ``{name}0..`` over ``{name}0 (by, slot, node, total)`` and the runs of each."""
    ctes = []
    for k in range(levels):
        ctes.append(f"{name}r{k} AS MATERIALIZED (SELECT {by}, slot // 3 AS run, list(node ORDER BY slot) AS nodes, max(total) AS total FROM {name}{k} GROUP BY {by}, slot // 3)")
        ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {by}, run AS slot, CASE WHEN total > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node, (total + 2) // 3 AS total FROM {name}r{k})")
    return ",\n".join(ctes)


def _climb_sql(name: str, rows: str, levels: int, by: str) -> str:
    """``{rows}0..``: each row's folded digest and proof, level by level over the tree ``name``."""
    left, right = "array_to_string(nodes[1:slot % 3], '')", "array_to_string(nodes[slot % 3 + 2:], '')"
    return ",\n".join(
        f"""{rows}{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, s, f.{by}, run AS slot, CASE WHEN total > 1 THEN sha256({left} || now || {right}) ELSE now END AS now,
  CASE WHEN total > 1 THEN proof || {left} || {right} ELSE proof END AS proof FROM {rows}{k} f JOIN {name}r{k} r ON f.{by} = r.{by} AND f.slot // 3 = r.run)"""
        for k in range(levels)
    )


def _field_sql(text: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({p}) || ':' || {p}, '-')" for p in parts) + ")"


#: Levels of the SQL form: 531 441 documents a source and 729 sources.
_DEEP, _WIDE = 12, 6
OP12_SQL = f"""WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM range(256) t(i))),
summed AS (SELECT *, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) AS h FROM documents, crc),
base AS (SELECT doc_id, CASE WHEN source IS NULL THEN '-' ELSE 'x' || source END AS s, {_field_sql("text")} AS leaf,
  CASE WHEN h % 2 = 0 THEN {_field_sql("replace(text, chr(10), '')")} ELSE {_field_sql("text")} END AS seen FROM summed),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot, count(*) OVER (PARTITION BY s) AS total FROM base),
a0 AS (SELECT s, slot, leaf AS node, total FROM placed),
{_tree_sql("a", _DEEP, "s")},
b0 AS MATERIALIZED (SELECT 0 AS one, s, node, row_number() OVER (ORDER BY s) - 1 AS slot, count(*) OVER () AS total FROM a{_DEEP}),
{_tree_sql("b", _WIDE, "one")},
f0 AS (SELECT doc_id, leaf, s, slot, seen AS now, '' AS proof FROM placed),
{_climb_sql("a", "f", _DEEP, "s").replace("leaf, s, f.s,", "leaf, f.s,")},
g0 AS (SELECT doc_id, leaf, f.s, one, b0.slot, now, proof FROM f{_DEEP} f JOIN b0 ON f.s = b0.s),
{_climb_sql("b", "g", _WIDE, "one")}
SELECT doc_id, leaf, b0.node AS subroot, b{_WIDE}.node AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b{_WIDE}.node AS verified FROM g{_WIDE} g JOIN b0 ON g.s = b0.s, b{_WIDE}"""


@query("op12_merkle_manifest", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(documents(spark, sf_dir))


@query("op13_pair_index_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_decode(bpe.bpe_encode(documents(spark, sf_dir), WORD_TOKENIZER), WORD_TOKENIZER)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
