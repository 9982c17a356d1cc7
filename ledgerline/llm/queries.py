"""The registered queries: each operator over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import hard_negatives, infilling, licenses, logfreq, packing, pii, quality, reply_trees, set_join, simhash, substring_index, suffix_dedup, tiling
from ledgerline.llm.common import prepare


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_index.remove_repeats(_table(spark, sf_dir, "documents"))


def op2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", says), (-1, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").union(extra)
    return reply_trees.digests(reply_trees.format_trees(reply_trees.chains(turns)))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logfreq.score_documents(_table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree source/language/id; short notices (under 400 characters) stand for licence files."""
    docs = _table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(docs.select("doc_id", path.alias("path"), "text"), F.length("text") < 400)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_table(spark, sf_dir, "documents"))


def op9_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.similar_documents(_table(spark, sf_dir, "documents"))


def op12_infilling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infilling.digests(infilling.transform(_table(spark, sf_dir, "documents")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(hard_negatives.integer_vectors(rows), rows.select("vec_id").filter("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_reply_trees": op2_reply_trees,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_pii": op8_pii,
    "op9_tiling": op9_tiling,
    "op10_simhash": op10_simhash,
    "op11_set_join": op11_set_join,
    "op12_infilling": op12_infilling,
    "op13_hard_negatives": op13_hard_negatives,
}

#: DuckDB SQL for the queries that SQL can express; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
WITH texts AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM texts WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS body FROM starts),
first AS (SELECT body, min(doc_id) AS least FROM windows GROUP BY body),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS place FROM windows JOIN first USING (body) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM texts),
kept AS (SELECT w.doc_id, count(g.place) AS n_removed, string_agg(word, ' ' ORDER BY w.place) FILTER (g.place IS NULL) AS body
  FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place GROUP BY w.doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id""",
    "op2_reply_trees": r"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(replace(replace(role, '<\', '<\\'), '<|', '<\|')) + length(replace(replace(text, '<\', '<\\'), '<|', '<\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op3_suffix_dedup": """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
places AS (SELECT doc_id, hx, unnest(range(0, length(hx) // 2 - 99)) AS i FROM texts WHERE length(hx) >= 200),
windows AS (SELECT doc_id, i, substr(hx, 2 * i + 1, 200) AS body FROM places),
first AS (SELECT body, min({'d': doc_id, 'i': i}) AS least FROM windows GROUP BY body HAVING count(*) > 1),
again AS (SELECT doc_id, i FROM windows JOIN first USING (body) WHERE {'d': doc_id, 'i': i} > least),
marked AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS opens FROM again),
runs AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM runs GROUP BY doc_id, k),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT p.doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS body
  FROM pieces p JOIN texts t ON t.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT t.doc_id, CAST(length(hx) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(body, hx))) AS kept_sha256
FROM texts t LEFT JOIN kept k ON k.doc_id = t.doc_id""",
    "op11_set_join": r"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sets AS (SELECT doc_id, list_sort(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END) AS s FROM texts),
classes AS (SELECT s, min(doc_id) AS least, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT least, n, unnest(s) AS token FROM classes),
linked AS (SELECT x.least AS a, y.least AS b FROM tokens x JOIN tokens y ON x.token = y.token AND x.least <> y.least AND 10 * x.n >= 9 * y.n AND 10 * y.n >= 9 * x.n
  GROUP BY x.least, y.least, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reached AS (SELECT least AS a, least AS b FROM classes UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a),
roots AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, coalesce(component_id, t.doc_id) AS component_id
FROM sets t LEFT JOIN classes c ON c.s = t.s LEFT JOIN roots r ON r.a = c.least""",
    "op12_infilling": r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS us, sha256('1:' || doc_id) AS hx FROM documents),
hashes AS (SELECT *, len(us) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(hx, 8 * i + 1, 8) AS BIGINT)) AS h FROM texts),
cuts AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM hashes),
parts AS (SELECT *, array_to_string(us[1:a], '') AS p, array_to_string(us[a + 1:b], '') AS m, array_to_string(us[b + 1:], '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(p || m || s) AS restored_sha256
FROM parts""",
    "op13_hard_negatives": """
WITH known AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
scored AS (SELECT a.vec_id AS anchor_id, k.vec_id, a.label = k.label AS same, CAST(list_dot_product(a.v, k.v) AS BIGINT) AS score FROM known a JOIN known k ON a.vec_id <> k.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3""",
}
