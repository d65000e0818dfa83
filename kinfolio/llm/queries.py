"""Registered queries of the text operators, with their SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.llm import bpe, decontaminate, html_text, language, near_dups, packed_ids, phrases, quality_qda, quality_rules, sharding, substring_dedup, token_alignment, url_filter
from kinfolio.llm.common import crc_mod, table
from kinfolio.session import shared_dir


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_path() -> str:
    """The public sentencepiece model that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = language.fit(docs.where(~held_out))
    return language.predict(docs, model, F.col("doc_id"), held_out.alias("held_out"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = quality_qda.fit(docs, labels.where(~held_out))
    return quality_qda.predict(docs, model, F.col("doc_id"), held_out.alias("held_out"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    packed_ids.write(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return packed_ids.read_digests(spark, path)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), F.col("page_id"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), F.col("page_id"), F.col("url"))


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), piece_path())


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), leaves=16)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_substring": op3_substring,
    "op4_quality": op4_quality,
    "op6_url_filter": op6_url_filter,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontaminate": op8_decontaminate,
    "op9_html": op9_html,
    "op10_near_dups": op10_near_dups,
    "op5_packed_ids": op5_packed_ids,
    "op11_phrases": op11_phrases,
    "op12_token_alignment": op12_token_alignment,
    "op13_sharding": op13_sharding,
}

#: Lower-cased ASCII words of whole texts, and windows of 13 (or all of a shorter item's) words.
OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), bw AS (
  SELECT item_id, least(len(w), 13) AS n, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM d, (SELECT DISTINCT n FROM bw), unnest(range(1, len(w) - n + 2)) AS t(p)
), m AS (SELECT DISTINCT doc_id, n, p, item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM m, unnest(range(p, p + n)) AS t(q) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

#: Every window of 50 words of whole texts, and the smallest document that it starts in.
OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, p, array_to_string(w[p : p + 49], ' ') AS t FROM d, unnest(range(1, len(w) - 48)) AS u(p)
), least_doc AS (SELECT t, min(doc_id) AS first_doc FROM win GROUP BY t),
gone AS (
  SELECT DISTINCT doc_id, q FROM win JOIN least_doc USING (t), unnest(range(p, p + 50)) AS u(q) WHERE first_doc < doc_id
), removed AS (SELECT doc_id, list(q) AS qs, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN removed USING (doc_id)
"""

#: Sets of lower-cased three-word shingles, links of 85 percent, smallest reachable document.
OP10_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS t
  FROM d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS u(p)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM inter JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * common >= 85 * (a.n + b.n - common)
), reach AS (
  SELECT x, y FROM e UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x
), c AS (SELECT x AS doc_id, min(y) AS least_y FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least_y, doc_id)) AS component_id,
  doc_id = least(doc_id, coalesce(least_y, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

#: All phrases of one to five words of a piece, the lowest-scoring cut of each, and what a longer phrase covers.
OP11_SQL = r"""
WITH w AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
ph AS (
  SELECT lang, w[p : p + k - 1] AS g, k, count(*) AS cnt FROM w, unnest(range(1, 6)) AS a(k), unnest(range(1, len(w) - k + 2)) AS b(p) GROUP BY ALL HAVING count(*) >= 100
), covered AS (
  SELECT DISTINCT ph.lang, x.part AS g FROM ph, unnest([ph.g[1 : ph.k - 1], ph.g[2 : ph.k]]) AS x(part) JOIN ph s ON s.lang = ph.lang AND s.g = x.part WHERE ph.k > 2 AND ph.cnt >= s.cnt
), cuts AS (
  SELECT ph.lang, ph.g, ph.cnt AS a, x.cnt AS l, y.cnt AS r, n, c, CAST(1000 * CAST(ph.cnt AS HUGEINT) * n // (CAST(x.cnt AS HUGEINT) * y.cnt) AS BIGINT) AS score
  FROM ph JOIN total ON total.lang = ph.lang, unnest(range(1, ph.k)) AS u(c) JOIN ph x ON x.lang = ph.lang AND x.g = ph.g[1 : c] JOIN ph y ON y.lang = ph.lang AND y.g = ph.g[c + 1 : ph.k]
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM best WHERE NOT EXISTS (SELECT 1 FROM covered WHERE covered.lang = best.lang AND covered.g = best.g) QUALIFY rank <= 2000
"""

ORACLE_SQL: dict[str, str] = {"op11_phrases": OP11_SQL, "op3_substring": OP3_SQL, "op8_decontaminate": OP8_SQL, "op10_near_dups": OP10_SQL}
