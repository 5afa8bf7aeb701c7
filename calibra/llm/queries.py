"""The queries of this subpackage, each over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calibra.llm import chat, decontam, langid, licenses, passages, pieces, quality, simhash, tokenfiles, urls
from calibra.llm.common import scratch, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s.base)
    names = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    starts = F.transform(base, lambda s: s.start)
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.score)), F.lit(0.0)).alias("score"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return pieces.encode(table(spark, sf_dir, "documents"), model or public_tokenizers.path("piece_bpe_32k.model"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.digest(tokenfiles.read(spark, path))


def op6_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_simhash, op3_sentencepiece, op4_decontaminate, op5_token_files, op6_weak_quality, op7_language_id, op8_chat_perspectives, op9_passages, op10_url_cascade)}


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(CAST(floor(turn / 256) AS BIGINT), -1) AS part, coalesce(CAST(turn AS BIGINT), 0) AS turn,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
), p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, role, text) - 1) // 256 AS piece FROM t
), c AS (
  SELECT conv_id, min(part) AS first_part, first(text ORDER BY turn, role, text) FILTER (role = 'system') AS opening FROM t GROUP BY conv_id
), s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'
), r AS (
  SELECT p.conv_id, part, piece, turn, role, text, false AS added FROM p
  UNION ALL SELECT q.conv_id, part, piece, -1, 'system', opening, true
  FROM (SELECT DISTINCT conv_id, part, piece FROM p) q JOIN c ON c.conv_id IS NOT DISTINCT FROM q.conv_id WHERE opening IS NOT NULL AND (part <> first_part OR piece > 0)
), l AS (
  SELECT r.conv_id, s.speaker, r.part, r.piece, r.turn, r.role, r.text, r.added, r.role = s.speaker AS own,
         '<|im_start|>' || CASE WHEN r.role = s.speaker THEN 'assistant' WHEN r.role = 'system' THEN 'system'
           ELSE 'user name=' || replace(replace(translate(r.role, chr(10) || chr(13), '  '), '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') END || chr(10) AS head,
         replace(replace(r.text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' AS body
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id
), n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY added DESC, turn, role, text) AS k FROM l
), o AS (
  SELECT *, CAST(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY k) AS BIGINT) - 1 AS stop FROM n
)
SELECT conv_id, speaker, part, piece, count(*) FILTER (NOT added) AS n_turns, count(*) FILTER (own) AS n_own,
       string_agg(head || body, chr(10) ORDER BY k) || chr(10) AS rendered,
       coalesce(list(stop - length(body) ORDER BY k) FILTER (own), CAST([] AS BIGINT[])) AS mask_starts,
       coalesce(list(stop ORDER BY k) FILTER (own), CAST([] AS BIGINT[])) AS mask_ends
FROM o GROUP BY conv_id, speaker, part, piece
"""

OP4_SQL = r"""
WITH i AS (
  SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), s AS (
  SELECT DISTINCT k, item_id, width, array_to_string(list_slice(w, n, n + width - 1), ' ') AS shingle
  FROM (SELECT k, item_id, w, least(5, len(w)) AS width, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS n FROM i WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT DISTINCT r, doc_id, width, array_to_string(list_slice(w, n, n + width - 1), ' ') AS shingle
  FROM (SELECT r, doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS n FROM d, (SELECT DISTINCT width FROM s) WHERE len(w) >= width)
), c AS (SELECT t.r, t.doc_id, s.k, s.item_id, count(*) AS found FROM s JOIN t ON t.width = s.width AND t.shingle = s.shingle GROUP BY ALL
), n AS (SELECT k, count(*) AS shingles FROM s GROUP BY k)
SELECT doc_id, item_id, found, shingles, found / shingles AS containment FROM c JOIN n ON n.k = c.k WHERE found >= ceil(0.8 * shingles - 1e-9)
"""

OP10_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN host = 'spam-farm.example.org' OR ends_with(host, '.spam-farm.example.org') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op8_chat_perspectives": OP8_SQL, "op10_url_cascade": OP10_SQL}
