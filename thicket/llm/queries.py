"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from thicket.llm import conversations, exact_dedup, minhash, mix, ngram_join, quality, secrets, shards, suffix_dedup, toxicity, warc
from thicket.llm.public import aligned_tokens, encoded_digests
from thicket.llm.rows import ROW

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_circulant_minhash": _on_documents(lambda d: minhash.near_duplicates(d, shingle=4).drop(ROW)),
        "op2_mix_sources": _on_documents(lambda d: mix.mix(d).drop(ROW, "copies")),
        "op3_warc_chunks": lambda spark, sf_dir: warc.archive_round_trip(
            spark.read.parquet(f"{sf_dir}/pages.parquet")
        ),
        "op4_exact_dedup": _on_documents(lambda d: exact_dedup.exact_dedup(d).drop(ROW)),
        "op5_line_quality": _on_documents(lambda d: quality.line_quality(d).drop(ROW)),
        "op6_secrets": _on_documents(secrets.scan),
        "op7_feistel_shards": _on_documents(shards.shuffled_shards),
        "op8_toxic_spans": lambda spark, sf_dir: toxicity.score_documents(
            spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
        ),
        "op9_suffix_dedup": _on_documents(suffix_dedup.remove_repeats),
        "op10_byte_bpe": _on_documents(encoded_digests),
        "op11_audited_turns": lambda spark, sf_dir: conversations.damaged_and_repaired(
            spark.read.parquet(f"{sf_dir}/conversations.parquet")
        ),
        "op12_grouped_prefix": _on_documents(
            lambda d: ngram_join.linked_documents(d, shingle=3, percent=90).select("doc_id", "n_shingles", "component_id")
        ),
        "op13_token_spans": _on_documents(lambda d: aligned_tokens(d).drop(ROW)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_circulant_minhash": near_sql(4, 80, ", least(doc_id, coalesce(other, doc_id)) = doc_id AS kept"),
        "op3_warc_chunks": OP3,
        "op4_exact_dedup": OP4,
        "op11_audited_turns": OP11,
        "op12_grouped_prefix": near_sql(3, 90),
    }


def _on_documents(query: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def near_sql(width: int, percent: int, more: str = "") -> str:
    """All pairs that share a shingle, and all rows reachable over links: for small tables."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+') AS words
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
           range(1, greatest(len(words) - {width - 2}, 2)),
           lambda i: array_to_string(words[i:i + {width - 1}], ' '))) END AS shingles
  FROM w
), s AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (shingle) WHERE a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), bonds AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT a, b FROM bonds UNION SELECT r.doc_id, l.b FROM reached r JOIN bonds l ON l.a = r.other
), lowest AS (
  SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT doc_id, len(shingles) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id{more}
FROM sets LEFT JOIN lowest USING (doc_id)
"""


OP3 = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), b AS (SELECT hex, max(page_id) AS best FROM p GROUP BY hex)
SELECT page_id, payload_bytes,
       list_reduce(list_transform(range(0, 8), lambda g: list_reduce(list_transform(range(0, 4), lambda c:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST((('0x' || substr(hex, CAST(5 * g + 1 AS INTEGER), 5))::BIGINT >> (15 - 5 * c)) & 31 AS INTEGER) + 1, 1)),
         lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM p JOIN b USING (hex)
"""

OP4 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm,
         length(coalesce(text, '')) AS points
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM n GROUP BY norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

# Whole audits are carried for the four states: nothing yet, after system, user, assistant. As
# an inserted turn costs more than deleting the row before or after it, none is inserted.
OP11 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(
           list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), checked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(
           list_concat([4294967295::BIGINT], list_transform(
             string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 20 AS fault
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM checked WHERE fault <> 0
), placed AS (
  SELECT conv_id, turn, role, text, row_number() OVER c AS k, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         left(lag(role) OVER c, 1) || left(role, 1) AS two,
         right(regexp_extract(text, '(?s)^(.*[^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1), 1) AS last
  FROM damaged WINDOW c AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), judged AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate'
                 WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), options AS (
  SELECT conv_id, k, b.state AS before, o.after, o.cost, o.letter
  FROM judged j, (VALUES (0), (1), (2), (3)) b(state), LATERAL (
    SELECT b.state AS after, 2 AS cost, 'D' AS letter
    UNION ALL
    SELECT e.after, CASE WHEN e.role = j.initial THEN 0 ELSE 1 END
             + CASE WHEN j.fault = 'truncated' THEN 5 ELSE 0 END,
           CASE WHEN e.role = j.initial THEN 'K' ELSE 'R' END
    FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) e(before, role, after)
    WHERE e.before = b.state AND j.fault NOT IN ('blank', 'duplicate') AND (e.role <> 's' OR j.initial = 's')
  ) o
), steps AS (
  SELECT conv_id, k, list({'before': before, 'after': after, 'cost': cost, 'letter': letter}) AS moves
  FROM options GROUP BY conv_id, k
), walk AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, [{'state': 0, 'cost': 0, 'audit': ''}] AS best FROM judged
  UNION ALL
  SELECT w.conv_id, s.k, list_filter(list_transform([0, 1, 2, 3], lambda y: list_sort(list_filter(flatten(
           list_transform(w.best, lambda p: list_transform(
             list_filter(s.moves, lambda m: m.before = p.state AND m.after = y),
             lambda m: {'state': y, 'cost': p.cost + m.cost, 'audit': p.audit || m.letter}))),
           lambda x: true))[1]), lambda x: x IS NOT NULL)
  FROM walk w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.k = w.k + 1
), ended AS (
  SELECT conv_id, list_sort(list_transform(list_filter(arg_max(best, k), lambda p: p.state IN (0, 3)),
           lambda p: {'cost': p.cost, 'audit': p.audit}))[1] AS e
  FROM walk GROUP BY conv_id
), kept AS (
  SELECT j.conv_id, j.k, j.role, j.text, substr(e.audit, j.k, 1) AS letter,
         row_number() OVER (PARTITION BY j.conv_id ORDER BY j.k) AS n,
         bool_or(j.initial = 's' AND substr(e.audit, j.k, 1) = 'K') OVER (PARTITION BY j.conv_id) AS opened
  FROM judged j JOIN ended ON ended.conv_id IS NOT DISTINCT FROM j.conv_id WHERE substr(e.audit, j.k, 1) <> 'D'
), written AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (n % 2 = 1) = NOT opened THEN 'user'
                                    ELSE 'assistant' END || ':' || text, chr(10) ORDER BY k)) AS sha
  FROM kept GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost,
       coalesce(e.audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
"""
