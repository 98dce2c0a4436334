"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewake.llm import bpe, clustering, debruijn, decontamination, langid, media, neighbours, packing, pii, quality, repair, simhash, suffixes
from tidewake.llm.shared import table


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a stored picture, read back by byte ranges."""
    return media.stored_documents(table(spark, sf_dir, "documents"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of every hundredth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and their bytes again, as digests."""
    return bpe.encode_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences as possible."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 400-byte strings that stand anywhere else."""
    return suffixes.removal_digest(table(spark, sf_dir, "documents"))


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 50-word windows that an earlier one has."""
    return debruijn.removal_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.find(table(spark, sf_dir, "documents"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    rows = table(spark, sf_dir, "conversations")
    return repair.digest(rows, repair.repair(repair.damage(rows)))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages in all documents."""
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in sixteen clusters after three rounds."""
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


#: The same windows, written out: each joined to the smallest document that has it.
DEBRUIJN_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
 wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
 firsts AS (SELECT g, min(doc_id) AS lo FROM wins GROUP BY g HAVING count(*) > 1),
 hit AS (SELECT doc_id, i FROM wins JOIN firsts USING (g) WHERE doc_id > lo),
 covered AS (SELECT DISTINCT doc_id, i + o AS p FROM hit, range(50) AS r(o)),
 words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
 kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS line FROM words ANTI JOIN covered ON covered.doc_id = words.doc_id AND covered.p = words.p GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

#: Every window's hash, counted; hits that lie no more than a window apart make one span.
SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
 wins AS (SELECT doc_id, i, md5(b[i:i + 399]) AS g FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 398)) AS i FROM d)),
 again AS (SELECT g FROM wins GROUP BY g HAVING count(*) > 1),
 hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 400 THEN 0 ELSE 1 END AS begins FROM wins SEMI JOIN again USING (g) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
 spans AS (SELECT doc_id, min(i) AS lo, max(i) + 399 AS hi FROM (SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hit) GROUP BY doc_id, span),
 gaps AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) + 1 AS a, lo - 1 AS z, 0 AS removed, 0 AS n FROM spans
  UNION ALL SELECT doc_id, coalesce(max(hi), 0) + 1, max(octet_length(b)), coalesce(sum(hi - lo + 1), 0), count(hi) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(max(octet_length(b)) AS BIGINT) AS n_bytes, CAST(sum(removed) AS BIGINT) AS n_removed, CAST(sum(n) AS BIGINT) AS n_spans, sha256(unhex(coalesce(string_agg(CASE WHEN a <= z THEN hex(b[a:z]) ELSE '' END, '' ORDER BY a), ''))) AS kept_sha256
FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
"""


#: The checksum bit by bit, then the best edits of each beginning of a conversation for each state of the grammar, row by row.
REPAIR_SQL = r"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS said FROM conversations),
 sums AS (SELECT *, xor(list_reduce(list_transform(string_split(said, ''), lambda ch: ascii(ch)::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295) % 20 AS kind FROM named),
 hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM sums),
 ends AS (SELECT *, right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS z, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM hurt),
 seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, left(role, 1) AS c FROM ends),
 told AS (SELECT *, z = '' AS blank, z <> '' AND again AS duplicate, z <> '' AND NOT again AND z NOT IN ('.', '!', '?') AS truncated, coalesce(lag(c) OVER (PARTITION BY conv_id ORDER BY p) || c NOT IN ('su', 'ua', 'au'), false) AS illegal FROM seen),
 counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated, sum(illegal::INT) AS illegal FROM told GROUP BY 1),
 inserted(a, b, edits, paid, lines) AS (VALUES (0, 0, '', 0, []::VARCHAR[]), (1, 1, '', 0, []), (2, 2, '', 0, []), (3, 3, '', 0, []), (0, 2, 'I', 2, ['user:']), (1, 2, 'I', 2, ['user:']), (2, 3, 'I', 2, ['assistant:']), (3, 2, 'I', 2, ['user:']), (0, 3, 'II', 4, ['user:', 'assistant:']), (1, 3, 'II', 4, ['user:', 'assistant:'])),
 moved(a, b, edit, paid, wants, puts) AS (VALUES (0, 1, 'K', 0, 's', NULL), (0, 2, 'K', 0, 'u', NULL), (1, 2, 'K', 0, 'u', NULL), (2, 3, 'K', 0, 'a', NULL), (3, 2, 'K', 0, 'u', NULL), (0, 2, 'R', 2, NULL, 'user'), (1, 2, 'R', 2, NULL, 'user'), (2, 3, 'R', 2, NULL, 'assistant'), (3, 2, 'R', 2, NULL, 'user'), (0, 0, 'D', 3, NULL, NULL), (1, 1, 'D', 3, NULL, NULL), (2, 2, 'D', 3, NULL, NULL), (3, 3, 'D', 3, NULL, NULL)),
 dp AS (
  SELECT conv_id, 0 AS p, 0 AS state, {'cost': 0, 'audit': '', 'lines': []::VARCHAR[]} AS best FROM counts
  UNION ALL
  SELECT conv_id, p, state, min(way) FROM (
   SELECT dp.conv_id, dp.p + 1 AS p, m.b AS state, {'cost': best.cost + i.paid + m.paid + CASE WHEN truncated AND edit <> 'D' THEN 1 ELSE 0 END, 'audit': best.audit || i.edits || edit, 'lines': best.lines || i.lines || CASE WHEN edit = 'D' THEN [] ELSE [coalesce(puts, role) || ':' || text] END} AS way
   FROM dp JOIN told ON told.conv_id = dp.conv_id AND told.p = dp.p + 1 JOIN inserted i ON i.a = state JOIN moved m ON m.a = i.b AND (edit = 'D' OR NOT (blank OR duplicate)) AND (wants IS NULL OR wants = c)) GROUP BY conv_id, p, state),
 done(state, edits, paid, lines) AS (VALUES (0, '', 0, []::VARCHAR[]), (1, 'II', 4, ['user:', 'assistant:']), (2, 'I', 2, ['assistant:']), (3, '', 0, [])),
 final AS (SELECT conv_id, min({'cost': best.cost + paid, 'audit': best.audit || edits, 'lines': best.lines || lines}) AS best FROM dp JOIN (SELECT conv_id, max(p) AS p FROM told GROUP BY 1) USING (conv_id, p) JOIN done USING (state) GROUP BY 1)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
 coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN counts USING (conv_id) LEFT JOIN final USING (conv_id)
"""

#: All windows of both sides, joined.
DECONTAMINATION_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
 bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + 9], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, CASE WHEN len(ws) = 0 THEN 1 ELSE greatest(len(ws) - 8, 2) END)) AS i FROM b)),
 dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
 met AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, g)),
 covered AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM met, range(10) AS r(o) WHERE o < n GROUP BY 1),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: One round: every component joined to every centroid's, then sums of what is nearest.
_ROUND = """
 d{n} AS (SELECT vec_id, min(({{'d': d, 'j': j}})) AS best FROM (SELECT vec_id, j, sum((x - c) * (x - c)) AS d FROM comp JOIN c{n} USING (i) GROUP BY vec_id, j) GROUP BY vec_id),
 m{n} AS (SELECT best.j AS j, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n FROM comp JOIN d{n} USING (vec_id) GROUP BY 1, 2),
 c{next} AS (SELECT c{n}.j AS j, c{n}.i AS i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{n} LEFT JOIN m{n} ON m{n}.j = c{n}.j AND m{n}.i = c{n}.i)"""

CLUSTERING_SQL = (
    """
WITH kept AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
 comp AS (SELECT vec_id, unnest(range(64)) AS i, unnest(v) AS x FROM kept),
 seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS j FROM kept ORDER BY j LIMIT 16),
 c0 AS (SELECT j, i, x AS c FROM seeds JOIN comp USING (vec_id)),"""
    + ",".join(_ROUND.format(n=n, next=n + 1) for n in range(4))
    + """,
 own AS (SELECT best.j AS j, sum(best.d) AS d FROM d3 GROUP BY 1),
 signs AS (SELECT j, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS sign FROM c3 GROUP BY j)
SELECT vec_id, CAST(best.j AS INTEGER) AS cluster, CAST(best.d AS BIGINT) AS distance, CAST(own.d AS BIGINT) AS cluster_inertia, CAST((SELECT sum(d) FROM own) AS BIGINT) AS inertia, sign AS centroid_sha256
FROM d3 JOIN own ON own.j = best.j JOIN signs ON signs.j = best.j
"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_media": op1_media,
        "op2_neighbours": op2_neighbours,
        "op3_simhash": op3_simhash,
        "op4_bpe": op4_bpe,
        "op5_packing": op5_packing,
        "op6_quality": op6_quality,
        "op7_language": op7_language,
        "op8_suffix_array": op8_suffix_array,
        "op9_debruijn": op9_debruijn,
        "op10_pii": op10_pii,
        "op11_conversations": op11_conversations,
        "op12_decontamination": op12_decontamination,
        "op13_clustering": op13_clustering,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {"op8_suffix_array": SUFFIX_SQL, "op9_debruijn": DEBRUIJN_SQL, "op11_conversations": REPAIR_SQL, "op12_decontamination": DECONTAMINATION_SQL, "op13_clustering": CLUSTERING_SQL}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
