"""Queries of the training-data operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from streamcheck.llm.bpe import encode_decode
from streamcheck.llm.exact import exact_dedup
from streamcheck.llm.hnsw import embedding_dedup
from streamcheck.llm.importance import resample
from streamcheck.llm.lines import remove_lines
from streamcheck.llm.lm import score_documents
from streamcheck.llm.minhash import near_dedup
from streamcheck.llm.pack import pack
from streamcheck.llm.prefix import count_tokens
from streamcheck.llm.quality import classify
from streamcheck.llm.shared import Scratch, table
from streamcheck.llm.substring import remove_repeats
from streamcheck.llm.trie import prefix_trie
from streamcheck.llm.warc import page_records, read_warc, write_warc

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP5_SQL = """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
FROM (
  SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256,
         max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
         count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size
  FROM documents)
"""


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = Scratch(spark, "warc").path("archives")
    write_warc(table(spark, sf_dir, "pages"), archives)
    return page_records(read_warc(spark, archives))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_lines(table(spark, sf_dir, "documents"))


# Maximal runs by pairs: equal lines at two places, joined along diagonals of (place, earlier place).
OP8_SQL = """
WITH lines AS (
  SELECT doc_id, p - 1 AS pos, l[p] AS line, strlen(l[p]) AS bytes
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), pairs AS (
  SELECT a.doc_id, a.pos, a.bytes, b.doc_id AS other, a.pos - b.pos AS diagonal
  FROM lines a JOIN lines b ON a.line = b.line AND (b.doc_id, b.pos) < (a.doc_id, a.pos)
), runs AS (
  SELECT doc_id, min(pos) AS lo, max(pos) AS hi
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY pos) AS run FROM pairs)
  GROUP BY doc_id, other, diagonal, run HAVING sum(bytes) >= 32
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM (SELECT DISTINCT * FROM runs)
)
SELECT d.doc_id, count(l.pos) AS n_lines, count(g.pos) AS n_removed,
       sha256(coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '')) AS kept_sha256
FROM documents d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos
GROUP BY d.doc_id
"""


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), words=4)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum of a word runs over its bytes by the table of eight shifts each.
OP12_SQL = """
WITH shifts AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)
), words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w, hex(w) AS h FROM words), shifts
), counted AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM words JOIN hashed USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS g
  FROM counted, (SELECT count(*) FILTER (WHERE side = 'd') AS s_all, count(*) FILTER (WHERE side = 'b') AS t_all FROM words)
), weighed AS (
  SELECT doc_id, count(*) AS n, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT count(place) * 10 // 100 FROM placed) THEN place END AS rank FROM placed
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


QUERIES = (op1_hmm, op2_bpe, op3_embeddings, op4_substring, op5_exact_dedup, op6_quality, op7_warc, op8_lines, op9_packing, op10_minhash, op11_trie, op12_importance, op13_token_counts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": OP5_SQL, "op8_lines": OP8_SQL, "op12_importance": OP12_SQL}
