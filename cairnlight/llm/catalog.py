"""The queries of this subpackage over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, license_scan, line_dedup, mixing, records, scratch, sentencepieces, simhash, topk, toxicity, warc

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, removed_col="removed_lines")


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset index of the record files, which are written on the way."""
    return records.write_records(table(spark, sf_dir, "documents"), scratch.new_path(spark, "records"), RANKS)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier rejects, of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model).where("toxic").select("doc_id", "ll_toxic", "ll_ordinary")


def op2_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    ids = F.array_join(F.col("doc_ids").cast("array<string>"), ",")
    return mixing.mix(docs).withColumns({"lang": F.col("first")["lang"], "doc_ids": ids}).drop("first")


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors by inner product, for every id divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, k=10, queries=vectors.where("vec_id % 50 = 0"))


def op10_telephony_pcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a telephone payload, coded by its language."""
    return audio.to_pcm(audio.media_of(table(spark, sf_dir, "documents")), id_col="doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_nbest": op1_sentencepiece_nbest,
    "op2_warc_derivatives": op2_warc_derivatives,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_source_mixing": op6_source_mixing,
    "op7_token_records": op7_token_records,
    "op8_toxicity": op8_toxicity,
    "op9_exact_topk": op9_exact_topk,
    "op10_telephony_pcm": op10_telephony_pcm,
}

SQL: dict[str, str] = {
    "op2_warc_derivatives": warc.sql(),
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents),
seen AS (
  SELECT *, CASE WHEN regexp_full_match(line, '\s*') THEN 1
            ELSE row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, i) END AS k
  FROM lines)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE k = 1), '') AS text,
       CAST(count(*) FILTER (WHERE k > 1) AS INTEGER) AS removed_lines
FROM seen GROUP BY doc_id""",
    "op6_source_mixing": r"""
WITH d AS (
  SELECT coalesce('=' || source, 'null') AS src, doc_id, lang,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)) AS key,
         string_split(replace(text, chr(10), ' ' || chr(10)), ' ') AS w
  FROM documents WHERE regexp_matches(text, '[^ \t\n\r\f\x0B]')),
e AS (
  SELECT *, len(w) + 1 AS n, CAST(coalesce(sum(len(w) + 1) OVER (
           PARTITION BY src ORDER BY key, len(w) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS o
  FROM d),
p AS (SELECT src, doc_id, lang, w, o, n, unnest(range(o // 512, (o + n - 1) // 512 + 1)) AS block FROM e),
b AS (
  SELECT src, block,
         string_agg(replace(array_to_string(w[greatest(block * 512 - o, 0) + 1 : least((block + 1) * 512 - o, n)], ' '), ' ' || chr(10), chr(10))
                    || CASE WHEN (block + 1) * 512 - o >= n THEN chr(10) || chr(10) ELSE '' END, '' ORDER BY o) AS text,
         CAST(sum(least((block + 1) * 512 - o, n) - greatest(block * 512 - o, 0)) AS BIGINT) AS n_tokens,
         list(doc_id ORDER BY o) AS doc_ids, arg_min(lang, o) AS lang
  FROM p GROUP BY src, block),
s AS (
  SELECT src, CAST(ceil(sum(n) / 512) AS BIGINT) AS size, greatest(1, CAST(floor(sqrt(sum(n))) AS BIGINT)) AS weight FROM e GROUP BY src),
c AS (SELECT *, CAST(sum(weight) OVER (ORDER BY src) AS BIGINT) AS hi FROM s),
u AS (
  SELECT i // 256 AS shard,
         CAST('0x' || substr(md5('17|draw|' || i), 1, 15) AS BIGINT) % (SELECT CAST(sum(weight) AS BIGINT) FROM c) AS u
  FROM range((SELECT CAST(sum(size) AS BIGINT) FROM c)) t(i)),
k AS (SELECT shard, src, size, count(*) AS n FROM u JOIN c ON u.u >= c.hi - c.weight AND u.u < c.hi GROUP BY ALL),
r AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src ORDER BY shard) AS BIGINT) - n AS base FROM k),
j AS (SELECT shard, src, size, base, unnest(range(n)) AS j FROM r),
a AS (
  SELECT src, size, base + j AS g, shard, shard * 256 + row_number() OVER (PARTITION BY shard
           ORDER BY CAST('0x' || substr(md5('17|place|' || shard || '|' || src || '|' || j), 1, 15) AS BIGINT), src, j) - 1 AS slot
  FROM j),
f AS (SELECT *, g // size AS epoch FROM a),
m AS (
  SELECT *, list_reduce(range(1, 25), lambda x, r:
    CASE WHEN CAST('0x' || substr(md5('17|' || src || '|' || epoch || '|' || r || '|' || greatest(x, (CAST('0x' || substr(md5('17|' || src || '|' || epoch || '|' || r), 1, 15) AS BIGINT) % size - x + size) % size)), 1, 15) AS BIGINT) % 2 = 1
    THEN (CAST('0x' || substr(md5('17|' || src || '|' || epoch || '|' || r), 1, 15) AS BIGINT) % size - x + size) % size ELSE x END, g % size) AS block
  FROM f)
SELECT m.shard, m.slot, CASE WHEN m.src <> 'null' THEN substr(m.src, 2) END AS source, m.epoch, m.block,
       b.n_tokens, b.doc_ids[1] AS doc_id, array_to_string(b.doc_ids, ',') AS doc_ids, b.lang, b.text
FROM m JOIN b ON m.src = b.src AND m.block = b.block""",
    "op9_exact_topk": """
WITH s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS neighbor_id,
         round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, neighbor_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, neighbor_id, score FROM r WHERE rank <= 10""",
}
