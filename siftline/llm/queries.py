"""The registered queries of this subpackage, one opN_ query for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_topk, nearest, packing, pieces, pii, secrets, sharding, simhash, substrings, toxicity
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (unsigned, little-endian unsigned 32-bit ids), and what decoding them gives: its SHA-256, and whether it is the text."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, back="decoded")
    return coded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's siftline.pii.key; the synthetic tables need no secret one."""
    return pii.replace_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get("siftline.pii.key", "synthetic"))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_sentencepiece, op3_sharding, op4_packing, op5_secrets, op6_pii, op7_substrings, op8_toxicity, op9_nearest, op10_exact_topk)}


def search_sql(every: int, k: int, component: str, kind: str, more: str) -> str:
    return f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: {component}) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 {more}
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS {kind}) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % {every} = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {k}"""


ORACLE_SQL: dict[str, str] = {
    "op9_nearest": search_sql(20, 20, "CAST(x AS DOUBLE)", "DOUBLE", "AND len(list_filter(embedding, lambda x: x <> 0)) > 0"),
    "op10_exact_topk": search_sql(100, 10, "floor(1024 * CAST(x AS DOUBLE))", "BIGINT", ""),
    "op7_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce("text", ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13),
s AS (SELECT doc_id, i, list_aggregate(w[i:i+12], 'string_agg', ' ') AS k FROM p),
f AS (SELECT k, min(doc_id) AS first FROM s GROUP BY k),
x AS (SELECT DISTINCT s.doc_id, unnest(range(s.i, s.i + 13)) AS i FROM s JOIN f ON s.k = f.k AND f.first < s.doc_id),
t AS (SELECT doc_id, w[i] AS word, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
r AS (SELECT t.doc_id, count(*) AS kept, string_agg(t.word, ' ' ORDER BY t.i) AS body FROM t ANTI JOIN x ON t.doc_id = x.doc_id AND t.i = x.i GROUP BY t.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(r.kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(r.body, '')) AS kept_sha256
FROM w LEFT JOIN r ON w.doc_id = r.doc_id""",
}
