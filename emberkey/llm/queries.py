"""The queries of this package over the given tables, and SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkey.llm import ann, audit, bpe, centroids, merkle, minhash, mixing, packing, quality, suffix, toxicity, urlfilter, warc
from emberkey.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprint_documents(read(spark, sf_dir, "documents"))


@query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read(spark, sf_dir, "embeddings"))


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_pages(read(spark, sf_dir, "pages"))


SQL["op3_url_filter"] = urlfilter.sql()


@query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_and_read(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op4_warc"] = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_PAYLOAD} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept IS NULL OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM k
"""


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


@query
def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@query
def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain: junk (the quality label turned round), then toxic."""
    labels = read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("junk"), "toxic")
    return toxicity.score_documents(read(spark, sf_dir, "documents"), labels, ("junk", "toxic"))


@query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, capacity = read(spark, sf_dir, "documents"), 2048
    pieces = packing.encode_pieces(docs, public_tokenizers.path(TOKENIZER), capacity)
    return packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity)


@query
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(read(spark, sf_dir, "embeddings"))


SQL["op12_centroids"] = centroids.sql()


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


SQL["op13_filter_audit"] = audit.sql()
