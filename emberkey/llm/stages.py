"""The stages of `corpus_pipeline.py`: each takes (spark, docs, sf_dir), and all but the last return columns of documents.

Nulls: a null text is an empty one, which has a quality score like others, is like no other document,
keeps its no bytes, has size 0 and so goes in the mix, where nothing is taken of it. Rows without an id can't be looked up
again; they are scored by their text, and of classes of such rows all stay. Columns beyond the five of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkey.llm import bpe, minhash, mixing, quality, suffix
from emberkey.llm.common import arrow_rows, blocks, materialize, read, utf8

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = "byte_bpe_50k.tiktoken"


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.col(c).cast(k.split()[1]).alias(c) for c, k in zip(COLUMNS, KINDS.split(", "), strict=True)])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least one half. The model scores rows where they are; no join, no shuffle."""
    return quality.keep_good(_documents(docs), read(spark, sf_dir, "labels"))


def keep_unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; of rows that repeat this id, one."""
    docs = _documents(docs)
    classes = minhash.near_duplicates(docs).where("class_id = doc_id").select("doc_id").distinct()
    kept = docs.join(materialize(classes, "kept"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null")).select(COLUMNS)


def deduplicate_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of 100-byte strings that also start earlier; of a character cut in two, nothing stays.

    n_chars is that of the new text. A document of which nothing is left stays as an empty one.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(((i, utf8(t), r, lang, source) for i, t, lang, source, _, r in arrow_rows(batches)), 1):
            texts = [suffix.without(r[1], suffix.spans(r[2])).decode("utf-8", "ignore") for r in rows]
            columns = [[r[0] for r in rows], texts, [r[3] for r in rows], [r[4] for r in rows], [len(t) for t in texts]]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=COLUMNS)

    return suffix.with_ranges(_documents(docs)).mapInArrow(cut, KINDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it; ids repeat with it."""
    docs = _documents(docs)
    mixed = mixing.mix_documents(docs).where("copies > 0").select("doc_id", "size", "copies")
    # Rows that repeat an id are taken together, each as often as the most taken of them.
    counts = materialize(mixed.groupBy("doc_id").agg(F.max("copies").alias("copies")), "copies")
    counts = counts.withColumnRenamed("doc_id", "taken_id")
    out = docs.join(counts, F.col("doc_id").eqNullSafe(F.col("taken_id")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row."""
    return bpe.encode_documents(_documents(docs), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
