"""A corpus pipeline: quality, near duplicates, repeated passages, source mix, tokens.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from emberkey.llm.common import materialize
from emberkey.llm.stages import deduplicate_passages, encode_tokens, keep_quality, keep_unlike, mix_sources

STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_unlike),
    ("passages", deduplicate_passages),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: A trained classifier, signatures and a tokenizer can't be put into SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
