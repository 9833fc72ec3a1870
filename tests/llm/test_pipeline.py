"""The pipeline's stages on a small table, each on what the one before kept."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import public_tokenizers
import tiktoken
from test_operators import brute_classes, brute_removed

from emberkey.llm import bpe, mixing, quality
from emberkey.session import materialize

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialize(stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        if name != "tokens":
            assert docs.columns == before.columns
    assert 0 < counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] == counts[3]


def test_odd_and_empty_tables(spark, odd, none):
    for table in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, table, SMALL).count()


def rows_of(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"], r["text"]))


def test_every_stage_by_brute_force(spark):
    """Each stage's rows, rebuilt in plain Python from what the one before kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    before = rows_of(docs)

    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, labels).collect()}  # itself rebuilt in test_operators
    docs = materialize(stages["quality"](spark, docs, SMALL), "quality")
    after = rows_of(docs)
    assert after == [r for r in before if scores[r["doc_id"]] >= 0.5] and 0 < len(after) < len(before)

    classes = brute_classes([(r["doc_id"], r["text"]) for r in after])
    docs = materialize(stages["near_duplicates"](spark, docs, SMALL), "near")
    kept = rows_of(docs)
    assert kept == [r for r in after if classes[r["doc_id"]] == r["doc_id"]] and 0 < len(kept) < len(after)

    left = brute_removed([(r["doc_id"], r["text"]) for r in kept])
    docs = materialize(stages["passages"](spark, docs, SMALL), "passages")
    cut = rows_of(docs)
    want = [{**r, "text": left[r["doc_id"]].decode("utf-8", "ignore")} for r in kept]
    assert cut == [{**r, "n_chars": len(r["text"])} for r in want]

    taken = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mix_documents(docs).collect()}
    docs = materialize(stages["mix"](spark, docs, SMALL), "mix")
    mixed = rows_of(docs)
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in cut}
    assert all(taken[i] == (n, n * times) and times <= 3 for i, n in size.items() if n for times in [sum(r["doc_id"] == i for r in mixed)])
    originals = {r["doc_id"]: r for r in cut}
    assert all(r == originals[r["doc_id"]] for r in mixed) and mixed

    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    tokens = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in stages["tokens"](spark, docs, SMALL).collect())
    digest = lambda raw: hashlib.sha256(raw).hexdigest()
    encoded = [(r["doc_id"], plain.encode_ordinary(r["text"]), r["text"].encode()) for r in mixed]
    assert tokens == Counter((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest(raw)) for i, ids, raw in encoded)
