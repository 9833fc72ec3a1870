"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each category has a logistic model over the words and
word beginnings that tell it best, and over the probabilities of the categories before it. While
learning, these probabilities are out-of-fold predictions, so a later model sees them as
uncertain as they will be for new texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import PUNCTUATION, TextBlock, arrow_rows, blocks, held_out, labelled_sample, materialize, mix64, prefix_hash, span_hash, utf8

SAMPLE_DOCUMENTS = 12_000  # most labelled documents to learn from
FEATURES = 512  # of each category
LEAST_DOCUMENTS = 5  # that a feature must occur in
BEGINNINGS = (4, 5)  # bytes of a word's beginning
FOLDS = 4


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) for every word and word beginning, as two arrays with repetitions; case doesn't count."""
    block = TextBlock([utf8(t.lower()) for t in texts])
    starts, ends = block.words(PUNCTUATION)
    prefix, doc = prefix_hash(block.data), block.owner(starts)
    keys = [span_hash(prefix, starts, ends)]
    docs = [doc]
    for k in BEGINNINGS:
        long = ends - starts > k
        keys.append(mix64(span_hash(prefix, starts[long], starts[long] + k) + np.uint64(k)))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(keys)


class FeatureSet:
    """Finds a fixed set of features in texts: 0 or 1 for each."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.maybe = np.zeros(1 << 16, dtype=bool)
        self.maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def find(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.keys)), dtype=np.float32)
        doc, key = features(texts)
        some = self.maybe[(key & np.uint64(0xFFFF)).astype(np.int64)]
        doc, key = doc[some], key[some]
        at = np.searchsorted(self.keys, key)
        hit = at < len(self.keys)
        hit[hit] = self.keys[at[hit]] == key[hit]
        out[doc[hit], at[hit]] = 1
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 300) -> np.ndarray:
    """Weights and a last constant, by accelerated gradient steps on the penalised log loss."""
    x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32)))
    probe = np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x.T @ (x @ probe)
        largest = float(np.linalg.norm(probe))
        probe /= max(largest, 1e-12)
    rate = 1 / (0.25 * largest / len(x) + penalty)
    w = np.zeros(x.shape[1], dtype=np.float32)
    ahead, t = w, 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead, -30, 30)))
        grad = x.T @ (p - y) / len(x) + penalty * np.append(ahead[:-1], 0)
        new = (ahead - rate * grad).astype(np.float32)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + np.float32((before - 1) / t) * (new - w), new
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


class Chain:
    """One linear model for each category; `cols` are the features that it looks at."""

    def __init__(self, categories: list[str], cols: list[np.ndarray], weights: list[np.ndarray], found: FeatureSet):
        self.categories, self.cols, self.weights, self.found = categories, cols, weights, found

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.found.find(texts)
        out = np.zeros((len(texts), 0), dtype=np.float32)
        for cols, w in zip(self.cols, self.weights, strict=True):
            p = predict(w, np.hstack((x[:, cols], out)))
            out = np.hstack((out, p[:, None].astype(np.float32)))
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, categories: list[str], cols: list[np.ndarray], found: FeatureSet, seed: int = 3) -> Chain:
        fold = np.random.default_rng(seed).permutation(len(x)) % FOLDS
        earlier = np.zeros((len(x), 0), dtype=np.float32)
        weights = []
        for k in range(len(categories)):
            inputs = np.hstack((x[:, cols[k]], earlier))
            weights.append(fit_logistic(inputs, y[:, k]))
            if k + 1 < len(categories):
                out = np.zeros(len(x), dtype=np.float32)
                for f in range(FOLDS):
                    out[fold == f] = predict(fit_logistic(inputs[fold != f], y[fold != f, k]), inputs[fold == f])
                earlier = np.hstack((earlier, out[:, None]))
        return cls(categories, cols, weights, found)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE_DOCUMENTS) -> Chain | None:
    """A chain from at most `sample` labelled documents that aren't held out; None if the last category has one kind of label only."""
    rows = materialize(labelled_sample(docs, labels, categories, sample), "toxic")
    sums = rows.agg(F.count("*"), *[F.sum((F.col(c) > 0).cast("int")) for c in categories]).first()
    total, positive = sums[0], [s or 0 for s in sums[1:]]
    if not 0 < positive[-1] < total:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks(((r[0], np.array(r[1:]) > 0) for r in arrow_rows(batches)), 0, 8 << 20):
            doc, key = features([t for t, _ in held])
            pair = _unique_pairs(key, doc)
            keys, at = np.unique(pair[0], return_inverse=True)
            y = np.array([p for _, p in held])[pair[1]]
            columns = [np.bincount(at, minlength=len(keys))] + [np.bincount(at, weights=y[:, k], minlength=len(keys)).astype(np.int64) for k in range(len(categories))]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, columns)], names=["f", "n", *[f"p{k}" for k in range(len(categories))]])

    schema = "f long, n long, " + ", ".join(f"p{k} long" for k in range(len(categories)))
    seen = rows.mapInArrow(count, schema).groupBy("f").agg(F.sum("n").alias("n"), *[F.sum(f"p{k}").alias(f"p{k}") for k in range(len(categories))])
    seen = materialize(seen.where(F.col("n") >= LEAST_DOCUMENTS), "features")
    best = []
    for k, pos in enumerate(positive):
        share = F.col("n") / total
        apart = F.col(f"p{k}") / max(pos, 1) - (F.col("n") - F.col(f"p{k}")) / max(total - pos, 1)
        z = F.abs(apart) / F.sqrt(share * (1 - share) + F.lit(1.0 / total))
        best.append(np.array([r[0] for r in seen.orderBy(z.desc(), "f").limit(FEATURES).select("f").collect()], dtype=np.int64).view(np.uint64))
    found = FeatureSet(np.concatenate(best))
    cols = [np.searchsorted(found.keys, np.unique(b)) for b in best]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in blocks(arrow_rows(batches), 0):
            x = np.packbits(found.find([r[0] for r in held]).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x]), pa.array([list(r[1:]) for r in held], pa.list_(pa.int32()))], names=["x", "y"])

    # At most `sample` rows of 1 bit a feature reach the driver.
    got = rows.mapInArrow(bits, "x binary, y array<int>").toPandas()
    order = sorted(range(len(got)), key=lambda i: (bytes(got["x"][i]), list(got["y"][i])))
    x = np.unpackbits(np.frombuffer(b"".join(bytes(got["x"][i]) for i in order), dtype=np.uint8).reshape(len(got), -1), axis=1)[:, : len(found.keys)].astype(np.float32)
    y = (np.array([list(got["y"][i]) for i in order]) > 0).astype(np.float32)
    return Chain.fit(x, y, categories, cols, found)


def _unique_pairs(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))[: len(key)]
    return key[new], doc[new]


def score_documents(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("toxic",), sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, a probability p_<category> for each category, score (the last one's), predicted.

    `labels` has doc_id and a 0/1 column for each category, in the order of the chain. Null and empty
    texts have no features and get the models' constants. Without labels of both kinds every score is 0 and nothing
    is predicted toxic. Repeated rows each give a row, an empty table none; other columns are never
    looked at. Scoring needs no shuffle; a task holds about a megabyte of text, or one longer text.
    """
    names = list(categories)
    chain = train(docs, labels, names, sample)
    shipped = docs.sparkSession.sparkContext.broadcast(chain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shipped.value
        for rows in blocks(((i, t or "", h) for i, t, h in arrow_rows(batches)), 1):
            p = chain.scores([r[1] for r in rows]).astype(np.float64) if chain else np.zeros((len(rows), len(names)))
            last = p[:, -1]
            columns = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), *[pa.array(c.copy()) for c in p.T]]
            columns += [pa.array(last.copy()), pa.array((last >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", *[f"p_{c}" for c in names], "score", "predicted"])

    out = "doc_id long, held_out boolean, " + "".join(f"p_{c} double, " for c in names) + "score double, predicted int"
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("h"))
    return inputs.mapInArrow(work, out)
