"""Document quality by attention over passages (multiple-instance learning).

A document is a bag of passages of 64 words. Each passage is encoded by the mix of its bytes and by
how much it repeats itself and the text before it. A gated attention network, trained on labels of whole documents,
learns which passages matter: weights are a softmax over ``w . (tanh(V x) * sigmoid(U x))``, and
the score is a logistic function of the weighted mean of ``tanh(W x)``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import TextBlock, arrow_rows, blocks, held_out, labelled_sample, lean, materialize, mix64, prefix_hash, span_hash, utf8

PASSAGE_WORDS = 64
SAMPLE_DOCUMENTS = 6000  # most labelled documents to learn from
SAMPLE_PASSAGES = 160_000  # most passages of all of them together: 86 MB; beyond it the longest aren't learnt from
BYTE_CLASSES = np.array([b if b < 128 else 128 for b in range(256)])
FEATURES = 129 + 6


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A row of features for each passage of the texts, and how many passages each text has (at least one)."""
    block = TextBlock(texts)
    starts, ends = block.words()
    doc = block.owner(starts)
    words = np.bincount(doc, minlength=len(texts))
    counts = np.maximum(1, -(-words // PASSAGE_WORDS))
    first_passage = np.cumsum(counts) - counts
    first_word = np.cumsum(words) - words
    passage = first_passage[doc] + (np.arange(len(starts)) - first_word[doc]) // PASSAGE_WORDS
    total = int(counts.sum())
    # A passage's bytes go from its first word to the next passage; a text's first one takes what stands before.
    opens = np.flatnonzero(np.diff(passage, prepend=-1))
    begin = np.repeat(block.begins, counts)
    begin[passage[opens]] = starts[opens]
    begin[first_passage] = block.begins
    sizes = np.diff(np.append(begin, len(block.data)))
    of_byte = np.repeat(np.arange(total), sizes)
    mix = np.bincount(of_byte * 129 + BYTE_CLASSES[block.data], minlength=total * 129).reshape(total, 129)
    x = np.zeros((total, FEATURES), dtype=np.float32)
    x[:, :129] = np.sqrt(mix / np.maximum(1, sizes)[:, None])
    if len(starts):
        words_in = np.bincount(passage, minlength=total)
        n = np.maximum(1, words_in)
        word = span_hash(prefix_hash(block.data), starts, ends)
        # The word k places before; words of another text don't count.
        before = lambda k: np.concatenate((np.arange(k, dtype=np.uint64)[: len(word)], np.where(doc[k:] == doc[:-k], word[:-k], np.uint64(k))))
        same = np.append(False, (word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
        triple = mix64(word + np.uint64(3) * before(1)) + np.uint64(5) * before(2)

        def new(key: np.ndarray, group: np.ndarray) -> np.ndarray:
            """1 where a key stands first in its group."""
            first = np.zeros(len(key), dtype=np.float64)
            first[np.unique(mix64(key + mix64(group.astype(np.uint64))), return_index=True)[1]] = 1
            return first

        share = lambda v: np.bincount(passage, weights=v, minlength=total) / n
        x[:, 129] = share(new(word, passage))
        x[:, 130] = share(same)
        x[:, 131] = share(new(triple, doc))
        x[:, 132] = np.log1p(share(ends - starts))
        x[:, 133] = words_in / PASSAGE_WORDS
    x[:, 134] = np.log1p(np.repeat(words, counts)) / 10
    return x, counts


class AttentionModel:
    """Gated attention over passages; weights are plain arrays."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.w, self.mean, self.scale = weights, mean, scale

    def _forward(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        v, u = np.tanh(x @ w["V"]), 1 / (1 + np.exp(-np.clip(x @ w["U"], -30, 30)))
        e = (v * u) @ w["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "p": p}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        starts = np.cumsum(counts) - counts
        return self._forward((x - self.mean) / self.scale, starts, counts)["p"]

    @classmethod
    def fit(cls, x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 14, seed: int = 1) -> AttentionModel:
        """Adam on the log loss of whole documents, with a small penalty on weights."""
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        d = x.shape[1]
        w = {"W": draw(d, hidden), "b": np.zeros(hidden, np.float32), "V": draw(d, hidden), "U": draw(d, hidden), "a": draw(hidden), "c": draw(hidden), "d": np.zeros((), np.float32)}
        mean, scale = x.mean(0), x.std(0) + 0.02
        model = cls(w, mean, scale)
        x = ((x - mean) / scale).astype(np.float32)
        starts = np.cumsum(counts) - counts
        m, s, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
        for epoch in range(epochs):
            order = rng.permutation(len(counts))
            for at in range(0, len(order), 64):
                bags = order[at : at + 64]
                c = counts[bags]
                rows = np.concatenate([np.arange(starts[b], starts[b] + counts[b]) for b in bags])
                xb, sb = x[rows], np.cumsum(c) - c
                f = model._forward(xb, sb, c)
                dl = (f["p"] - y[bags]) / len(bags)
                dz = np.repeat(dl, c)[:, None] * w["c"]
                da = (dz * f["h"]).sum(1)
                de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, sb), c))
                dh = f["a"][:, None] * dz * (1 - f["h"] ** 2)
                gate = de[:, None] * w["a"]
                g = {
                    "W": xb.T @ dh, "b": dh.sum(0), "V": xb.T @ (gate * f["u"] * (1 - f["v"] ** 2)),
                    "U": xb.T @ (gate * f["v"] * f["u"] * (1 - f["u"])), "a": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ dl, "d": dl.sum(),
                }
                step += 1
                rate = 0.004 * (1 - epoch / epochs)
                for k in w:
                    grad = g[k] + 1e-4 * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    s[k] = 0.999 * s[k] + 0.001 * grad**2
                    w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return model


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS, passages: int = SAMPLE_PASSAGES) -> AttentionModel | None:
    """A model from at most `sample` labelled documents that aren't held out; None if fewer than two labels are there.

    A document is learnt with all its passages or not at all: where the sample has more than `passages`, its longest documents go.
    """

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(((utf8(t), q) for t, q in arrow_rows(batches)), 0):
            x, counts = encode([t for t, _ in rows])
            bag = [part.tobytes() for part in np.split(x, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([pa.array(bag, pa.binary()), pa.array(counts, pa.int32()), pa.array([q for _, q in rows], pa.int32())], names=["x", "n", "y"])

    # At most `sample` rows and `passages` passages reach the driver.
    bagged = materialize(labelled_sample(docs, labels, ["quality"], sample).mapInArrow(lean(bags), "x binary, n int, y int"), "bags")
    sizes = np.sort(bagged.select("n").toPandas()["n"].to_numpy(dtype=np.int64))
    over = sizes[np.cumsum(sizes) > passages]
    found = (bagged.where(F.col("n") < int(over[0])) if len(over) else bagged).toPandas()
    if found["y"].nunique() < 2:
        return None
    found = found.sort_values(["y", "n", "x"])  # the order of partitions doesn't count
    x = np.frombuffer(b"".join(map(bytes, found["x"])), dtype=np.float32).reshape(-1, FEATURES)
    return AttentionModel.fit(x, found["n"].to_numpy(dtype=np.int64), (found["y"].to_numpy() > 0).astype(np.float32))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document of (doc_id, text).

    Null and empty texts are one empty passage. Without labels of both kinds every score is 0.5 and
    predicted 1. Repeated rows each give a row, an empty table none; other columns are never looked at.
    Scoring needs no shuffle; a task holds about a megabyte of text at a time, or one longer text.
    """
    model = train(docs, labels, sample)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for rows in blocks(((i, utf8(t), h) for i, t, h in arrow_rows(batches)), 1):
            x, counts = encode([t for _, t, _ in rows])
            p = model.score(x, counts).astype(np.float64) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.bool_()), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id")).alias("h"))
    return inputs.mapInArrow(lean(work), "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """The rows whose text scores at least `least`, with all their columns; doc_id is a long and text a string.

    The model is trained as in `score_documents`; rows are judged where they are, without a join.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    text_at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            good = np.ones(batch.num_rows, dtype=bool)
            at = 0
            texts = ((utf8(t),) for (t,) in arrow_rows([batch.select([text_at])]))
            for rows in blocks(texts, 0):
                if model:
                    good[at : at + len(rows)] = model.score(*encode([t for (t,) in rows])) >= least
                at += len(rows)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(lean(work), docs.schema)
