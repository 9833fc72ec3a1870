"""Near duplicates by BagMinHash: weighted Jaccard likeness of multisets of word shingles.

A text is the multiset of its runs of five words. A shingle that occurs w times owns the weight line
[0, w). On it points fall as a Poisson process that depends on the shingle only, arranged as a
hierarchy of stretches [0,1), [1,2), [2,4), [4,8) ... so that only stretches below w are
generated. Each point has a time and one of m places; a signature holds the earliest time at each place. Two
signatures agree at a place with a probability of exactly the weighted Jaccard likeness.

Signatures are cut into bands. Texts that share a band are candidates, and every candidate pair that
can still join two groups is verified on the shingles themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import TextBlock, arrow_rows, blocks, connected, lean, materialize, mix64, prefix_hash, probably_in, span_hash, utf8

WORDS = 5
LEAST = 0.8
BANDS, ROWS = 32, 4  # a pair at 0.8 shares no band with probability (1 - 0.8**4)**32 = 5e-8
PLACES = BANDS * ROWS
CHUNK = 64  # pairs of one text that a task verifies in a row
SKETCH = 384  # places of the longer signatures that tell which pairs of a mixed bucket to verify
ENOUGH = 271  # equal places wanted: at a likeness of 0.8 fewer come with a probability of about 3e-6
BLOCK = 2048  # a larger bucket is compared block by block
BLOCK_BYTES = 32 << 20  # of bags; so is a bucket that has more


def bags(texts: list[bytes], words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, times), sorted by text and shingle. A text of fewer words is one shingle; one of none has none."""
    block = TextBlock(texts)
    starts, ends = block.words()
    doc = block.owner(starts)
    n = np.bincount(doc, minlength=len(texts))
    line = prefix_hash(span_hash(prefix_hash(block.data), starts, ends))
    first = np.cumsum(n) - n
    start = np.flatnonzero(np.arange(len(doc)) - first[doc] <= np.maximum(0, n - words)[doc])
    length = np.minimum(words, n)[doc[start]]
    doc, shingle = doc[start], span_hash(line, start, start + length)
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1]))[: len(doc)]
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, shingle: np.ndarray, times: np.ndarray, texts: int, places: int = PLACES) -> np.ndarray:
    """A row for each text: the earliest time at each place; infinite for texts without shingles."""
    out = np.full((texts, places), np.inf)
    weight = np.bincount(doc, weights=times, minlength=texts)
    horizon = places * (np.log(places) + 4) / np.maximum(weight, 1)
    # Stretch 0 is [0,1), stretch b is [2**(b-1), 2**b).
    stretches = np.where(times > 1, np.ceil(np.log2(np.maximum(times, 1))).astype(np.int64) + 1, 1)
    row = np.repeat(np.arange(len(doc)), stretches)
    b = np.arange(len(row)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    low = np.where(b == 0, 0.0, 2.0 ** (b - 1))
    width = np.maximum(low, 1.0)
    of, room = doc[row], times[row].astype(np.float64)
    seed = mix64(shingle[row] + np.uint64(0x9E3779B97F4A7C15) * b.astype(np.uint64))
    todo = weight > 0
    while todo.any():
        live = np.flatnonzero(todo[of])
        t, step = np.zeros(len(live)), 0
        while len(live):
            step += 1
            h = mix64(seed[live] + np.uint64(0xD1B54A32D192ED03 * step % (1 << 64)))
            t = t - np.log(((h >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)) / width[live]
            near = t <= horizon[of[live]]
            live, t, h = live[near], t[near], mix64(h[near])
            x = low[live] + (h >> np.uint64(32)).astype(np.float64) / (1 << 32) * width[live]
            mine = x < room[live]
            np.minimum.at(out, (of[live[mine]], ((h[mine] & np.uint64(0xFFFFFFFF)) % np.uint64(places)).astype(np.int64)), t[mine])
        # A text with an empty place looks twice as far.
        todo &= ~np.isfinite(out).all(1)
        horizon[todo] *= 2
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, :, r])
    return key.view(np.int64)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard likeness of two bags of (shingle, times), sorted by shingle."""
    at = np.searchsorted(b[0], a[0])
    hit = at < len(b[0])
    hit[hit] = b[0][at[hit]] == a[0][hit]
    shared = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    every = int(a[1].sum() + b[1].sum()) - shared
    return shared / every if every else 0.0


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in blocks(((i, k, utf8(t)) for i, k, t in arrow_rows(batches)), 2):
        doc, shingle, times = bags([t for _, _, t in rows])
        keys = band_keys(signatures(doc, shingle, times, len(rows)))
        cut = np.searchsorted(doc, np.arange(len(rows) + 1))
        digests, bands = [], []
        for n, (lo, hi) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)):
            digests.append(hashlib.blake2b(shingle[lo:hi].tobytes() + times[lo:hi].tobytes(), digest_size=16).digest() if hi > lo else None)
            bands.append(keys[n] if hi > lo else None)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "tkey", "digest", "bands"],
        )


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, chunk), the text of a itself first; gives the pairs that are alike."""
    held, bag = None, None

    def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
        return bags([utf8(text)])[1:]

    for batch in batches:
        out = []
        for a, chunk, first, b, text in arrow_rows([batch]):
            if first:
                held, bag = (a, chunk), bag_of(text)
            elif held == (a, chunk) and likeness(bag, bag_of(text)) >= LEAST:
                out.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], names=["a", "b"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lowest 8 bits of longer signatures, and the bag itself, 12 bytes a shingle.

    Places that differ look equal once in 256 times, those that are equal always do.
    """
    for rows in blocks(((i, k, utf8(t)) for i, k, t in arrow_rows(batches)), 2):
        doc, shingle, times = bags([t for _, _, t in rows])
        low = signatures(doc, shingle, times, len(rows), SKETCH).view(np.uint64).astype(np.uint8)
        cut = np.searchsorted(doc, np.arange(len(rows) + 1)).tolist()
        held = [shingle[lo:hi].tobytes() + times[lo:hi].astype(np.uint32).tobytes() for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        ids, keys = (pa.array([r[k] for r in rows], pa.int64()) for k in range(2))
        yield pa.RecordBatch.from_arrays(
            [ids, keys, pa.array([r.tobytes() for r in low], pa.binary()), pa.array(held, pa.binary())], names=["doc_id", "tkey", "sketch", "bag"]
        )


def _unpacked(bag: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(bag) // 12
    return np.frombuffer(bag, np.uint64, n), np.frombuffer(bag, np.uint32, n, 8 * n).astype(np.int64)


def _joins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join components within one bucket (or two of its blocks), verified on the bags; sorted input.

    Every pair of different components with enough equal places is looked at, in the first bucket that it shares, unless links
    found here have joined its components. So at most as many links come out as there are components, less one.
    """

    def settle(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        bucket, x, y = key
        mine, node, root, out, bands = (np.array([r[k] for r in held]) for k in range(3, 8))
        sketch = np.frombuffer(b"".join(r[8] for r in held), dtype=np.uint8).reshape(len(held), SKETCH)
        bag = [_unpacked(r[9]) for r in held]
        weight = np.array([times.sum() for _, times in bag])
        group = np.unique(root, return_inverse=True)[1]
        a, b = [], []
        asks = np.flatnonzero(out)
        for at in range(0, len(asks), 16):
            ask = asks[at : at + 16]
            equal = (sketch[ask][:, None, :] == sketch[None, :, :]).sum(2, dtype=np.int32)
            fit = (equal >= ENOUGH) & (group[ask][:, None] != group[None, :])
            # Two that both ask meet once, and weights that differ more than that leave no such likeness.
            fit &= ~out[None, :] | (ask[:, None] < np.arange(len(held))[None, :])
            fit &= np.minimum(weight[ask][:, None], weight[None, :]) >= LEAST * np.maximum(weight[ask][:, None], weight[None, :]) - 1e-6
            if x != y:
                fit &= mine[ask][:, None] != mine[None, :]
            i, j = np.nonzero(fit)
            likeliest = np.argsort(-equal[i, j], kind="stable")
            i, j = ask[i[likeliest]], j[likeliest]
            shared = bands[i] == bands[j]
            here = bands[i, shared.argmax(1)] == bucket
            for p, q in zip(i[here].tolist(), j[here].tolist(), strict=True):
                if group[p] != group[q] and likeness(bag[p], bag[q]) >= LEAST:
                    group[group == group[q]] = group[p]
                    a.append(max(node[p], node[q]))
                    b.append(min(node[p], node[q]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    key, held = None, []
    for row in arrow_rows(batches):
        if row[:3] != key:
            if len(held) > 1:
                yield settle(key, held)
            key, held = row[:3], []
        held.append(row)
    if len(held) > 1:
        yield settle(key, held)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, class_size, links for every document of (doc_id, text).

    A class is what links of likeness 0.8 or more connect; class_id is its least doc_id, class_size counts its
    rows, links those of the row's text. Texts with equal bags are one text from the start, so copies
    are never paired. Null, empty and blank texts are alike to nothing: classes of their own. Rows that repeat
    an id are rows of their own, an empty table gives none, other columns are ignored. A class without any id has a null id.

    A bucket of one band is never paired with itself: first all its texts meet its least and its
    greatest one; components are formed. In buckets that still hold several components, the texts outside
    the bucket's largest component are compared with all others by longer signatures, and pairs of different components
    with enough equal places are verified on their bags, all inside tasks and without making rows of pairs: only links that
    join components come out. So such a link is missed with a probability of about 3e-6, and pairs within a found
    component aren't made. links counts the links that came out: those to a bucket's least and greatest, and those that join components.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("tkey"), F.col("text").cast("string").alias("text"))
    signed = materialize(base.mapInArrow(lean(_sign), "doc_id long, tkey long, digest binary, bands array<long>"), "signed")
    known = signed.where("digest is not null")
    # One row for each different bag; its text is found again by the least (key of the text, id).
    nodes = known.groupBy("digest").agg(
        F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.min(F.struct("tkey", "doc_id")).alias("at"), F.first("bands").alias("bands")
    )
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    shared = materialize(shared, "shared")
    # Most bands are shared with nobody, and most texts meet nobody: they stay where they are.
    shares = probably_in(shared.select("bucket"))
    members = materialize(banded.where(shares(F.col("bucket"))).join(shared, "bucket"), "members")
    place = nodes.select("node", F.col("at.tkey").alias("tkey"), F.col("at.doc_id").alias("doc_id"))
    same = (F.col("d.tkey") == F.col("w.tkey")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))

    def found(some: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(node, tkey, doc_id) of the nodes in `some`, and the rows of documents that may be theirs, texts unmoved.

        Rows that repeat both id and text are there more than once, which does no harm.
        """
        row = F.xxhash64("tkey", "doc_id")
        wanted = materialize(place.join(some.select("node").distinct(), "node"), "wanted")
        return wanted, base.where(probably_in(wanted.select(row.alias("row")))(row))

    def verified(pairs: DataFrame) -> DataFrame:
        """`pairs` (a, b) is distinct; a's text is sent once to each chunk of its pairs."""
        degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
        pairs = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").cast("int").alias("chunk"))
        heads = pairs.select("a", "chunk").distinct().select("a", "chunk", F.lit(True).alias("first"), F.col("a").alias("b"))
        rows = materialize(heads.unionByName(pairs.withColumn("first", F.lit(False))), "sends")
        wanted, texts = found(rows.select(F.col("b").alias("node")))
        rows = rows.join(wanted.withColumnRenamed("node", "b"), "b")
        rows = texts.alias("d").join(rows.alias("w"), same).select("a", "chunk", "first", "b", "text")
        rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("first").desc())
        return materialize(rows.mapInArrow(lean(_verify), "a long, b long").distinct(), "verified")

    to_low = members.where("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    to_high = members.where("node > low and node < high").select(F.col("node").alias("b"), F.col("high").alias("a"))
    met = materialize(to_low.unionByName(to_high).distinct(), "pairs")
    links = verified(met)
    roots = connected(links)

    # What stars can't tell: other pairs of one bucket whose components differ.
    placed = materialize(members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")), "placed")
    sizes = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("roots")).where("roots > 1")
    main = main.select("bucket", F.col("m.root").alias("main"))
    mixed = materialize(placed.join(main, "bucket"), "mixed")
    wanted, texts = found(mixed)
    sketches = texts.mapInArrow(lean(_sketch), "doc_id long, tkey long, sketch binary, bag binary").alias("d")
    # Rows that repeat both id and text are one.
    sketches = sketches.join(wanted.alias("w"), same).dropDuplicates(["node"]).join(nodes.select("node", "bands"), "node")
    sketches = materialize(sketches.select("node", "bands", "sketch", "bag"), "sketches")
    weighed = mixed.join(sketches.select("node", F.octet_length("bag").alias("bytes")), "node")
    weighed = weighed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    many = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int")
    mixed = mixed.join(weighed.select("bucket", many.alias("many")), "bucket")
    mine = F.pmod(F.xxhash64("node"), "many").cast("int")
    mixed = mixed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1)))
    mixed = mixed.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "node", "root", "main")
    mixed = mixed.join(sketches, "node").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    mixed = mixed.select("bucket", "x", "y", "mine", "node", "root", (F.col("root") != F.col("main")).alias("out"), "bands", "sketch", "bag")
    extra = materialize(mixed.mapInArrow(lean(_joins), "a long, b long"), "joins")
    if not extra.isEmpty():
        # A pair meets in one bucket only, so none comes twice; none of them was a link before, or it would be in one component.
        links = materialize(links.unionByName(extra), "links")
        roots = connected(links)

    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    classed = nodes.select("node", "digest", "least_id", "copies").join(roots, "node", "left").join(ends, "node", "left")
    classed = classed.withColumn("root", F.coalesce("root", "node"))
    whole = classed.groupBy("root").agg(F.min("least_id").alias("class_id"), F.sum("copies").alias("class_size"))
    named = classed.join(whole, "root").select("digest", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    named = materialize(named, "classes")
    alone = F.col("digest").isNull()
    return signed.select("doc_id", "digest").join(named, "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )
