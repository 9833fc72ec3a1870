"""Document fingerprints: a Merkle tree over paragraphs and sections.

A paragraph is a line; its digest is the SHA-256 of its bytes. Paragraphs form sections, cut by
content: after an empty paragraph and after one whose digest starts with a byte divisible by four.
A section's digest is that of its paragraphs' digests, the root's that of the sections' digests, so
texts are equal if and only if their roots are. Inside a paragraph the tree goes on down to leaves,
runs of two or more words (about four) cut by content, of which 32 bits are kept.

A fingerprint is a string: root in hex, ``:``, the sections joined by ``/``, in them the paragraphs
joined by ``,``: the first eight hex digits of a paragraph's digest, then its leaves, eight hex digits each.
Cuts depend on content only, so an edit changes the leaves near it and the branch above them; all other
branches keep their digests. White space belongs to no leaf, but to its paragraph's digest.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkey.llm.common import TextBlock, arrow_rows, blocks, prefix_hash, mix64, span_hash, utf8

ROWS_PER_RANGE = 2000


def trees(texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Fingerprints of the texts, the leaves of all of them, and how many leaves each has."""
    block = TextBlock(texts)
    line_end = np.flatnonzero(block.data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1))
    starts, ends = block.words()
    prefix = prefix_hash(block.data)
    line = np.searchsorted(line_end, starts, side="left")
    first = np.diff(line, prepend=-1) != 0
    last = np.diff(line, append=-1) != 0
    word = span_hash(prefix, starts, ends)
    before = np.where(first, np.uint64(0), np.roll(word, 1))
    raw = (mix64(before * np.uint64(3) + word) & np.uint64(1)).astype(bool)
    cut = last | (raw & ~first & ~np.roll(raw, 1))
    cut_at = np.flatnonzero(cut)
    leaf_start = starts[np.concatenate(([0], cut_at[:-1] + 1))] if len(cut_at) else starts[:0]
    leaf = span_hash(prefix, leaf_start, ends[cut_at]).astype(np.uint32)
    upto = np.searchsorted(line[cut_at], np.arange(len(line_end)), side="right") * 8  # hex digits up to a line's end
    digits = leaf.astype(">u4").tobytes().hex()
    out, at = [], 0
    lines_upto = np.searchsorted(line_end, block.ends, side="left")
    bounds = zip(line_start.tolist(), line_end.tolist(), [0, *upto[:-1].tolist()], upto.tolist(), strict=True)
    for stop in lines_upto.tolist():
        root = hashlib.sha256()
        sections, paragraphs, section = [], [], hashlib.sha256()
        for _ in range(stop - at):
            lo, hi, d0, d1 = next(bounds)
            digest = hashlib.sha256(block.raw[lo:hi]).digest()
            section.update(digest)
            paragraphs.append(digest[:4].hex() + digits[d0:d1])
            if lo == hi or digest[0] % 4 == 0:
                root.update(section.digest())
                sections.append(",".join(paragraphs))
                paragraphs, section = [], hashlib.sha256()
        if paragraphs:
            root.update(section.digest())
            sections.append(",".join(paragraphs))
        at = stop
        out.append(f"{root.hexdigest()}:{'/'.join(sections)}")
    counts = np.diff(np.searchsorted(line[cut_at], lines_upto, side="left"), prepend=0)
    return out, leaf, counts


def fingerprint(text: str | None) -> str:
    return trees([utf8(text)])[0][0]


def _shared(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in both multisets, and how often."""
    a, na = np.unique(left, return_counts=True)
    b, nb = np.unique(right, return_counts=True)
    at = np.searchsorted(b, a)
    hit = np.zeros(len(a), dtype=bool)
    inside = at < len(b)
    hit[inside] = b[at[inside]] == a[inside]
    return a[hit], np.minimum(na[hit], nb[at[hit]])


def likeness(left: str, right: str) -> float:
    """1 for equal roots, else twice the shared leaves over all leaves and roots of both, which is less than 1."""
    root_a, _, a = left.partition(":")
    root_b, _, b = right.partition(":")
    if root_a == root_b:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex("".join(p[8:] for p in x.replace("/", ",").split(","))), dtype=">u4") for x in (a, b))
    return 2 * int(_shared(a, b)[1].sum()) / (len(a) + len(b) + 2)


def differing_branches(left: str, right: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Where two texts differ: (section, paragraph) indexes of the left's and the right's branches that the other lacks.

    Equal sections at both ends are passed over whole; of the rest, paragraphs are matched as often as both
    texts have them. Where all match, only their order or the cut into sections differs, and the paragraphs
    that differ from the other text's at the same place are given. Equal roots give two empty lists.
    """
    if left.partition(":")[0] == right.partition(":")[0]:
        return [], []
    a, b = ([s.split(",") for s in x.partition(":")[2].split("/")] for x in (left, right))
    head = next((n for n, (s, t) in enumerate(zip(a, b, strict=False)) if s != t), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((n for n, (s, t) in enumerate(zip(a[::-1], b[::-1], strict=False)) if s != t or n == most), most)
    flat_a, flat_b = ([((i, j), p) for i, s in enumerate(x) if head <= i < len(x) - tail for j, p in enumerate(s)] for x in (a, b))

    def only(mine: list[tuple], other: list[tuple]) -> list[tuple[int, int]]:
        spare, out = Counter(p for _, p in other), []
        for at, p in mine:
            spare[p] -= 1
            if spare[p] < 0:
                out.append(at)
        return out

    lacking = only(flat_a, flat_b), only(flat_b, flat_a)
    if any(lacking):
        return lacking
    moved = [(x[0], y[0]) for x, y in zip(flat_a, flat_b, strict=True) if x[1] != y[1]]
    return [x for x, _ in moved], [y for _, y in moved]


def _pairs_alike(fa: list[str], la: np.ndarray, na: np.ndarray, fb: list[str], lb: np.ndarray, nb: np.ndarray) -> list[float]:
    """Likeness of the i-th of one list of trees to the i-th of another."""
    n = len(fa)
    key = lambda leaf, counts: np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), counts) | leaf
    keys, times = _shared(key(la, na), key(lb, nb))
    both = np.bincount((keys >> np.uint64(32)).astype(np.int64), weights=times, minlength=n)
    value = 2 * both / (na + nb + 2)
    return [1.0 if x[:64] == y[:64] else v for x, y, v in zip(fa, fb, value.tolist(), strict=True)]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by range and place; the last row of a range is the next range's first, for looking ahead only."""

    def neighbours() -> Iterator[tuple]:
        held = None
        for bucket, ahead, doc_id, text in chain(arrow_rows(batches), [(None, 0, None, None)]):
            if held is not None and held[0] == bucket and not held[1]:
                yield held[2], held[3], text or ""
            if held is None or held[0] != bucket or not held[1]:  # of rows ahead, only the first counts
                held = (bucket, ahead, doc_id, text or "")

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    for rows in blocks(neighbours(), 1):
        texts = [utf8(r[1]) for r in rows]
        edited = [utf8(t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]) for _, t, nxt in rows]
        following = [utf8(r[2]) for r in rows]
        (fa, la, na), (fb, lb, nb) = trees(texts), trees(edited)
        # All but the last of the followers are texts of this block.
        fc, lc, nc = trees(following[-1:])
        shifted = (fa[1:] + fc, np.concatenate((la[na[0] :], lc)), np.concatenate((na[1:], nc)))
        if following[:-1] != texts[1:]:  # the block spans two ranges
            shifted = trees(following)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(fa),
                pa.array(fb),
                pa.array(_pairs_alike(fa, la, na, fb, lb, nb)),
                pa.array(_pairs_alike(fa, la, na, *shifted)),
            ],
            schema=schema,
        )


def fingerprint_documents(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of every text and of its edited form, and how like they are to each other and to the next text's.

    `docs` needs doc_id and text; other columns are ignored. The order is by doc_id, nulls first, then
    by text; after the last comes the first (a single document follows itself). Null texts count as
    empty. Repeated rows each give a row. An empty table gives no rows.

    Ids are cut into ranges of about `rows_per_range` rows. The first document of a range also goes to
    the end of the range before, so neighbours meet in one task, texts are shuffled once, and no
    task holds more than a block of texts at a time. The driver sees one id per range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = docs.count()
    if not rows:
        return docs.sparkSession.createDataFrame([], RESULT)
    ids = docs.select("doc_id").where("doc_id is not null")
    ranged = ids.repartitionByRange(max(1, rows // rows_per_range), "doc_id")
    firsts = sorted(r[0] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("m")).select("m").collect())
    has_null = rows > ids.count()
    bounds = np.array(firsts, dtype=np.int64)
    buckets = len(firsts) + has_null  # null ids are a range of their own, the first

    @F.pandas_udf("array<long>")
    def places(i: pd.Series, is_null: pd.Series) -> pd.Series:
        at = np.searchsorted(bounds, i.to_numpy(dtype=np.int64), side="right") - 1 + has_null
        at[is_null.to_numpy()] = 0
        lead = np.zeros(len(at), dtype=bool)
        if len(bounds):
            lead = ~is_null.to_numpy() & (bounds[np.maximum(at - has_null, 0)] == i.to_numpy(dtype=np.int64))
        lead |= is_null.to_numpy()
        # A place is twice the range, plus one for a row that stands there only to be looked at.
        return pd.Series([[b * 2, (b - 1) % buckets * 2 + 1] if x else [b * 2] for b, x in zip(at.tolist(), lead.tolist(), strict=True)])

    placed = docs.select(F.explode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())).alias("place"), "doc_id", "text")
    placed = placed.select((F.col("place") / 2).cast("long").alias("bucket"), (F.col("place") % 2).cast("int").alias("ahead"), "doc_id", "text")
    return placed.repartition("bucket").sortWithinPartitions("bucket", "ahead", "doc_id", "text").mapInArrow(_judge, RESULT)
