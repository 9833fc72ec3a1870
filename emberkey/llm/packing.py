"""Best-fit decreasing packing of tokenised documents into sequences of a fixed capacity.

What best fit decides depends on lengths alone, and a length is a whole number up to the capacity. So the
corpus is counted by length, and the packing is planned for all documents of a length at once: a segment
tree over remaining capacities names the tightest open bins, and one run puts as many documents into as many of
them as equal steps of best fit would. The plan grows with the capacity, not with the corpus. Rows then find
their place by their number among the rows of their length.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberkey.llm.common import arrow_rows, blocks, materialize

CACHE_ENTRIES = 200_000  # short pre-tokens remembered by a worker, about 40 MB
CACHED_CHARS = 24
PART_CHARS = 1 << 20  # longer texts are split at a word's end, which changes no id
#: Fixed: how byte-level definitions split a text.
SPLIT = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""").findall
#: The same for texts of nothing but ASCII and Latin letters and signs, in classes that need no tables, three times as fast.
NOT_LATIN = re.compile(r"[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u017f]").search
_L, _W = r"A-Za-zªµºÀ-ÖØ-öø-\u017f", r" \t-\r"
LATIN_SPLIT = re.compile(rf""" ?[{_L}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^{_W}0-9{_L}]+|[{_W}]+(?![^{_W}])|[{_W}]+""").findall
#: A place before white space that follows other characters; no pre-token goes over it.
WORD_END = regex.compile(r"(?<=\S)(?=\s)")
PIECES = "doc_id long, piece int, start long, length long, ids binary"
RANK_BITS = 48  # numbers of rows of one length
#: length | first row of that length | rows | rows a bin | first sequence | offset in it
RUN = ("length", "first", "rows", "per_bin", "sequence", "offset")


class OpenBins:
    """Open bins by remaining capacity, in a segment tree that says where any are open.

    Bins of one remaining capacity are kept as stretches (first sequence, how many).
    """

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()  # more than capacity, so that each has a leaf
        self.any = bytearray(2 * self.leaves)
        self.stretches: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, remaining: int) -> None:
        at = remaining + self.leaves
        self.any[at] = bool(self.stretches[remaining])
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def add(self, remaining: int, sequence: int, count: int) -> None:
        if count and remaining:
            self.stretches[remaining].append((sequence, count))
            self._mark(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        stretch = self.stretches[remaining].pop()
        self._mark(remaining)
        return stretch

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` with an open bin, in logarithmic time."""
        at = length + self.leaves
        while not self.any[at]:  # up, to the next subtree on the right that has one
            while at & 1:
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.leaves:  # down, to its leftmost one
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing of counts[length] items of every length, as runs (see `RUN`).

    An item goes where it leaves least over. The bin it went to is then the tightest one, so the next item of
    its length follows it, until the bin has no room; so one run fills `r // length` items into each bin of a stretch with
    r left. A run ends a length or a stretch; a stretch that ends leaves one with less than half of r, and an ended length adds
    two, so there are at most about 3 log2(capacity) runs a length, whatever the counts.
    """
    bins, opened = OpenBins(capacity), 0
    runs: list[tuple[int, ...]] = []
    for length in sorted((n for n in counts if counts[n]), reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        first, left = 0, counts[length]
        while left:
            remaining = bins.tightest(length)
            if remaining is None:
                remaining = capacity
                sequence, count = opened, -(-left // (capacity // length))
                opened += count
            else:
                sequence, count = bins.take(remaining)
            each = remaining // length
            rows = min(left, count * each)
            full, some = divmod(rows, each)
            runs.append((length, first, rows, each, sequence, capacity - remaining))
            bins.add(remaining - each * length, sequence, full)
            if some:
                bins.add(remaining - some * length, sequence + full, 1)
            used = full + bool(some)
            bins.add(remaining, sequence + used, count - used)
            first, left = first + rows, left - rows
    return np.array(runs, dtype=np.int64).reshape(-1, len(RUN))


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each row among those of its length; `seen` counts them on."""
    order = np.argsort(lengths, kind="stable")
    sorted_ = lengths[order]
    begins = np.flatnonzero(np.diff(sorted_, prepend=-1))
    within = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = within + seen[sorted_]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a `length` from 1 to `capacity`; another length, or none, raises an error.

    Every row is numbered among the rows of its length: in its task while the rows are written, and
    tasks are lined up by their counts, one row for each task and length. Only the counts by length, at most
    `capacity` numbers, reach the driver; the plan that goes back is bounded by the capacity as well (see `plan`).
    Other columns stay as they are; ties are equal rows, which may change places. Written rows cut the lineage.
    """
    part, nth = "__part", "__nth"
    taken = {part, nth, "sequence_id", "offset"} & set(pieces.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are named here")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, dtype=np.int64)
        task = TaskContext.get().partitionId()
        for batch in batches:
            column = batch.column("length")
            lengths = column.to_numpy(zero_copy_only=False) if column.null_count == 0 else np.zeros(1)
            if len(lengths) and not (lengths.min() >= 1 and lengths.max() <= capacity):
                raise ValueError(f"lengths must be from 1 to {capacity}")
            more = [pa.array(np.full(len(lengths), task, dtype=np.int64)), pa.array(_numbered(lengths.astype(np.int64), seen))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, part, nth])

    pieces = pieces.withColumn("length", F.col("length").cast("long"))
    names = pieces.columns
    kind = T.StructType([*pieces.schema.fields, T.StructField(part, T.LongType()), T.StructField(nth, T.LongType())])
    rows = materialize(pieces.mapInArrow(number, kind), "pieces")
    counts = rows.groupBy(part, "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "bases")
    totals = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = plan(totals, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    shipped = pieces.sparkSession.sparkContext.broadcast(runs)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shipped.value
        starts = (runs[:, 0] << RANK_BITS) + runs[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = batch.column("length").to_numpy()
            rank = batch.column("base").to_numpy() + batch.column(nth).to_numpy()
            run = runs[np.searchsorted(starts, (lengths << RANK_BITS) + rank, side="right") - 1]
            bin_, turn = np.divmod(rank - run[:, 1], run[:, 3])
            more = [pa.array(run[:, 4] + bin_), pa.array(run[:, 5] + turn * lengths)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), *more], names=[*names, "sequence_id", "offset"])

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return rows.join(bases.select(part, "length", "base"), [part, "length"]).mapInArrow(find, out)


# ---- tokens ---------------------------------------------------------------------------------------


def _letters() -> np.ndarray:
    """The letter that byte-level vocabularies write for each byte: itself if it is printable in Latin-1, else the next from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.zeros(256, dtype="<u2")
    letters[shown] = shown
    letters[letters == 0] = np.arange(256, 512 - len(shown))
    return letters


class Encoder:
    """Ids of texts by a byte-level model of `tokenizers`, as little-endian unsigned 32-bit integers.

    Texts are split into pre-tokens here, and each distinct one goes through the model once. Strings of special tokens in a text are
    ordinary text.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenize = tokenizers.Tokenizer.from_str(definition).model.tokenize
        self.letters = _letters()
        self.known: dict[str, bytes] = {}

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        raw = [p.encode() for p in pieces]
        written = self.letters[np.frombuffer(b"".join(raw), dtype=np.uint8)].tobytes().decode("utf-16-le")
        cuts = pairwise(accumulate(map(len, raw), initial=0))
        return {p: array("I", [t.id for t in self.tokenize(written[a:b])]).tobytes() for p, (a, b) in zip(pieces, cuts, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Short pre-tokens are remembered for later calls, long ones for a block."""
        out: list[list[bytes]] = [[] for _ in texts]
        for block in blocks(((k, p) for k, t in enumerate(texts) for p in parts(t)), 1):
            known = self.known
            if len(known) > CACHE_ENTRIES:
                known.clear()
            pieces = [split(p) for _, p in block]
            new = set().union(*pieces).difference(known)
            known.update(self.learn(list(new)))
            for (k, _), found in zip(block, pieces, strict=True):
                out[k].append(b"".join(map(known.__getitem__, found)))
            for p in new:
                if len(p) > CACHED_CHARS:
                    del known[p]
        return [b"".join(x) for x in out]


def split(text: str) -> list[str]:
    """The pre-tokens of a text."""
    return LATIN_SPLIT(text) if NOT_LATIN(text) is None else SPLIT(text)


def parts(text: str, limit: int = PART_CHARS) -> Iterable[str]:
    """The text in parts of about `limit` characters that end where a word does."""
    if len(text) <= limit:
        return [text]
    cuts = [0]
    while end := WORD_END.search(text, cuts[-1] + limit):
        cuts.append(end.start())
    return [text[a:b] for a, b in pairwise([*cuts, len(text)])]


@lru_cache(maxsize=2)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


def cut(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all but the first are of the full capacity."""
    first = (tokens - 1) % capacity + 1
    lengths = [first] + [capacity] * ((tokens - first) // capacity)
    return list(zip([0, *accumulate(lengths)], lengths, strict=False))


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit integers) of every document, an end id after each.

    `tokenizer` is the path of a definition on the driver; its text (about 2 MB) is broadcast. Null texts count as empty: one piece
    with the end id. Every row is a document of its own, also where rows or ids repeat, or the id is null; an empty table gives
    none. Columns other than doc_id and text are ignored. No shuffle; memory holds a block of texts and a bounded cache.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    end = np.array([end_id], dtype="<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    names = ["doc_id", "piece", "start", "length", "ids"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value)
        for rows in blocks(((i, t or "") for i, t in arrow_rows(batches)), 1):
            out = []
            for (doc_id, _), ids in zip(rows, encoder.encode([t for _, t in rows]), strict=True):
                ids += end
                out += [(doc_id, k, a, n, ids[4 * a : 4 * (a + n)]) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity))]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of all documents (see `encode_pieces`) with their ids, `sequence_id` and `offset`."""
    return place(encode_pieces(docs, tokenizer, capacity, end_id), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, length, ids: the packed pieces put together, each sequence at most the capacity long."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(inside, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
