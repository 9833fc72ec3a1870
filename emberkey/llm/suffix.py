"""Remove every byte that lies in a 100-byte string which also starts earlier in the corpus.

Texts are bytes and matches stay inside a text. "Earlier" is a smaller doc_id, or a smaller start
in the same document. The corpus is never indexed as a whole; four steps narrow it down exactly:

1. Every window of 100 bytes is owned by an anchor: the leftmost of its 32-byte strings with the least
   hash. Equal windows have equal anchors at equal places. An anchor carries the hash of all its windows together.
2. Anchors meet by hash. Where all windows of two anchors are equal, all but the first are repeats.
   Anchors with equal strings but different surroundings are left over.
3. Only their surroundings are indexed: a run-length index, the Burrows-Wheeler transform of the
   suffixes in the order of their first 100 bytes, kept as runs with the text positions at both ends of each.
   Suffixes with 100 equal bytes are neighbours in text order, so the least run end of such a stretch is the earliest
   place. A window's stretch is looked up by the rank of its position; there is no backward search over the runs.
4. The marked windows of a document are joined and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import BASE, INVERSE, TextBlock, arrow_rows, blocks, lean, materialize, mix64, powers, prefix_hash, span_hash, utf8

LENGTH = 100
ANCHOR = 32
WINDOW = LENGTH - ANCHOR + 1  # anchors to choose from in one window
FLUSH_BYTES = 16 << 20  # texts whose anchors are grouped before they are sent
INDEX_BYTES = 1 << 20  # text of one index, unless a single group is longer
WIDE = 1000  # an anchor with more different surroundings is dealt by its windows
NO_ID = -(1 << 63)
MOST_RANGE = 65_535  # bytes of a packed range
_RECORD = np.dtype([("h", "<u8"), ("c", "<u4"), ("c2", "<u2"), ("doc", "<u4"), ("pos", "<u4"), ("pre", "u1"), ("more", "u1")])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: text, hash, hash of its windows together, first and last window (starts in the text)."""
    block = TextBlock(texts)
    n = len(block.data)
    if n < LENGTH:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    prefix = prefix_hash(block.data)
    value = (prefix[ANCHOR:] - prefix[:-ANCHOR]) * powers(INVERSE, n)[: n - ANCHOR + 1]
    value *= np.uint64(0xFF51AFD7ED558CCD)
    value ^= value >> np.uint64(32)
    value *= np.uint64(BASE)
    best, at, span = value, np.arange(len(value), dtype=np.int32), 1
    while span < WINDOW:  # the leftmost least of span, then of twice as many
        step = min(span, WINDOW - span)
        right = best[step:] < best[:-step]
        best, at = np.where(right, best[step:], best[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    sizes = np.diff(block.ends, prepend=0) - 1
    windows = np.maximum(0, sizes - LENGTH + 1)
    start = np.repeat(block.begins - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    if not len(start):
        return anchors([])
    owner = at[start]
    opens = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)))
    first, last = start[opens], start[np.append(opens[1:], len(start)) - 1]
    anchor, doc = owner[opens], np.repeat(np.arange(len(texts)), windows)[opens]
    together = mix64(span_hash(prefix, first, last + LENGTH) + (anchor - first).astype(np.uint64))
    base = block.begins[doc]
    return doc, value[anchor], together, first - base, last - base


def _packed(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A range of a text as one number; ranges are shorter than 65,536 bytes."""
    return start.astype(np.int64) << 16 | (end - start).astype(np.int64)


def _joined(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same bytes of each text in as few ranges as a packed range's length allows."""
    if not len(ids):
        return ids, keys, start, end
    by = np.lexsort((start, keys, ids))
    ids, keys, start, end = ids[by], keys[by], start[by], end[by]
    text = np.cumsum(np.append(False, (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
    # Texts get stretches of one line that don't touch, so that one running maximum serves them all.
    line = text * (int(end.max()) + 2)
    reach = np.maximum.accumulate(line + end)
    at = np.flatnonzero(np.append(True, (line + start)[1:] > reach[:-1]))
    start, end = start[at], (reach - line)[np.append(at[1:], len(ids)) - 1]
    pieces = (end - start + MOST_RANGE - 1) // MOST_RANGE
    of = np.repeat(np.arange(len(at)), pieces)
    turn = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = start[of] + turn * MOST_RANGE
    return ids[at][of], keys[at][of], start, np.minimum(start + MOST_RANGE, end[of])


def _marks(ids: np.ndarray, keys: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    ids, keys, start, end = _joined(ids, keys, start, end)
    n = len(ids)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, -1, np.int32)), pa.array(ids), pa.array(keys), pa.array(_packed(start, end)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
        names=_FOUND_NAMES,
    )


#: part: where a blob of anchors goes, -1 for a range to cut, -2 for the range of an anchor to look at closer.
_FOUND = "part int, id long, tkey long, range long, anchor long, blob binary"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _group(parts: int):
    """Texts to blobs of anchors by part; an anchor with an equal one earlier in the same stretch of texts is marked at once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            ids, keys = (np.array([x for h in held for x in h[k]], dtype=np.int64) for k in (0, 1))
            base = np.cumsum([0] + [len(h[0]) for h in held])[:-1]
            doc = np.concatenate([h[2][0] + b for h, b in zip(held, base, strict=True)])
            value, together, first, last = (np.concatenate([h[2][k] for h in held]) for k in range(1, 5))
            rank = np.empty(len(ids), dtype=np.uint64)
            order = np.lexsort((keys, ids))
            rank[order] = np.cumsum(np.append(False, (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])))
            kind = mix64(value + np.uint64(BASE) * together)
            by = np.lexsort((rank[doc] << np.uint64(32) | first.astype(np.uint64), kind))
            new = np.append(True, kind[by][1:] != kind[by][:-1])[: len(by)]
            # Rows that repeat id and text have no order among themselves: they stay like the first.
            lead = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))] if len(by) else by
            tie = (rank[doc[lead]] == rank[doc[by]]) & (first[lead] == first[by])
            again = by[~tie]
            yield _marks(ids[doc[again]], keys[doc[again]], first[again], last[again] + LENGTH)
            keep = by[new]
            part = (mix64(value[keep]) % np.uint64(parts)).astype(np.int64)
            keep = keep[np.argsort(part, kind="stable")]
            part = np.sort(part)
            cut = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
            blobs, of = [], []
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(part)).tolist(), strict=True):
                k = keep[lo:hi]
                here, at = np.unique(doc[k], return_inverse=True)
                r = np.empty(len(k), dtype=_RECORD)
                r["h"], r["c"], r["c2"], r["doc"] = value[k], together[k] & np.uint64(0xFFFFFFFF), together[k] >> np.uint64(48), at
                r["pos"], r["pre"], r["more"] = first[k], 0, last[k] - first[k]
                columns = b"".join(r[name].tobytes() for name in _RECORD.names)
                blobs.append(np.array([len(here), len(k)], np.int64).tobytes() + ids[here].tobytes() + keys[here].tobytes() + columns)
                of.append(part[lo])
            n = len(blobs)
            none = pa.nulls(n, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(of, np.int32)), none, none, none, none, pa.array(blobs, pa.binary())], names=_FOUND_NAMES)

        for rows in blocks(((i, k, utf8(t)) for i, k, t in arrow_rows(batches)), 2):
            held.append(([r[0] for r in rows], [r[1] for r in rows], anchors([r[2] for r in rows])))
            size += sum(len(r[2]) for r in rows)
            if size >= FLUSH_BYTES:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return work


def _read_blobs(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    out = []
    for b in blobs:
        docs, n = np.frombuffer(b, np.int64, 2)
        ids, keys = np.frombuffer(b, np.int64, docs, 16), np.frombuffer(b, np.int64, docs, 16 + 8 * docs)
        at, cols = 16 + 16 * int(docs), {}
        for name in _RECORD.names:
            cols[name] = np.frombuffer(b, _RECORD[name], n, at)
            at += int(n) * _RECORD[name].itemsize
        c = cols["c"].astype(np.uint64) | cols["c2"].astype(np.uint64) << np.uint64(32)
        out.append((cols["h"], c, ids[cols["doc"]], keys[cols["doc"]], cols["pos"].astype(np.int64), cols["more"].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _meet(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[pa.RecordBatch]:
    """One part after the other: mark anchors whose windows all stand earlier, and name those to look at closer."""
    part, blobs = None, []

    def settle() -> Iterator[pa.RecordBatch]:
        h, c, ids, keys, first, more = _read_blobs(blobs)
        by = np.lexsort((first, keys, ids, c, h))
        h, c, ids, keys, first, more = (x[by] for x in (h, c, ids, keys, first, more))
        new_h = np.append(True, h[1:] != h[:-1])
        new = new_h | np.append(True, c[1:] != c[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        tie = (ids[lead] == ids) & (keys[lead] == keys) & (first[lead] == first)
        yield _marks(ids[~tie], keys[~tie], first[~tie], first[~tie] + more[~tie] + LENGTH)
        at = np.flatnonzero(new)
        group = np.cumsum(new_h)[at] - 1
        kinds = np.bincount(group)[group]
        at, kinds = at[kinds > 1], kinds[kinds > 1]
        n = len(at)
        # An anchor with very many surroundings is marked by the lowest bit of its number.
        number = (h[at] & ~np.uint64(1) | (kinds > wide).astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, -2, np.int32)), pa.array(ids[at]), pa.array(keys[at]), pa.array(_packed(first[at], first[at] + more[at])), pa.array(number), pa.nulls(n, pa.binary())],
            names=_FOUND_NAMES,
        )

    for b in batches:
        through = b.filter(pa.array(b.column(0).to_numpy() < 0))
        if through.num_rows:
            yield through
        for p, blob in zip(b.column(0).to_pylist(), b.column(5), strict=True):
            if p < 0:
                continue
            if p != part and blobs:
                yield from settle()
                blobs = []
            part = p
            blobs.append(blob.as_py())
    if blobs:
        yield from settle()


class RunIndex:
    """A run-length index of a text for matches of up to `limit` bytes; 256 stands between pieces that nothing may cross.

    `order` lists positions by their first `limit` bytes, then by position. Runs are stretches of this order with one
    preceding byte and one string of `limit` bytes; `start`, `head` and `tail` are their places in the order and
    the text positions at their two ends, `byte` their preceding byte. The order itself is dropped.
    """

    def __init__(self, data: np.ndarray, limit: int = LENGTH):
        n = len(data)
        key = np.zeros(n, dtype=np.uint64)
        for k in range(7):
            key[: n - k] |= data[k:].astype(np.uint64) << np.uint64(9 * (6 - k))
        rank, width = np.unique(key, return_inverse=True)[1].astype(np.uint64), 7
        while width < limit:
            step = min(width, limit - width)
            pair = rank * np.uint64(n + 1)
            pair[: n - step] += rank[step:] + np.uint64(1)
            rank, width = np.unique(pair, return_inverse=True)[1].astype(np.uint64), width + step
        order = np.argsort(rank, kind="stable")
        before = data[order - 1]
        before[order == 0] = 0
        string = rank[order]
        new = np.append(True, (string[1:] != string[:-1]) | (before[1:] != before[:-1]))[:n]
        self.start = np.flatnonzero(new)
        self.byte, self.head = before[self.start], order[self.start]
        self.tail = order[np.append(self.start[1:], n) - 1]
        self.string = string[self.start]  # which string of `limit` bytes a run is of; rising
        self.rank = rank

    def earliest(self, positions: np.ndarray) -> np.ndarray:
        """The first place of the `limit` bytes at each position: the least end of the string's runs."""
        least = np.minimum.reduceat(self.head, np.flatnonzero(np.append(True, self.string[1:] != self.string[:-1])))
        return least[self.rank[positions].astype(np.int64)]


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Surroundings, sorted by anchor and order, to marked ranges; whole groups of one anchor go into one index."""
    held: list[tuple] = []
    size, anchor = 0, None

    def settle() -> pa.RecordBatch:
        block = TextBlock([r[4] for r in held])
        data = block.data.astype(np.uint16)
        data[block.ends - 1] = 256
        index = RunIndex(data)
        # Windows are all starts that leave room for 100 bytes of the same surroundings.
        windows = np.diff(block.ends, prepend=0) - LENGTH
        of = np.repeat(np.arange(len(held)), windows)
        at = np.repeat(block.begins - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        source = np.searchsorted(block.ends, early := index.earliest(at), side="right")
        ids, keys, first = (np.array([r[k] for r in held], dtype=np.int64) for k in (1, 2, 3))
        offset, early_offset = at - block.begins[of], early - block.begins[source]
        itself = (ids[source] == ids[of]) & (keys[source] == keys[of]) & (first[source] + early_offset == first[of] + offset)
        of, offset = of[~itself], offset[~itself]
        opens = np.append(True, (of[1:] != of[:-1]) | (offset[1:] != offset[:-1] + 1))[: len(of)]
        lo = np.flatnonzero(opens)
        hi = np.append(lo[1:], len(of)) - 1 if len(lo) else lo
        whose = of[lo]
        return _marks(ids[whose], keys[whose], first[whose] + offset[lo], first[whose] + offset[hi] + LENGTH)

    known: list[tuple] = []

    def passed() -> pa.RecordBatch:
        ids, keys, first = (np.array([r[k] for r in known], dtype=np.int64) for k in (1, 2, 3))
        return _marks(ids, keys, first, first + LENGTH)

    for row in arrow_rows(batches):
        if row[4] is None:
            known.append(row)
            if len(known) == 4096:
                yield passed()
                known = []
            continue
        if held and size >= INDEX_BYTES and row[0] != anchor:
            yield settle()
            held, size = [], 0
        anchor = row[0]
        held.append(row)
        size += len(row[4])
    if held:
        yield settle()
    if known:
        yield passed()


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with ranges of anchors to the bytes there; wide anchors to their windows, each under its own hash."""
    seen: dict[bytes, tuple[int, int, int]] = {}

    def rows() -> Iterator[tuple]:
        for i, k, text, found in arrow_rows(batches):
            raw = utf8(text)
            for f in found:
                start, anchor = f["range"] >> 16, f["anchor"]
                end = start + (f["range"] & 0xFFFF) + LENGTH
                if not anchor & 1:
                    yield anchor, i, k, start, raw[start:end]
                    continue
                for at in range(start, end - LENGTH + 1):
                    window = raw[at : at + LENGTH]
                    name = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True) | 1
                    # A window with an equal one before it that was sent from here is a repeat; only the mark is sent.
                    before = seen.get(window)
                    if before is not None and before < (i, k, at):
                        yield name, i, k, at, None
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[window] = (i, k, at)
                    yield name, i, k, at, window

    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=["anchor", "id", "tkey", "first", "bytes"])

    for r in rows():
        held.append(r)
        if len(held) == 4096:
            yield batch()
            held = []
    if held:
        yield batch()


def with_ranges(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """The rows with `ranges` added: an array of numbers, start * 65536 + length in bytes, to be cut from the text.

    `docs` may have only columns that the caller wants back; doc_id is a long and text a string.

    Null ids come before all others. Rows that repeat both id and text have equal results: none of them is
    earlier than the other. Rows that repeat an id with other texts are ordered by a hash of the text.
    """
    key = F.xxhash64(F.coalesce("text", F.lit("")))  # tells rows of one id apart
    base = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), key.alias("tkey"), F.coalesce("text", F.lit("")).alias("text"))
    parts = max(64, base.count() // 4000)
    grouped = base.mapInArrow(lean(_group(parts)), _FOUND)
    # Marks pass through; they are spread by their documents.
    grouped = grouped.repartition(F.when(F.col("part") >= 0, F.col("part").cast("long")).otherwise(F.xxhash64("id", "range")))
    found = materialize(grouped.sortWithinPartitions("part").mapInArrow(lean(lambda it: _meet(it, wide)), _FOUND), "found")
    closer = found.where("part = -2").groupBy("id", "tkey").agg(F.collect_list(F.struct("range", "anchor")).alias("found"))
    around = base.join(closer, ["id", "tkey"]).select("id", "tkey", "text", "found").mapInArrow(lean(_surroundings), "anchor long, id long, tkey long, first long, bytes binary")
    around = around.repartition(F.when(F.col("bytes").isNotNull(), F.col("anchor")).otherwise(F.xxhash64("id", "first")))
    around = around.sortWithinPartitions("anchor", "id", "tkey", "first")
    cut = materialize(around.mapInArrow(lean(_index), _FOUND).select("id", "tkey", "range"), "cut")
    marks = found.where("part = -1").select("id", "tkey", "range").unionByName(cut)
    marks = marks.groupBy("id", "tkey").agg(F.collect_list("range").alias("ranges"))
    own = [F.col("d." + c) for c in docs.columns]
    same_id = F.coalesce("d.doc_id", F.lit(NO_ID)) == F.col("m.id")
    same_text = F.xxhash64(F.coalesce("d.text", F.lit(""))) == F.col("m.tkey")
    return docs.alias("d").join(marks.alias("m"), same_id & same_text, "left").select(*own, "m.ranges")


def spans(ranges: list[int] | None) -> list[tuple[int, int]]:
    """Ranges joined where they overlap or touch."""
    if not ranges:
        return []
    r = np.sort(np.array(ranges, dtype=np.int64))
    start, end = r >> 16, (r >> 16) + (r & 0xFFFF)
    reach = np.maximum.accumulate(end)
    opens = np.append(True, start[1:] > reach[:-1])
    at = np.flatnonzero(opens)
    return list(zip(start[at].tolist(), reach[np.append(at[1:], len(r)) - 1].tolist(), strict=True))


def without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for lo, hi in cuts:
        kept.append(raw[at:lo])
        at = hi
    kept.append(raw[at:])
    return b"".join(kept)


def remove_repeats(docs: DataFrame, wide: int = WIDE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay) for every document of (doc_id, text).

    Null texts count as empty, texts under 100 bytes keep all bytes. An empty table gives no rows; other
    columns are ignored. For repeated rows see `with_ranges`.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in blocks(((i, utf8(t), r) for i, t, r in arrow_rows(batches)), 1):
            cuts = [spans(r[2]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([len(r[1]) for r in rows], pa.int64()),
                    pa.array([sum(hi - lo for lo, hi in c) for c in cuts], pa.int64()),
                    pa.array([len(c) for c in cuts], pa.int64()),
                    pa.array([without(r[1], c) for r, c in zip(rows, cuts, strict=True)], pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_ranges(plain, wide).mapInArrow(lean(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
