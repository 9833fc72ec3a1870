"""What several operators share: texts as byte arrays, word and span hashes, working tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberkey.session import materialize

BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_BYTES = 1 << 20
FILTER_BITS = 1 << 26  # 8 MB
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: All but ASCII letters, digits and the bytes of other characters.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; the longest table so far is kept up to 2 million entries."""
    known = _powers.get(base)
    if known is None or len(known) <= n:
        known = np.full(max(n, BLOCK_BYTES) + 1, base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if len(known) <= 2 << 20:
            _powers[base] = known
    return known[: n + 1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes, modulo 2**64; `data` holds bytes or other integers."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data))[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal spans have equal hashes wherever they stand."""
    return mix64((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix) - 1)[start] ^ (end - start).astype(np.uint64))


class TextBlock:
    """Some texts, laid end to end with a line feed after each, and their words."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)  # one past the line feed
        self.begins = np.concatenate(([0], self.ends[:-1])).astype(np.int64)

    def __len__(self) -> int:
        return len(self.ends)

    def words(self, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes that aren't `between` words, ASCII white space by default."""
        space = between[self.data]
        edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
        return edge[0::2], edge[1::2]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """The text that each position lies in."""
        return np.searchsorted(self.ends, positions, side="right")


def blocks(items: Iterable[tuple], text_at: int, limit: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Consecutive items in lists of at most about `limit` bytes of text each."""
    held: list[tuple] = []
    size = 0
    for item in items:
        held.append(item)
        size += len(item[text_at]) + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def arrow_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`work` for `mapInArrow`, giving the memory that it has freed back to the system at its end.

    Python workers live on for later tasks, and a worker's freed memory is of no use to the executor beside it.
    """

    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
        if trim:
            trim(0)

    return run


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8")


def held_out(doc_id: Column) -> Column:
    """Rows that no model may learn from: those whose crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """(text, *columns) of at most `rows` labelled documents that aren't held out, the same ones in every run.

    Labels with a null are left out, and of several labels or texts for one id the least counts. The sampled ids are at most `rows`,
    so they are broadcast, and the documents aren't shuffled to find them.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns])
    known = known.dropna().where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(*[F.min(c).alias(c) for c in columns])
    some = materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", *columns).agg(F.min("text").alias("text"))
    return materialize(found.select("text", *columns), "sample")


def probably_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A test that all values of the only (bigint) column of `keys` pass, and few others: a Bloom filter.

    It keeps rows that can't find a partner out of the shuffle before an exact join. Its size is fixed, so it is safe to
    send everywhere; beyond some ten million keys it lets ever more through, which costs shuffle, not rows.
    """

    def places(key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(FILTER_BITS)) for k in range(2)]

    place = keys.select(F.explode(F.array(*places(F.col(keys.columns[0])))).alias("place"))
    word = place.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place % 64 as int))").alias("bit"))
    found = word.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()

    @F.pandas_udf("boolean")
    def all_set(first: pd.Series, second: pd.Series) -> pd.Series:
        a, b = first.to_numpy(), second.to_numpy()
        return pd.Series((bits[a >> 6] >> (a & 63)) & (bits[b >> 6] >> (b & 63)) & 1 == 1)

    return lambda key: all_set(*places(key))


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node of its component.

    Large-star and small-star rounds in turn: each round links nodes to the least neighbour, so the
    number of rounds grows with the logarithm of a component's diameter. All of it are joins and
    aggregates with map-side combine; each round is written to the shared folder. Only one number a
    round reaches the driver.
    """

    def smallest(e: DataFrame) -> DataFrame:
        return e.groupBy("a").agg(F.min("b").alias("m"))

    cur = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    nodes = cur.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = smallest(both).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), "links")
        low = smallest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b")
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        nxt = materialize(small, "links")
        # A forest of stars stays as it is: every node has one link, and no target has a link of its own.
        a = nxt.select("a")
        done = nxt.count() == a.distinct().count() and nxt.join(a.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        cur = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
