"""Operators 11 to 13 against brute force, and on odd input."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers

from emberkey.llm import audit, centroids, packing, queries

SMALL = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD_ROWS = 16


@pytest.fixture(scope="module")
def plain():
    """The tokenizer by itself."""
    tokenizer = tokenizers.Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(JSON, encoding="utf-8") as file:
        return packing.Encoder(file.read())


def ids_of(raw):
    return np.frombuffer(raw, dtype="<u4").tolist()


# ---- packing ----------------------------------------------------------------------------------------


def best_fit_decreasing(counts, capacity):
    """Item by item; how many bins are filled how far. Bins with equal room are alike, so any of them may take an item."""
    bins = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fit = [b for b in bins if capacity - sum(b) >= length]
            if fit:
                max(fit, key=sum).append(length)
            else:
                bins.append([length])
    return Counter(sum(b) for b in bins)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 16, 31, 64])
    counts = Counter(rng.choice([rng.randint(1, capacity), rng.randint(1, max(1, capacity // 6))]) for _ in range(rng.randint(0, 250)))
    bins = defaultdict(list)
    seen = Counter()
    for length, first, rows, per_bin, sequence, offset in packing.plan(counts, capacity).tolist():
        assert first == seen[length]
        seen[length] += rows
        for i in range(rows):
            bins[sequence + i // per_bin].append((offset + i % per_bin * length, length))
    assert seen == counts
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1]
        assert sum(n for _, n in held) <= capacity
    assert Counter(sum(n for _, n in held) for held in bins.values()) == best_fit_decreasing(counts, capacity)


def test_the_plan_does_not_grow_with_the_counts():
    rng = np.random.default_rng(1)
    small = {n: int(c) for n, c in enumerate(rng.integers(0, 50, 2049)) if n}
    large = {n: c * 1_000_003 for n, c in small.items()}
    bound = 2048 * (1 + 3 * 11)
    assert len(packing.plan(small, 2048)) < bound and len(packing.plan(large, 2048)) < bound
    with pytest.raises(ValueError, match="does not fit"):
        packing.plan({9: 1}, 8)


def test_tightest_bin():
    bins = packing.OpenBins(100)
    assert bins.tightest(1) is None
    for remaining in (100, 40, 41, 7):
        bins.add(remaining, remaining, 1)
    assert [bins.tightest(n) for n in (1, 7, 8, 40, 41, 42, 100)] == [7, 7, 40, 40, 41, 100, 100]
    bins.take(100)
    assert bins.tightest(42) is None and bins.tightest(0) == 7


def test_ids_equal_the_tokenizer(documents, encoder, plain):
    for text in [r[1] for r in documents] + ["", " ", "\n\n a  b\t", "<|endoftext|> x", "it's I'll 12a", "a" * 3000]:
        assert ids_of(encoder.encode([text])[0]) == plain(text)
    for at in [*range(0x3100), *range(0xD7A0, 0xD800), *range(0xFDF0, 0x10100), *range(0x1F300, 0x1F700)]:
        text = f"a{chr(at)} b{chr(at)}{chr(at)}c 1{chr(at)}"
        assert ids_of(encoder.encode([text])[0]) == plain(text), hex(at)
        assert packing.split(text) == regex.findall(public_tokenizers.PATTERN, text), hex(at)


def test_parts_of_long_texts_keep_the_ids(encoder, plain):
    rng = random.Random(3)
    text = "".join(rng.choice(["word", " ", "  ", "\n", "é", "'s", "12", "!?", " x"]) for _ in range(4000))
    cut = packing.parts(text, 100)
    assert len(cut) > 20 and "".join(cut) == text
    assert [i for p in cut for i in plain(p)] == plain(text)
    assert packing.parts("x" * 500, 100) == ["x" * 500]
    assert [ids_of(i) for i in encoder.encode([text, "", text[:50]])] == [plain(text), [], plain(text[:50])]


def check_packing(rows, texts, plain, capacity=2048):
    """rows: (doc_id, piece, start, length, crc, sequence, offset); texts: doc_id -> how often each text stands there."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r[0]].append(r[1:5])
        by_sequence[r[5]].append((r[6], r[3]))
    want = defaultdict(list)
    for doc_id, text in texts:
        ids = plain(text or "") + [0]
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
            want[doc_id].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}
    for held in by_sequence.values():
        held.sort()
        assert [o for o, _ in held] == [0, *itertools.accumulate(n for _, n in held)][:-1] and sum(n for _, n in held) <= capacity
    return len(by_sequence)


def test_packing_query(spark, documents, plain):
    got = queries.QUERIES["op11_packing"](spark, SMALL)
    rows = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")) for r in got.collect()]
    used = check_packing(rows, [(r[0], r[1]) for r in documents], plain)
    assert used == sum(best_fit_decreasing(Counter(r[3] for r in rows), 2048).values())
    assert used <= 1.02 * math.ceil(sum(r[3] for r in rows) / 2048) + 1


def test_packing_odd_input(spark, odd, none, plain):
    packed = packing.pack_documents(odd, JSON, 64)
    rows = [(r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(r["ids"]), r["sequence_id"], r["offset"]) for r in packed.collect()]
    check_packing(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], plain, 64)
    assert packing.pack_documents(none, JSON).count() == 0
    whole = {r["sequence_id"]: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]]["ids"][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert all(4 * r["length"] == len(r["ids"]) <= 4 * 64 for r in whole.values())


def test_place_takes_any_rows(spark):
    rows = spark.range(1000).selectExpr("id", "cast(id % 7 + 1 as int) AS length", "'x' AS part", "array(id) AS extra").repartition(5)
    got = packing.place(rows, 10).collect()
    assert sorted(r["id"] for r in got) == list(range(1000)) and all(r["extra"] == [r["id"]] and r["length"] == r["id"] % 7 + 1 for r in got)
    spans = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    assert all(a[1] + a[2] == b[1] if a[0] == b[0] else b[1] == 0 for a, b in itertools.pairwise(spans))
    with pytest.raises(Exception, match="lengths must be"):
        packing.place(spark.range(1).selectExpr("11 AS length"), 10).count()
    with pytest.raises(Exception, match="lengths must be"):
        packing.place(spark.range(1).selectExpr("cast(null as int) AS length"), 10).count()
    with pytest.raises(ValueError, match="offset"):
        packing.place(spark.range(1).selectExpr("1 AS length", "2 AS offset"), 10)


# ---- centroids --------------------------------------------------------------------------------------

VECTOR = "vec_id bigint, embedding array<double>, cluster string, v int"


def brute_clusters(rows, dims=64, k=16, rounds=3):
    """Plain whole numbers of any size."""
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    lot = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    middle = [v for _, v in sorted(kept, key=lambda r: (lot(r[0]), r[1]))[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min(range(len(middle)), key=lambda c: (apart(v, middle[c]), c))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in kept:
            groups[nearest(v)].append(v)
        middle = [[sum(x) // len(groups[c]) for x in zip(*groups[c])] if groups[c] else m for c, m in enumerate(middle)]
    out = [(i, nearest(v), v) for i, v in kept]
    spread = Counter()
    for _, c, v in out:
        spread[c] += apart(v, middle[c])
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middle]
    return sorted(((i, c, apart(v, middle[c]), spread[c], sum(spread.values()), digest[c]) for i, c, v in out), key=repr)


def clusters(df):
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=repr)


def test_centroids_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SMALL}/embeddings.parquet'").fetchall()
    assert clusters(queries.QUERIES["op12_centroids"](spark, SMALL)) == brute_clusters(rows)


def test_centroids_ties_and_odd_vectors(spark):
    rng = random.Random(5)
    nan, inf = float("nan"), float("inf")
    flat = lambda *head: [*head, *[0.0] * (64 - len(head))]
    rows = [(i, flat(rng.choice([0.0, 0.015625, -0.015625, 0.03125]), rng.choice([0.0, 0.015625]))) for i in range(120)]
    rows += [(None, flat(0.5)), (7, flat(0.25)), (7, flat(0.25)), (200, flat(2_000_000.0)), (201, flat(-2_000_000.0, -0.001))]
    skipped = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, flat(None)), (305, flat(nan)), (306, flat(inf)), (307, flat(-inf))]
    huge = [(308, flat(1e300)), (309, flat(-3e6))]
    table = spark.createDataFrame([(*r, "c", 1) for r in rows + skipped + huge], VECTOR).repartition(4)
    want = brute_clusters(rows + skipped)
    assert clusters(centroids.cluster_vectors(table)) == want
    assert len({r[1] for r in want}) > 4


def test_few_and_no_vectors(spark):
    few = [(i, [float(i)] * 64) for i in range(3)]
    assert clusters(centroids.cluster_vectors(spark.createDataFrame(few, "vec_id bigint, embedding array<float>"))) == brute_clusters(few)
    empty = centroids.cluster_vectors(spark.createDataFrame([], VECTOR))
    assert empty.count() == 0 and empty.columns[:3] == ["vec_id", "cluster", "distance"]


def test_tournament_equals_all_distances():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-3, 4, (3000, 5)), rng.integers(-3, 4, (9, 5))
    c[4] = c[1]  # equal centroids: the smaller number
    all_distances = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (centroids.tournament(x, *centroids.bisectors(c)) == all_distances.argmin(axis=1)).all()
    edge = np.full((2, 64), 1 << 27)
    edge[1] *= -1
    assert centroids.tournament(edge, *centroids.bisectors(np.array([edge[1], edge[0]]))).tolist() == [1, 0]


# ---- filter audit -----------------------------------------------------------------------------------


def brute_audit(docs, labels):
    """docs: (doc_id, text, source); every order applied one filter after the other."""
    texts = [(i, t or "", s or "") for i, t, s in docs]
    low = {}
    for i, t, _ in texts:
        if i is not None:
            low[t] = min(i, low.get(t, i))
    failed = []
    for i, t, s in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out = {"A"} if len(words) < 200 else set()
        out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        out |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t) else set()
        out |= {"D"} if re.search("[#$%&*|]", t) else set()
        out |= {"E"} if i is not None and low[t] < i else set()
        failed.append((s, out, {c for k, c in ((1, "good"), (2, "toxic")) if any(r[0] == i and i is not None and r[k] == 1 for r in labels)}))
    out = []
    for part in {s for _, _, s in texts}:
        here = [(f, lab) for s, f, lab in failed if s == part]
        rows, share = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = here
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                kept = [x for x in left if name not in x[0]]
                redundant = sum(name in f for f, _ in here) - len(gone)
                alone = sum(f == {name} for f, _ in here)
                good, toxic = (sum(c in lab for _, lab in gone) for c in ("good", "toxic"))
                rows.append((part, order, step, len(kept), len(gone), redundant, alone, good, toxic))
                share[name] += len(gone)
                left = kept
        out += [(*r, share[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def audited(df):
    return sorted(tuple(r[c] for c in ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect())


def test_audit_query(spark, documents):
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SMALL}/labels.parquet'").fetchall()
    assert audited(queries.QUERIES["op13_filter_audit"](spark, SMALL)) == brute_audit([(r[0], r[1], r[3]) for r in documents], labels)


def test_audit_odd_input(spark, odd, none):
    labels = [(5, 1, 0), (5, 0, 1), (6, None, 1), (6, 1, None), (None, 1, 1), (99, 1, 1), (0, 1, 1)]
    table = spark.createDataFrame([(*r, "part") for r in labels], "doc_id bigint, quality int, toxic int, bits string")
    more = [(20 + k, t, "en", s, 1, "n", "s", "i", "k") for k, t in enumerate(["same"] * 40 + ["A# b" * 300, "x " * 400]) for s in ("", "big")]
    docs = odd.unionByName(spark.createDataFrame(more, odd.schema)).withColumnRenamed("node", "bits").withColumnRenamed("size", "part").withColumnRenamed("key", "digest")
    want = brute_audit([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()], labels)
    assert audited(audit.audit(docs, table)) == want
    assert audit.audit(none, table).count() == 0
    assert len(audited(audit.audit(docs, table.limit(0)))) == len(want)


def test_a_text_with_many_copies_meets_one_row(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'the same text' AS text", "cast(id % 3 as string) AS source")
    failed = {r["doc_id"]: r["bits"] for r in audit.failures(docs).collect()}
    assert failed[0] == audit.BIT["A"] and all(failed[i] == audit.BIT["A"] | audit.BIT["E"] for i in range(1, 3000))
