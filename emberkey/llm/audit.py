"""How filters interact: what each one removes alone, together, and in every order of applying them.

Five filters judge every text on its own; the fifth, "a document with a smaller id has this very text", is an existential self-join.
A document is then the set of filters it fails, so the corpus is counted by source and set, and every order of the
filters is worked out from at most 32 counts a source.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberkey.llm.common import materialize, probably_in

FILTERS = "ABCDE"
BIT = {name: 1 << k for k, name in enumerate(FILTERS)}
WORD = r"[^\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"
LEAST_WORDS = 200


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, part (the source, empty if null), text (empty if null) and its digest; other columns go."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def own_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as a sum of `BIT`. An empty text fails A only."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    failed = {
        "A": F.size(words) < LEAST_WORDS,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": capitals.cast("long") * 100 > F.length(text).cast("long") * 2,
        "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(f, BIT[name]).otherwise(0) for name, f in failed.items()), F.lit(0))


def repeats(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, digest, part) of the documents whose text a smaller doc_id has too.

    A left-semi join on digest, exact text and smaller id. Its right side is one row for each distinct text, with the
    least id, aggregated before the shuffle, so a text with any number of copies meets one row. Texts whose digest only one id has stay out of
    the shuffle (a Bloom filter, which lets some through and holds none back). Both sides are written tables, so the copies of a
    hot text are plain rows of a sort-merge join, whose large partitions AQE splits.
    """
    shared = facts.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    maybe = probably_in(materialize(shared.select(F.xxhash64("digest").alias("key")), "shared"))
    texts = _texts(docs).where(F.col("doc_id").isNotNull())
    texts = materialize(texts.where(maybe(F.xxhash64("digest"))), "copies")
    least = materialize(texts.groupBy("digest", "text").agg(F.min("doc_id").alias("least")), "texts")
    left, right = texts.alias("l"), least.alias("r")
    smaller = (F.col("l.digest") == F.col("r.digest")) & (F.col("l.text") == F.col("r.text")) & (F.col("r.least") < F.col("l.doc_id"))
    return left.join(right, smaller, "left_semi").select("doc_id", "digest", "part")


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, digest, bits (the failed filters, see `BIT`), n: each document once, n times if the row repeats.

    Rows with one id, text and source share all failures, so they are one row with a count. A row without an id is no copy
    of others, nor they of it.
    """
    facts = _texts(docs).select("doc_id", "part", "digest", own_failures(F.col("text")).alias("bits"), F.lit(1).cast("long").alias("n"))
    facts = materialize(facts, "facts")
    again = repeats(docs, facts).select("doc_id", "part", "digest", F.lit(BIT["E"]).alias("bits"), F.lit(0).cast("long").alias("n"))
    ids = facts.unionByName(again)
    return ids.groupBy("doc_id", "part", "digest").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))


def combinations(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits, n, good, toxic: documents of a source by the filters they fail, and how many of them are labelled so.

    A document is good (toxic) if any label row of its id says 1; nulls say nothing.
    """
    known = labels.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).cast("int").alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int").alias("toxic"),
    )
    known = known.where("label_id is not null and good + toxic > 0").withColumn("spread", F.lit(0).cast("long"))
    # Rows without an id have no label; they are spread over all tasks.
    failed = failed.withColumn("lot", F.when(F.col("doc_id").isNull(), F.xxhash64("digest", "part")).otherwise(0))
    rows = failed.join(known, (F.col("doc_id") == F.col("label_id")) & (F.col("lot") == F.col("spread")), "left")
    return rows.groupBy("part", "bits").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )


def _bits_of(letters: Column) -> Column:
    return sum((F.when(F.instr(letters, name) > 0, bit).otherwise(0) for name, bit in BIT.items()), F.lit(0))


def orders(counts: DataFrame) -> DataFrame:
    """What every filter of every order keeps and removes, from `combinations`.

    A source is one row with at most 32 counts; its 600 steps are made in place, without a shuffle.
    """
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("sets"))
    every = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    rows = sets.select("part", "sets", F.explode(every).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    here, earlier = _bits_of(F.expr("substring(filter_order, step, 1)")), _bits_of(F.expr("substring(filter_order, 1, step - 1)"))
    rows = rows.withColumn("here", here).withColumn("earlier", earlier)

    def total(which, what=lambda s: s["n"]) -> Column:
        return F.aggregate(F.filter("sets", which), F.lit(0).cast("long"), lambda a, s: a + what(s))

    fails = lambda s: s["bits"].bitwiseAND(F.col("here")) != 0
    gone = lambda s: s["bits"].bitwiseAND(F.col("earlier")) != 0
    removed = lambda s: fails(s) & ~gone(s)
    # Of the orders, an equal share has a given one of a document's failed filters first.
    first_in = lambda s: s["n"] * (F.lit(120) / F.bit_count(s["bits"])).cast("long")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda s: ~fails(s) & ~gone(s)).alias("kept"),
        total(removed).alias("removed"),
        total(lambda s: fails(s) & gone(s)).alias("redundant"),
        total(lambda s: s["bits"] == F.col("here")).alias("unique_fails"),
        total(removed, lambda s: s["good"]).alias("good_lost"),
        total(removed, lambda s: s["toxic"]).alias("toxic_lost"),
        total(fails, first_in).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row for each source, order of the five filters and step. A null text is an empty one, a null source the empty string, which it
    is counted with. Repeated rows count each; an empty table gives no rows; other columns are ignored.
    """
    return orders(combinations(failures(docs), labels))


def sql() -> str:
    """DuckDB SQL for the same rows."""
    every = ", ".join(f"('{''.join(p)}')" for p in permutations(FILTERS))
    bits = lambda letters: " + ".join(f"CASE WHEN contains({letters}, '{n}') THEN {b} ELSE 0 END" for n, b in BIT.items())
    return f"""WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
  regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(words) < {LEAST_WORDS} THEN 1 ELSE 0 END
  + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(text, '{SYMBOLS}') THEN 8 ELSE 0 END
  + CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) THEN 16 ELSE 0 END AS bits FROM t),
l AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, bits, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, bits),
o AS (SELECT filter_order, step::INTEGER AS step, {bits("filter_order[step]")} AS here, {bits("filter_order[1:step - 1]")} AS earlier
  FROM (VALUES {every}) AS v(filter_order), range(1, 6) AS s(step))
SELECT part, filter_order, step, coalesce(sum(n) FILTER (bits & (here | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (bits & here <> 0 AND bits & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (bits & here <> 0 AND bits & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (bits = here), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (bits & here <> 0 AND bits & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (bits & here <> 0 AND bits & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(bits), 1)) FILTER (bits & here <> 0), 0)::BIGINT AS shapley
FROM c, o GROUP BY part, filter_order, step, here, earlier"""
