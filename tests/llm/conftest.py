import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    return duckdb.sql(f"SELECT * FROM '{SMALL}/documents.parquet' ORDER BY doc_id").fetchall()


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, node string, size string, id string, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty, blank and very long texts, repeated rows and ids, columns with names used inside."""
    long = " ".join(f"w{i * 7919 % 4001}" for i in range(60_000))
    words = " ".join(f"word{i}" for i in range(60))
    texts = [None, "", "  \n\t ", "one", long, long, words, words, words + " x", "é" * 300, "a" * 5000]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", None, "n", "s", "i", "k") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, "another text under the same id", None, "s1", 1, None, None, None, None)]
    rows += [(None, words, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
