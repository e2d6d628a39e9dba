import duckdb
import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, keep_id int, _key string, _t string, shard string"
LONG = ("alpha beta " * 30_000) + "omega"


def rows_of(texts, langs=None):
    return [(i, t, (langs or {}).get(i), "s", None, "x", 1, None, "y", "z") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, ties, and column names that operators use inside."""
    texts = ["Hello  World", "Hello\nWorld", None, "", " \t\n", "hello world", "a", LONG, LONG.replace(" ", "  "),
             "héllo wörld 中文 🎉", "x" * 40_000, "one\ntwo\n\n" + "l" * 25 + "\n", "1 2 3 | 4", "Hello World"]
    rows = rows_of(texts)
    extra = [(None, "Hello World", None, None, None, None, None, None, None, None),
             (None, None, None, None, None, None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows + extra, COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, langs=None: spark.createDataFrame(rows_of(texts, langs), COLUMNS)


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/sf0.01/{t}.parquet')")
    return c
