"""Rows with every awkward case, and comparison with DuckDB."""

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="session")
def corpus():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
ROWS = [
    (1, "a short text of some words", "en", "s", 26),
    (2, None, None, None, None),
    (3, "", "en", "s", 0),
    (4, "12 34 \n\n 56", None, "s", 9),
    (None, "a text without an id", "en", None, 20),
    (None, None, "en", "s", None),
    (5, LONG, "en", "s", len(LONG)),
    (6, f"before one {PASSAGE} after one", "en", "s", 9),
    (7, f"before two {PASSAGE} after two", "en", "t", 9),
    (8, "repeated row", "en", "s", 12),
    (8, "repeated row", "en", "s", 12),
    (9, "ein Text mit Größe, ñandú, 日本語 und 😀 ▁ Zeichen", "de", "t", 44),
    (10, "x" * 5000, "fr", "t", 5000),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns with names that operators use inside."""
    df = spark.createDataFrame(ROWS, DOCS)
    extra = "words k1 K2 marks found bucket size rank shard slot kept n_words ids rejected score host fp key vector spans linked lines".split()
    for i, name in enumerate(extra):
        df = df.selectExpr("*", f"{i} AS `{name}`")
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
