import os
import re

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Columns that clash with names that operators use inside or give back.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, n_words long, score double, class long, keys string, takes string, h long, y int"


@pytest.fixture
def sf():
    return SF


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows and repeated ids, clashing columns."""
    long = " ".join(f"word{i % 977} and, others!" for i in range(40_000))
    texts = [
        (1, "Plain words in a row, nothing more to see here. " * 3), (2, None), (3, ""), (4, " \t\n "), (5, long), (6, "x" * 50_000), (None, "no id here at all"), (None, None),
        (1, "Plain words in a row, nothing more to see here. " * 3), (1, "another text under the same id"), (7, "漢字 かな é à 🙂 ##!! <|endoftext|> A*b"), (8, "line\nline\nline\n\nline"), (9, "a b"), (10, "A B"),
    ]
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None, None, 5, None, 1, "k", None, 3, None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("1 = 0")


@pytest.fixture(scope="session")
def plain():
    """Rows as sorted tuples, floats rounded."""

    def of(df, *columns):
        rows = (df.select(*columns) if columns else df).collect()
        value = lambda x: round(x, 9) if isinstance(x, float) else x
        return sorted((tuple(map(value, r)) for r in rows), key=lambda t: tuple((x is None, str(type(x)), x if not isinstance(x, list) else str(x)) for x in t))

    return of


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}{'/*.parquet' if os.path.isdir(f'{SF}/{f}') else ''}'")
    return con
