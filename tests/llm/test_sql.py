"""Queries against their SQL, and the contract of all of them: one row a document, whole and repeatable."""

import pytest

from twinsieve.llm import queries as q

SQL = q.oracle_sql()


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, duck, sf, plain, name):
    got = q.queries()[name](spark, sf)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    theirs = sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want.fetchall()), key=lambda t: tuple((x is None, str(type(x)), x) for x in t))
    assert plain(got, *names) == theirs


def test_names():
    assert [n.split("_")[0] for n in q.queries()] == [f"op{i}" for i in range(1, 14)] + ["pipeline"]
