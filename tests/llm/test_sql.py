"""Queries that SQL can express give DuckDB's rows."""

import pytest

from keelson.llm import queries


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, data, con, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == theirs


def test_every_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
