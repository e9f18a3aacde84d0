import os

import duckdb
import pytest

DATA = os.environ.get("KEELSON_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("needs the driver's tables")
    return DATA


@pytest.fixture(scope="session")
def con(data):
    c = duckdb.connect()
    for name in os.listdir(data):
        path = f"{data}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


@pytest.fixture
def tables(tmp_path, spark):
    """Write small tables as Parquet and return their folder."""

    def put(**rows):
        for name, (values, schema) in rows.items():
            spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return put


DOCS = "doc_id long, text string"


@pytest.fixture
def odd_docs():
    """Nulls, empty texts, repeated rows and one very long text."""
    long = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    return [(1, None), (2, ""), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (4, "   \n\t "), (5, long), (6, "é ü 漢字 word"), (None, None)]
