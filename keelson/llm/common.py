"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ..plans.staging import ship_package

#: Rows that one Arrow batch may carry to a Python worker; with long texts the byte limit below binds first.
BATCH_ROWS = 2_000
#: Bytes that one Arrow batch may carry.
BATCH_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name; the folder may be any path that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with bounded batches and with this package on the workers' path.

    The two limits stay set in the session: a plan reads them when it runs, which is after this returns.  They bound batches and change no result.
    """
    spark = df.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if all(re.fullmatch(r"\w+", c) for c in df.columns):
        return df.mapInArrow(f, schema)
    # mapInArrow resolves columns by their names as expressions: odd ones travel under their positions, and ``f`` sees their own.
    schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    own, out = df.columns, [f"c{i}" for i in range(len(schema))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in f(pa.RecordBatch.from_arrays(x.columns, names=own) for x in batches):
            yield pa.RecordBatch.from_arrays(b.columns, names=out)

    moved = df.toDF(*(f"c{i}" for i in range(len(own)))).mapInArrow(run, StructType([StructField(n, x.dataType, x.nullable) for n, x in zip(out, schema, strict=True)]))
    return moved.toDF(*schema.names)


def arrow_extend(df: DataFrame, f: Callable[[pa.RecordBatch], list[pa.Array]], added: list[StructField]) -> DataFrame:
    """``df`` with the columns that ``f`` makes of each batch.

    Columns travel under their positions, so they may have any names: dots, backticks, names that differ only in case.
    """
    n = len(df.columns)
    names = [f"c{i}" for i in range(n + len(added))]
    schema = StructType([*(StructField(names[i], x.dataType) for i, x in enumerate(df.schema)), *(StructField(names[n + i], x.dataType) for i, x in enumerate(added))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, *f(b)], names=names)

    return arrow_map(df.toDF(*names[:n]), run, schema).toDF(*df.columns, *(x.name for x in added))


def utf8_values(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def quoted(name: str) -> str:
    """A column's name as an expression: dots and backticks in it are taken as they are."""
    return "`" + name.replace("`", "``") + "`"


def fresh_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, or the first of ``wanted_2``, ``wanted_3`` ... that no column in ``taken`` has (ignoring case)."""
    low, k, name = {t.lower() for t in taken}, 2, wanted
    while name.lower() in low:
        name, k = f"{wanted}_{k}", k + 1
    return name


def one_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of ``schema`` from numpy arrays, lists or Arrow arrays given by name."""
    arrays = [c if isinstance(c := columns[f.name], (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for f in schema]
    return pa.RecordBatch.from_arrays([a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays], schema=schema)
