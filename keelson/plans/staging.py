"""Shared-folder staging: how long plans are cut, and how the package reaches the workers.

Every multi-step operator materialises its intermediate tables as Parquet in the
folder named by ``spark.checkpoint.dir``, which the driver and all executors share.
A lost executor then costs the tasks it was running, never the rows it had produced.
Files for the workers (the package, lists) go through the same folder, and the application's part of it is deleted when the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import io
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
#: Folders that are deleted when the driver ends.
_ROOTS: set[str] = set()
#: Bytes that go to a file of the shared folder at once.
_CHUNK = 4 << 20


def scratch_root(spark: SparkSession) -> str:
    """Shared scratch folder of this application, as a URI or path that Spark can open.

    ``spark.checkpoint.dir`` wins.  Only a session on a ``local`` master (tests) may fall
    back on a temporary folder; on a cluster an unset folder is an error, because a
    machine-local one would lose rows.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="keelson-scratch-")
        atexit.register(shutil.rmtree, root, True)
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/keelson-{spark.sparkContext.applicationId}"
    if path not in _ROOTS:
        _ROOTS.add(path)
        atexit.register(_delete, spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Drops the shuffle files of a write as soon as it is done: what was written makes them useless.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._keelson_path = path
    return out


def stage_bucketed(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Write ``df``, which was ``dealt_by`` these keys, to ``path`` in buckets by them, one file each; returns a scan of what was written."""
    spark = df.sparkSession
    entry = _entry()
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.format("parquet").option("path", path).bucketBy(_buckets(spark), *keys).saveAsTable(entry)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        spark.sql(f"DROP TABLE IF EXISTS {entry}")
    out = spark.read.schema(df.schema).parquet(path)
    out._keelson_path = path
    return out


def bucketed_keys(staged: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """The keys of all that ``stage_bucketed`` wrote to folders below ``path``, with the columns of ``staged``: a join on them with rows that are ``dealt_by`` them reads the buckets where they lie.

    Only a table can tell Spark its buckets; the catalog forgets it as soon as its scan is resolved.
    """
    spark, entry = staged.sparkSession, _entry()
    name = lambda c: f"`{c.replace('`', '``')}`"
    columns = ", ".join(f"{name(k)} {staged.schema[k].dataType.simpleString()}" for k in keys)
    folder = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet OPTIONS (recursiveFileLookup 'true') CLUSTERED BY ({', '.join(map(name, keys))}) INTO {_buckets(spark)} BUCKETS LOCATION '{folder}'")
    try:
        return spark.table(entry)
    finally:
        spark.sql(f"DROP TABLE {entry}")


def dealt_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` dealt out by ``keys`` as the buckets of staged tables are."""
    return df.repartition(_buckets(df.sparkSession), *keys)


def _entry() -> str:
    """A new name for the catalog."""
    return f"keelson_{uuid.uuid4().hex}"


def _buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for table in tables:
        if path := getattr(table, "_keelson_path", None):
            delete_path(table.sparkSession, path)


def _delete(jvm, conf, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    with contextlib.suppress(Exception):
        target.getFileSystem(conf).delete(target, True)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` recursively through Hadoop's file system layer."""
    _delete(spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), path)


def write_file(spark: SparkSession, path: str, parts: Iterable[bytes]) -> None:
    """Write ``parts`` one after the other to the file ``path`` through Hadoop's file system layer."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        for part in parts:
            for i in range(0, len(part), _CHUNK):
                out.write(bytes(part[i : i + _CHUNK]))
    finally:
        out.close()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    target = f"{scratch_path(spark, 'package')}/{top.name}_src.zip"
    write_file(spark, target, [packed.getvalue()])
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def input_tasks(spark: SparkSession) -> int:
    """Number of tasks that a repartitioning for Python work should aim at."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
