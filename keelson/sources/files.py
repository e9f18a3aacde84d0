"""Small declarative inputs: JSON schemas, reference lists, struct tags, suppressions, the app registry, earlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.names import bson_name
from ..plans.config import AnalysisConfig
from ..plans.facts import SCHEMAS

JSON_SCHEMA = "`$jsonSchema` struct<database:string,collection:string,uniqueItems:array<string>,properties:map<string,string>>"
_REFERENCE = r"^\s*FOREIGN_KEY\s+(\S+\.\S+\.\S+)\s+REFERENCES\s+(\S+\.\S+\.\S+)\s*$"


def keys_from_json_schema(spark: SparkSession, path: str, config: AnalysisConfig = AnalysisConfig(), app: str = "app") -> DataFrame:
    """UNIQUE constraints (PRIMARY by flag) from ``uniqueItems``."""
    s = F.col("`$jsonSchema`")
    rows = spark.read.schema(JSON_SCHEMA).json(path, multiLine=True).select(s["database"].alias("db"), s["collection"].alias("c"), F.explode(s["uniqueItems"]).alias("f"))
    full, kind = F.concat_ws(".", "db", "c", "f"), F.lit("PRIMARY" if config.nosql_indexes_as_primary_keys else "UNIQUE")
    return rows.select(F.lit(app).alias("app"), F.concat(kind, F.lit(":"), full).alias("cid"), kind.alias("type"), F.array(full).alias("fields"), F.lit(False).alias("transitive"))


def references_from_lines(lines: DataFrame, app: str = "app") -> DataFrame:
    """Foreign keys from lines ``FOREIGN_KEY a.b.c REFERENCES d.e.f``; other lines are left out."""
    v = F.col("value")
    pair = F.array(F.regexp_extract(v, _REFERENCE, 1), F.regexp_extract(v, _REFERENCE, 2))
    return lines.where(F.rlike(v, F.lit(_REFERENCE))).select(F.lit(app).alias("app"), F.concat(F.lit("FOREIGN_KEY:"), F.array_join(pair, ",")).alias("cid"), F.lit("FOREIGN_KEY").alias("type"), pair.alias("fields"), F.lit(False).alias("transitive"))


def primary_keys_from_tags(tags: DataFrame) -> DataFrame:
    """(db, collection, alias, path) of fields (db, collection, field, tag) whose tag names ``_id``: primary key and alias of the field's own name."""
    named = tags.withColumn("name", bson_name(F.col("tag")))
    return named.where("name = '_id'").select("db", "collection", F.concat_ws(".", "db", "collection", "field").alias("alias"), F.concat_ws(".", "db", "collection", "name").alias("path"))


def mapping_items(texts: DataFrame) -> DataFrame:
    """(file, item, pos, key, value) of files (file, value: the whole text) in the part of YAML that the inputs use: top-level scalars (item 0), and lists of flat mappings (items from 1).

    Texts are cut into lines and each line is read by itself; a running count of dashes numbers the items of a file.  Comments, quotes around values and lines that are no ``key: value`` are left out.
    """
    lines = texts.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    body = F.regexp_replace("line", r"(^|\s)#.*$", "")
    cut = lines.withColumns({"body": F.rtrim(body), "dash": F.rlike(body, F.lit(r"^\s*-(\s|$)")).cast("int")}).where("body <> ''")
    numbered = cut.withColumn("item", F.sum("dash").over(Window.partitionBy("file").orderBy("pos")).cast("int"))
    pair = r"^(\s*(?:-\s+)?)([^\s:][^:]*?)\s*:(?:\s+(.*))?$"
    found = numbered.where(F.rlike("body", F.lit(pair))).select("file", "item", "pos", F.regexp_extract("body", pair, 2).alias("key"), F.regexp_replace(F.regexp_extract("body", pair, 3), r"^[\"'](.*)[\"']$", "$1").alias("value"), (F.regexp_extract("body", pair, 1) == "").alias("is_top"))
    return found.select("file", F.when(F.col("is_top"), 0).otherwise(F.col("item")).alias("item"), "pos", "key", "value").where("value <> ''")


def _wide(items: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """One row (file, item, a column a key) for each item."""
    return items.where("item > 0").groupBy("file", "item").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in keys))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")


def suppressions(texts: DataFrame, app: str | None = None) -> DataFrame:
    """``ignore_cascade`` facts of files (file, value), each of the application that it names; a trigger needs database and entity.  With ``app`` a file of another application is an error."""
    items = mapping_items(texts)
    apps = items.where("item = 0 AND key = 'app'").select("file", F.col("value").alias("app"))
    if app is not None and (other := apps.where(F.col("app") != app).first()):
        raise ValueError(f"suppressions are for {other['app']}, not for {app}")
    rows = _wide(items, ("database", "entity", "trigger_database", "trigger_entity")).join(apps, "file")
    whole = F.col("trigger_database").isNotNull() & F.col("trigger_entity").isNotNull()
    return rows.select("app", F.col("database").alias("db"), "entity", F.when(whole, F.col("trigger_database")).alias("trigger_db"), F.when(whole, F.col("trigger_entity")).alias("trigger_entity"))


def app_registry(texts: DataFrame) -> DataFrame:
    """Applications of registry files (file, value), one row each."""
    columns = ("name", "app_root", "package_path", "spec_name", "spec_path", "sql_tables", "nosql_path")
    return _wide(mapping_items(texts), columns).select(*columns)


def previous_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an earlier report."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def changed_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """(status, line): what a new report adds, drops and keeps, with multiplicity.

    Lines are counted on both sides at once: each report is read once, and each line is dealt out once.
    """
    side = lambda df, n_old, n_new: df.select("line", F.lit(n_old).cast("long").alias("n_old"), F.lit(n_new).cast("long").alias("n_new"))
    counted = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy("line").agg(F.sum("n_old").alias("n_old"), F.sum("n_new").alias("n_new"))
    times = (("added", F.col("n_new") - F.col("n_old")), ("removed", F.col("n_old") - F.col("n_new")), ("unmodified", F.least("n_new", "n_old")))
    each = counted.select("line", F.inline(F.array(*(F.struct(F.lit(s).alias("status"), n.cast("int").alias("n")) for s, n in times)))).where("n > 0")
    return each.select("status", "line", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_copy")).select("status", "line")


def as_facts(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a fact table: the columns of its declared schema, by name and type; missing ones are null."""
    declared = StructType.fromDDL(SCHEMAS[name])
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared))


def read_facts(spark: SparkSession, folder: str, name: str, kind: str = "parquet") -> DataFrame:
    """A fact table from Parquet or JSON lines, with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).format(kind).load(f"{folder}/{name}.{kind}")
