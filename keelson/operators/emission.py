"""Taints that datastore calls emit: a rule table tells for each method which argument holds what, and calls and arguments are joined with it.

Four kinds of stores: a queue's item is the whole message; a cache has a key and a value below a namespace that the key's suffix names; a document store writes documents, asks with filter documents, changes with update documents and
reads into the destination of a cursor; a relational store binds placeholders and reads into a destination.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import input_tasks
from .documents import document_values
from .statements import OPERATIONS, bound_arguments

#: Kind, method, operation, position of the argument (the context is 0), what it is, what its path adds, and whether it is asked with or read into.
RULES = [
    ("Queue", "Push", "write", 1, "item", "", False, False),
    ("Queue", "Pop", "read", 1, "item", "", False, True),
    ("Cache", "Put", "write", 1, "key", ".Key", True, False),
    ("Cache", "Put", "write", 2, "value", ".Value", False, True),
    ("Cache", "Get", "read", 1, "key", ".Key", True, False),
    ("Cache", "Get", "read", 2, "value", ".Value", False, True),
    ("Cache", "Mget", "read_many", 1, "key", ".Key", True, False),
    ("Cache", "Mget", "read_many", 2, "value", ".Value", False, True),
    ("NoSQLDatabase", "InsertOne", "write", 1, "item", "", False, False),
    ("NoSQLDatabase", "InsertMany", "write", 1, "items", "", False, False),
    ("NoSQLDatabase", "FindOne", "read", 1, "filter", "", True, False),
    ("NoSQLDatabase", "FindMany", "read_many", 1, "filter", "", True, False),
    ("NoSQLDatabase", "UpdateOne", "update", 1, "filter", "", True, False),
    ("NoSQLDatabase", "UpdateOne", "update", 2, "change", "", False, False),
    ("NoSQLDatabase", "UpdateMany", "update", 1, "filter", "", True, False),
    ("NoSQLDatabase", "UpdateMany", "update", 2, "change", "", False, False),
    ("NoSQLDatabase", "ReplaceOne", "update", 1, "filter", "", True, False),
    ("NoSQLDatabase", "ReplaceOne", "update", 2, "item", "", False, False),
    ("NoSQLDatabase", "Upsert", "update", 1, "filter", "", True, False),
    ("NoSQLDatabase", "Upsert", "update", 2, "item", "", False, False),
    ("NoSQLDatabase", "DeleteOne", "delete", 1, "filter", "", True, False),
    ("NoSQLDatabase", "DeleteMany", "delete", 1, "filter", "", True, False),
]
_RULE = "kind string, method string, op string, pos int, what string, suffix string, read_key boolean, read_val boolean"
COLUMNS = ("call_id", "id", "objpath", "fieldpath", "op", "read_key", "read_val")
ARGUMENT = "call_id string, pos int, id string, shape string, parts array<string>, suffix string, document string"


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, _RULE)


def cache_namespaces(arguments: DataFrame) -> DataFrame:
    """(call_id, namespace): what follows the colon of a key that is put together of a value and a constant; calls without one are left out."""
    named = arguments.where("pos = 1 AND shape = 'joined' AND suffix IS NOT NULL")
    return named.select("call_id", F.regexp_replace("suffix", "^:", "").alias("namespace")).distinct()


def key_holders(arguments: DataFrame) -> DataFrame:
    """Arguments with the values that really hold them: the first part of a key that is put together with a constant, all parts of one that a call makes, else the argument."""
    one = F.array("id")
    joined = (F.col("shape") == "joined") & F.col("suffix").isNotNull()
    parts = F.when(joined, F.slice("parts", 1, 1)).when((F.col("shape") == "call") & (F.size("parts") > 0), F.col("parts")).otherwise(one)
    return arguments.withColumn("holder", F.explode(F.coalesce(parts, one)))


def _taint(df: DataFrame, holder: str, path: Column, many: Column | None = None) -> DataFrame:
    objpath = F.lit("_obj") if many is None else F.when(many, "_obj[*]").otherwise("_obj")
    return df.select("call_id", F.col(holder).alias("id"), objpath.alias("objpath"), path.alias("fieldpath"), "op", "read_key", "read_val")


def emitted_taints(calls: DataFrame, arguments: DataFrame, cursors: DataFrame | None = None) -> DataFrame:
    """Taints (call_id, id, objpath, fieldpath, op, read_key, read_val) of queue, cache and document calls.

    ``calls`` (call_id, kind, method, db, schema); ``arguments`` (``ARGUMENT``): ``shape`` tells how a cache key is made (``joined``: parts and a constant suffix; ``call``: a call of parts), ``document`` is the JSON of a filter, change or
    projection whose leaves are values.  ``cursors`` (call_id, id): destinations of reads on the cursors of find calls.  What a call reads many of goes to the elements of its value.
    Calls of methods that the rules do not have emit nothing.
    """
    known = calls.join(F.broadcast(rules(calls.sparkSession)), ["kind", "method"])  # one row an argument of a method
    asked = known.withColumnRenamed("suffix", "adds").join(arguments, ["call_id", "pos"])
    place = F.concat_ws(".", "db", "schema")
    many = F.col("op") == "read_many"

    items = asked.where("what IN ('item', 'items')")
    whole = _taint(items, "id", place, F.col("what") == "items")

    cached = asked.where("what IN ('key', 'value')").join(cache_namespaces(arguments), "call_id", "left")
    held = key_holders(cached.where("what = 'key'")).unionByName(cached.where("what = 'value'").withColumn("holder", F.col("id")))
    stored = _taint(held, "holder", F.concat("db", F.lit("."), F.coalesce("namespace", F.lit("*")), "adds"), many)

    documents = asked.where("what IN ('filter', 'change')")
    leaves = document_values(documents).where("value IS NOT NULL").select("document", "field", F.col("value").alias("leaf")).distinct()
    inside = documents.join(leaves, "document")
    found = _taint(inside, "leaf", F.concat(place, F.lit("."), F.regexp_replace("field", r"\[\*\]$", "")))

    out = [whole, stored, found]
    if cursors is not None:
        finds = known.where("what = 'filter' AND op IN ('read', 'read_many')").drop("read_key", "read_val").withColumns({"read_key": F.lit(False), "read_val": F.lit(True)})
        # A find of many with one projected field reads that field, others whole documents.
        projected = document_values(arguments.where("pos = 2 AND document IS NOT NULL")).select("document", "field").distinct()
        single = arguments.where("pos = 2").join(projected, "document").groupBy("call_id").agg(F.min("field").alias("only"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
        read = finds.join(cursors.select("call_id", "id"), "call_id").join(single, "call_id", "left")
        path = F.when(many & F.col("only").isNotNull(), F.concat(place, F.lit("."), F.col("only"))).otherwise(place)
        out.append(_taint(read, "id", path, many))
    return reduce(DataFrame.unionByName, out).distinct()


def relational_taints(calls: DataFrame, arguments: DataFrame, destinations: DataFrame) -> DataFrame:
    """Taints of relational calls (call_id, method, db, statement): bound values hold their columns, the destination of a ``Select`` the first selected one.

    A method reads or executes; what it executes tells whether that writes, updates or deletes.  ``arguments`` (call_id, n, id) and ``destinations`` (call_id, id).
    """
    known = calls.where(F.col("method").isin("Select", "Get", "Exec"))
    bound = bound_arguments(known, arguments, destinations.join(known.where("method = 'Select'").select("call_id"), "call_id", "left_semi"))
    first = F.upper(F.regexp_extract("statement", r"^\s*([A-Za-z]+)", 1))
    op = F.try_element_at(F.create_map(*(F.lit(x) for p in OPERATIONS.items() for x in p)), first)
    of_call = known.select("call_id", "db", F.when(F.col("method") == "Exec", op).otherwise("read").alias("call_op"))
    path = F.concat("db", F.lit("."), F.regexp_replace("path", r"\.\*$", ""))
    read_val = (F.col("pos") == 0)
    tasks = input_tasks(calls.sparkSession)
    return bound.repartition(tasks, "call_id").join(of_call.repartition(tasks, "call_id"), "call_id").select("call_id", "id", F.lit("_obj").alias("objpath"), path.alias("fieldpath"), F.col("call_op").alias("op"), (~read_val).alias("read_key"), read_val.alias("read_val")).distinct()


def seeds(taints: DataFrame, calls: DataFrame) -> DataFrame:
    """Taints of datastore calls as seeds of their functions: (fn, id, objpath, fieldpath, call_id, op, kind); ``calls`` (call_id, fn)."""
    return taints.join(calls.select("call_id", "fn"), "call_id").select("fn", "id", "objpath", "fieldpath", "call_id", "op", F.lit("database").alias("kind"))
