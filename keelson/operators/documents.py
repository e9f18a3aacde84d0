"""Filter, update and projection documents of a NoSQL store: the fields they name and the values that stand there, level by level over Spark's VARIANT type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import input_tasks, stage

#: Operators of documents that are no field names and carry nothing.
IGNORED = ("$each", "$position", "$addToSet")
#: Operators below a field whose list holds values of it.
MEMBERS = ("$in", "$nin", "$all")


def _is(kind: str, value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit(kind))


def document_values(documents: DataFrame, document: str = "document") -> DataFrame:
    """(document, field, value, order) for each distinct JSON document.

    ``$and``, ``$or`` and update operators are walked through; below a field, lists of membership operators give its elements (``field[*]``), other operators what they hold, and a plain nested key
    stands for its outer field; ``IGNORED`` operators carry nothing.  ``value`` is the leaf as text, null for an empty document.  A text that is no JSON has no rows.
    """
    spark = documents.sparkSession
    # Dealt by number: the planner would join tasks by their compressed size, and equal texts compress well.
    texts = documents.select(F.col(f"`{document}`").alias("document")).where("document IS NOT NULL").repartition(input_tasks(spark), "document").distinct()
    front = stage(texts.select("document", F.lit(None).cast("string").alias("field"), F.lit("").alias("mark"), F.array().cast("array<int>").alias("order"), F.try_parse_json("document").alias("v")).where("v IS NOT NULL"), "documents")
    leaves = []
    while True:
        inner = front.where(_is("OBJECT", F.col("v")) | _is("ARRAY", F.col("v")))
        opened = inner.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        key, value, field = F.col("key"), F.col("value"), F.col("field")
        is_operator = F.coalesce(F.startswith(key, F.lit("$")), F.lit(False))
        member = is_operator & field.isNotNull() & key.isin(*MEMBERS) & F.coalesce(_is("ARRAY", value), F.lit(False))
        nothing = key.isNull() & value.isNull()  # an empty object or list
        named = F.when(field.isNotNull() | is_operator | key.isNull(), field).otherwise(key)
        nxt = opened.where(~F.coalesce(key.isin(*IGNORED), F.lit(False)) & ~(nothing & field.isNull())).select(
            "document", named.alias("field"), F.when(member, "[*]").otherwise(F.col("mark")).alias("mark"), F.concat("order", F.array(F.coalesce("pos", F.lit(0)))).alias("order"), value.alias("v"),
        )
        level = stage(nxt, "documents")
        done = F.col("v").isNull() | ~(_is("OBJECT", F.col("v")) | _is("ARRAY", F.col("v")))
        leaves.append(level.where(done & F.col("field").isNotNull()).select("document", F.concat("field", "mark").alias("field"), F.try_variant_get("v", "$", "string").alias("value"), "order"))
        front = level.where(~done)
        if front.isEmpty():
            return reduce(DataFrame.unionByName, leaves)


def with_fields(rows: DataFrame, document: str, name: str = "fields") -> DataFrame:
    """``rows`` with the distinct fields of their document, in the order of its keys; an empty array if it has none."""
    tasks = input_tasks(rows.sparkSession)
    values = document_values(rows, document).select(F.col("document").alias("_document"), "field", "order").repartition(tasks, "_document")
    found = values.groupBy("_document", "field").agg(F.min("order").alias("order"))
    fields = found.groupBy("_document").agg(F.array_sort(F.collect_list(F.struct("order", "field")))["field"].alias("_fields"))
    joined = rows.repartition(tasks, F.col(f"`{document}`")).join(fields, F.col(f"`{document}`") == F.col("_document"), "left").drop("_document")
    return joined.withColumn(name, F.coalesce("_fields", F.array().cast("array<string>"))).drop("_fields")
