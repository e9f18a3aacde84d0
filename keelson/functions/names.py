"""Names of functions, calls, operations and constraints as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATIONS = ("undefined", "write", "update", "read", "read_many", "delete")


def short_function_path(p: Column) -> Column:
    """``(*host/x/workflow/app.FooServiceImpl).Bar`` becomes ``app.FooService.Bar``."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^\(\*", ""), r"^.*workflow/", ""), r"\)", "")
    parts = F.split(bare, r"\.")
    second = F.regexp_replace(F.try_element_at(parts, F.lit(2)), "Impl$", "")
    return F.when(F.size(parts) == 3, F.concat_ws(".", F.element_at(parts, 1), second, F.element_at(parts, 3))).otherwise(bare)


def service_of(short: Column) -> Column:
    parts = F.split(short, r"\.")
    return F.when(F.size(parts) == 3, F.try_element_at(parts, F.lit(2)))


def method_of(short: Column) -> Column:
    return F.element_at(F.split(short, r"\."), -1)


def bson_name(tag: Column) -> Column:
    """Name in a ``bson`` struct tag without options; null if there is no such tag."""
    found = F.regexp_extract(tag, r'bson:"([^",]*)', 1)
    return F.when(found != "", found)


def operation_label(op: Column) -> Column:
    """Both kinds of read are called read."""
    return F.when(op == "read_many", F.lit("read")).otherwise(op)


def is_read(op: Column) -> Column:
    return op.isin("R", "RM", "read", "read_many")


def is_write(op: Column) -> Column:
    return op.isin("W", "write")


def is_write_or_update(op: Column) -> Column:
    return op.isin("W", "U", "write", "update")


def is_update(op: Column) -> Column:
    return op.isin("U", "update")


def is_delete(op: Column) -> Column:
    return op.isin("D", "delete")


def edge_number(edge_id: Column) -> Column:
    """Number after ``.t`` at the end of an edge id, -1 if there is none."""
    return F.coalesce(F.try_element_at(F.split(edge_id, r"\.t"), F.lit(2)).try_cast("int"), F.lit(-1))


def call_id(service: Column, method: Column, number: Column) -> Column:
    return F.concat(service, F.lit("."), method, F.lit(".t"), number.cast("string"))


def instruction_id(*parts: Column) -> Column:
    """A repeatable id for an instruction without a position: ``i`` and the MD5 digest of its parts."""
    return F.concat(F.lit("i"), F.md5(F.concat_ws("|", *parts).cast("binary")))


def strip_client(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def string_literal(x: Column) -> Column:
    return F.regexp_replace(x, '^"|"$', "")


def dot_label(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def dot_id(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Za-z0-9_]", "_")


def constraint_label(kind: Column, fields: Column) -> Column:
    """``FOREIGN_KEY a REFERENCES b``, ``UNIQUE (a, b)``, ``PRIMARY (a)``."""
    listed = F.concat(kind, F.lit(" ("), F.array_join(fields, ", "), F.lit(")"))
    return F.when(kind == "FOREIGN_KEY", F.concat(F.lit("FOREIGN_KEY "), F.try_element_at(fields, F.lit(1)), F.lit(" REFERENCES "), F.try_element_at(fields, F.lit(2)))).otherwise(listed)


def edge_label(src: Column, dst: Column, method: Column) -> Column:
    return F.concat(src, F.lit(" -> "), dst, F.lit("."), method)


def field_label(path: Column, kinds: Column) -> Column:
    """``a.b.c (PRIMARY, UNIQUE)``; only the path without constraints."""
    return F.when(F.size(kinds) > 0, F.concat(path, F.lit(" ("), F.array_join(F.array_sort(kinds), ", "), F.lit(")"))).otherwise(path)


def import_alias(app: Column) -> Column:
    """Name under which an application's specs are imported."""
    return F.concat(F.lit("specs_"), F.replace(app, F.lit("-"), F.lit("_")))


def spec_method(app: Column, spec: Column) -> Column:
    """Method of a spec named ``app_method``: the rest with a capital; null if the name does not begin with the application's."""
    rest = F.when(F.startswith(spec, F.concat(app, F.lit("_"))), F.substring(spec, F.length(app) + 2, F.length(spec)))
    return F.when(rest != "", F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest))))


def module_paths(root: Column) -> Column:
    """Struct of an application's wiring module, workflow module and local folder."""
    return F.struct(F.concat(root, F.lit("/wiring")).alias("wiring"), F.concat(root, F.lit("/workflow")).alias("workflow"), F.concat(F.lit("./blueprint/examples/"), F.substring_index(root, "/", -1)).alias("folder"))


def output_file(config: Column, folder: str) -> Column:
    """Generated file of a configuration file: its name without the extension, in ``folder``."""
    return F.concat(F.lit(folder + "/"), F.regexp_replace(F.substring_index(config, "/", -1), r"\.[^.]*$", ""), F.lit(".go"))


def app_package(root: Column, package: Column) -> Column:
    return F.concat_ws("/", root, package)


def taint_annotations(taints: Column) -> Column:
    """Lines of an object's taints (struct path, t, fieldpath, op), by path, then program order."""
    ordered = F.array_sort(F.transform(taints, lambda x: F.struct(x["path"].alias("path"), x["t"].alias("t"), x["fieldpath"].alias("fieldpath"), x["op"].alias("op"))))
    return F.transform(ordered, lambda x: F.concat(x["path"], F.lit(": "), x["op"], F.lit(" "), x["fieldpath"]))
