"""Queries from datastore calls to the taints that they emit: orders are queue, cache and document calls, parts are relational calls with statements composed from their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents, emission, statements
from ..sources import wiring
from .integrity import query, table
from .program import text

#: Methods take turns over customers; fixed values.
METHODS = (
    ("Queue", "Push"), ("Queue", "Pop"), ("Cache", "Put"), ("Cache", "Get"), ("Cache", "Mget"), ("NoSQLDatabase", "InsertOne"), ("NoSQLDatabase", "InsertMany"), ("NoSQLDatabase", "FindOne"), ("NoSQLDatabase", "FindMany"),
    ("NoSQLDatabase", "UpdateOne"), ("NoSQLDatabase", "UpdateMany"), ("NoSQLDatabase", "ReplaceOne"), ("NoSQLDatabase", "Upsert"), ("NoSQLDatabase", "DeleteOne"), ("NoSQLDatabase", "DeleteMany"), ("NoSQLDatabase", "Drop"),
)
#: Filter documents with a mark for the order's number, and the fields and values that they hold.
FILTERS = (
    ('{"f": "x@"}', (("f", "x@"),)), ('{"$and": [{"a": "x@"}, {"b": {"$in": ["y@", "z@"]}}]}', (("a", "x@"), ("b", "y@"), ("b", "z@"))), ('{"n": {"$gt": "x@"}}', (("n", "x@"),)),
    ('{"$or": [{"a": "x@"}, {"c": {"d": "y@"}}]}', (("a", "x@"), ("c", "y@"))), ('{"p": {"$each": ["x@"], "q": "y@"}, "r": "z@"}', (("p", "y@"), ("r", "z@"))),
)
CHANGES = (('{"$set": {"s": "u@", "t": {"w": "v@"}}}', (("s", "u@"), ("t", "v@"))), ('{"$push": {"l": {"$each": ["u@"]}}, "$inc": {"m": "v@"}}', (("m", "v@"),)))
PROJECTIONS = ('{"p1": true}', '{"p1": true, "p2": true}')


def _pick(values, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    o, cust = table(spark, d, "orders"), F.col("o_custkey")
    turn = cust % len(METHODS)
    kind, method = (_pick([m[i] for m in METHODS], turn) for i in (0, 1))
    schema = F.when(kind == "Queue", "notification").when(kind == "NoSQLDatabase", text("col", cust % 4))
    return o.select(F.col("o_orderkey").alias("key"), text("c", F.col("o_orderkey")).alias("call_id"), text("f", cust % 9).alias("fn"), kind.alias("kind"), method.alias("method"), text("n", cust % 3).alias("db"), schema.alias("schema"))


def _arguments(calls: DataFrame) -> DataFrame:
    """First and second arguments: plain values, keys put together in four ways, filters, changes and projections."""
    key, method = F.col("key"), F.col("method")
    value = lambda pos: text("v", key, f".{pos}")
    filled = lambda values, index: F.replace(_pick(values, index), F.lit("@"), key.cast("string"))
    is_key = F.col("kind") == "Cache"
    shape = F.when(is_key, _pick(("plain", "joined", "call", "joined"), key % 4))
    suffix = F.when(is_key & (key % 4 == 1), text(":ns", key % 3))
    asks = method.isin("FindOne", "FindMany", "UpdateOne", "UpdateMany", "ReplaceOne", "Upsert", "DeleteOne", "DeleteMany")
    first = calls.select("call_id", F.lit(1).alias("pos"), value(1).alias("id"), shape.alias("shape"), F.array(text("l", key), text("r", key)).alias("parts"), suffix.alias("suffix"), F.when(asks, filled([f[0] for f in FILTERS], key % len(FILTERS))).alias("document"))
    change = F.when(method.isin("UpdateOne", "UpdateMany"), filled([c[0] for c in CHANGES], key % len(CHANGES))).when(method.isin("FindOne", "FindMany") & (key % 3 > 0), _pick(PROJECTIONS, F.greatest(key % 3 - 1, F.lit(0))))
    second = calls.select("call_id", F.lit(2).alias("pos"), value(2).alias("id"), F.lit(None).cast("string").alias("shape"), F.lit(None).cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("suffix"), change.alias("document"))
    return first.unionByName(second)


def _cursors(calls: DataFrame) -> DataFrame:
    return calls.where("method IN ('FindOne', 'FindMany')").select("call_id", text("d", F.col("key")).alias("id"))


def _held(rows, mark: str) -> str:
    values = ", ".join(f"({i}, '{field}', '{value}')" for i, (_, held) in enumerate(rows) for field, value in held)
    return f"(VALUES {values}) {mark}(i, field, value)"


_CALLS = f"""calls AS (
    SELECT o_orderkey AS key, 'c' || o_orderkey AS call_id, 'f' || (o_custkey % 9) AS fn, kind, method, 'n' || (o_custkey % 3) AS db, CASE kind WHEN 'Queue' THEN 'notification' WHEN 'NoSQLDatabase' THEN 'col' || (o_custkey % 4) END AS schema
    FROM orders JOIN (VALUES {", ".join(f"({i}, '{k}', '{m}')" for i, (k, m) in enumerate(METHODS))}) v(i, kind, method) ON o_custkey % {len(METHODS)} = i
),
ops(method, op) AS (VALUES ('Push', 'write'), ('Pop', 'read'), ('Put', 'write'), ('Get', 'read'), ('Mget', 'read_many'), ('InsertOne', 'write'), ('InsertMany', 'write'), ('FindOne', 'read'), ('FindMany', 'read_many'), ('UpdateOne', 'update'),
    ('UpdateMany', 'update'), ('ReplaceOne', 'update'), ('Upsert', 'update'), ('DeleteOne', 'delete'), ('DeleteMany', 'delete')),
k AS (SELECT calls.*, op, CASE WHEN key % 4 = 1 THEN 'ns' || (key % 3) ELSE '*' END AS ns, CASE WHEN method = 'Mget' THEN '_obj[*]' ELSE '_obj' END AS cached FROM calls JOIN ops USING (method)),
emitted AS (
    SELECT call_id, 'v' || key || '.1' AS id, CASE method WHEN 'InsertMany' THEN '_obj[*]' ELSE '_obj' END AS objpath, db || '.' || schema AS fieldpath, op, false AS read_key, method = 'Pop' AS read_val FROM k WHERE method IN ('Push', 'Pop', 'InsertOne', 'InsertMany')
    UNION ALL SELECT call_id, 'v' || key || '.2', '_obj', db || '.' || schema, op, false, false FROM k WHERE method IN ('ReplaceOne', 'Upsert')
    UNION ALL SELECT call_id, unnest(CASE key % 4 WHEN 1 THEN ['l' || key] WHEN 2 THEN ['l' || key, 'r' || key] ELSE ['v' || key || '.1'] END), cached, db || '.' || ns || '.Key', op, true, false FROM k WHERE kind = 'Cache'
    UNION ALL SELECT call_id, 'v' || key || '.2', cached, db || '.' || ns || '.Value', op, false, true FROM k WHERE kind = 'Cache'
    UNION ALL SELECT call_id, replace(value, '@', key::VARCHAR), '_obj', db || '.' || schema || '.' || field, op, true, false FROM k JOIN {_held(FILTERS, "f")} ON key % {len(FILTERS)} = f.i WHERE kind = 'NoSQLDatabase' AND NOT starts_with(method, 'Insert')
    UNION ALL SELECT call_id, replace(value, '@', key::VARCHAR), '_obj', db || '.' || schema || '.' || field, op, false, false FROM k JOIN {_held(CHANGES, "c")} ON key % {len(CHANGES)} = c.i WHERE method IN ('UpdateOne', 'UpdateMany')
    UNION ALL SELECT call_id, 'd' || key, CASE method WHEN 'FindMany' THEN '_obj[*]' ELSE '_obj' END, db || '.' || schema || CASE WHEN method = 'FindMany' AND key % 3 = 1 THEN '.p1' ELSE '' END, op, false, true FROM k WHERE method IN ('FindOne', 'FindMany')
)"""


@query("datastore_taints", f"WITH {_CALLS} SELECT * FROM emitted")
def datastore_taints(spark, d):
    """Taints that queue, cache and document calls emit, from calls and arguments."""
    calls = _calls(spark, d)
    return emission.emitted_taints(calls, _arguments(calls), _cursors(calls))


@query("datastore_seeds", f"WITH {_CALLS} SELECT fn, id, objpath, fieldpath, call_id, op, 'database' AS kind FROM emitted JOIN calls USING (call_id)")
def datastore_seeds(spark, d):
    """The taints of datastore calls as seeds of their functions."""
    calls = _calls(spark, d)
    return emission.seeds(emission.emitted_taints(calls, _arguments(calls), _cursors(calls)), calls)


@query("document_fields", f"""WITH {_CALLS} SELECT call_id, string_agg(field, ',' ORDER BY field) AS fields FROM (
    SELECT DISTINCT call_id, CASE WHEN field = 'b' THEN 'b[*]' ELSE field END AS field FROM k JOIN {_held(FILTERS, "f")} ON key % {len(FILTERS)} = f.i WHERE kind = 'NoSQLDatabase' AND NOT starts_with(method, 'Insert')) GROUP BY call_id""")
def document_fields(spark, d):
    """Fields that filter documents name, read over Spark's variant type."""
    asked = _arguments(_calls(spark, d)).where("pos = 1 AND document IS NOT NULL").select("call_id", "document")
    return documents.with_fields(asked, "document").select("call_id", F.array_join(F.array_sort("fields"), ",").alias("fields"))


@query("cache_namespaces", f"WITH {_CALLS} SELECT call_id, 'ns' || (key % 3) AS namespace FROM calls WHERE kind = 'Cache' AND key % 4 = 1")
def cache_namespaces(spark, d):
    """Namespaces that the suffixes of cache keys name."""
    return emission.cache_namespaces(_arguments(_calls(spark, d)))


@query("method_catalogue", f"WITH {_CALLS} SELECT kind, count(DISTINCT method) AS n_methods, count(*) AS n_calls, count(*) FILTER (op IN ('read', 'read_many')) AS n_reads FROM k GROUP BY kind")
def method_catalogue(spark, d):
    """Methods of the catalogue that calls use, by kind of datastore."""
    calls = wiring.datastore_calls(_calls(spark, d))
    return calls.groupBy("kind").agg(F.countDistinct("method").alias("n_methods"), F.count(F.lit(1)).alias("n_calls"), F.count_if(F.col("op").isin("read", "read_many")).alias("n_reads"))


#: Statements with marks for a table, a column and another table, and (placeholder, item, op, path, role) of what they touch.
STATEMENTS = (
    ("Exec", "INSERT INTO `T@` (id, \"C@\", note) VALUES (?, ?, 'n?')", ((1, None, "write", "T@.id", "value"), (2, None, "write", "T@.C@", "value"))),
    ("Select", "SELECT x.C@, x.id FROM T@ x JOIN R@ AS r ON r.id = x.ref WHERE r.C@ IN (?, ?) AND x.id = ?", ((None, 1, "read", "T@.C@", "value"), (None, 2, "read", "T@.id", "value"), (1, None, "read", "R@.C@", "key"), (2, None, "read", "R@.C@", "key"), (3, None, "read", "T@.id", "key"))),
    ("Select", "SELECT * FROM T@ WHERE C@ >= ? AND id IN (SELECT k FROM R@ WHERE R@.m = ?) LIMIT ?", ((None, 1, "read", "T@.*", "value"), (1, None, "read", "T@.C@", "key"), (None, None, "read", "R@.k", "value"), (2, None, "read", "R@.m", "key"), (3, None, "read", None, "limit"))),
    ("Exec", "UPDATE T@ SET C@ = ?, note = 'x' WHERE id = ? AND ? < lim", ((1, None, "update", "T@.C@", "value"), (2, None, "update", "T@.id", "key"), (3, None, "update", "T@.lim", "key"))),
    ("Exec", "delete from T@ where T@.C@ = ? and T@.id <> ?", ((1, None, "delete", "T@.C@", "key"), (2, None, "delete", "T@.id", "key"))),
    ("Get", "SELECT COUNT(C@) AS n FROM T@ WHERE note LIKE '%?%' AND C@ BETWEEN ? AND ?", ((None, 1, "read", "T@.C@", "value"), (1, None, "read", "T@.C@", "key"), (2, None, "read", "T@.C@", "key"))),
    ("Exec", "DELETE FROM T@", ((None, None, "delete", "T@.*", "key"),)),
)


def _relational(spark: SparkSession, d: str) -> DataFrame:
    """One call a part; hundreds of different statements."""
    key, size = F.col("p_partkey"), F.col("p_size")
    statement = _pick([s[1] for s in STATEMENTS], key % len(STATEMENTS))
    for mark, name in (("T@", text("tab", size % 7)), ("C@", text("col", size)), ("R@", text("ref", size % 5))):
        statement = F.replace(statement, F.lit(mark), name)
    return table(spark, d, "part").select(key.alias("key"), text("c", key).alias("call_id"), _pick([s[0] for s in STATEMENTS], key % len(STATEMENTS)).alias("method"), text("m", size % 2).alias("db"), statement.alias("statement"))


def _null(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


_BOUND = f"""bound AS (
    SELECT p_partkey, 'c' || p_partkey AS call_id, 'm' || (p_size % 2) AS db, n AS placeholder, item, op, role, replace(replace(replace(path, 'T@', 'tab' || (p_size % 7)), 'C@', 'col' || p_size), 'R@', 'ref' || (p_size % 5)) AS path, method
    FROM part JOIN (VALUES {", ".join(f"({i}, '{s[0]}', {', '.join(map(_null, e))})" for i, s in enumerate(STATEMENTS) for e in s[2])}) v(i, method, n, item, op, path, role) ON p_partkey % {len(STATEMENTS)} = i
)"""


@query("statement_columns", f"WITH {_BOUND} SELECT p_partkey, placeholder, item, op, path, role FROM bound")
def statement_columns(spark, d):
    """Columns that statements touch and placeholders are bound to: lists, nested selects, aliases, quoted names."""
    calls = _relational(spark, d)
    found = calls.join(statements.statement_columns(calls), "statement")
    return found.select(F.col("key").alias("p_partkey"), "placeholder", "item", "op", "path", "role")


@query("relational_taints", f"""WITH {_BOUND} SELECT DISTINCT call_id, CASE WHEN item = 1 THEN 'd' || p_partkey ELSE 'a' || p_partkey || '.' || placeholder END AS id, '_obj' AS objpath, db || '.' || replace(path, '.*', '') AS fieldpath, op, item IS NULL AS read_key, item IS NOT NULL AS read_val
    FROM bound WHERE (placeholder IS NOT NULL AND path IS NOT NULL) OR (item = 1 AND method = 'Select')""")
def relational_taints(spark, d):
    """Taints of bound arguments and of the destinations of selects."""
    calls = _relational(spark, d)
    arguments = calls.select("call_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("n"), "key").select("call_id", "n", text("a", F.col("key"), ".", F.col("n")).alias("id"))
    return emission.relational_taints(calls, arguments, calls.select("call_id", text("d", F.col("key")).alias("id")))
