import json

import pytest
from pyspark.sql import functions as F

from keelson.operators import documents, statements
from keelson.plans.config import AnalysisConfig
from keelson.plans.facts import SCHEMAS
from keelson.sinks import writers
from keelson.sources import ddl, files, wiring

DDL = """
CREATE TABLE IF NOT EXISTS `users` (
  id INT PRIMARY KEY, -- the key, really
  email VARCHAR(20) UNIQUE, kind ENUM('a,b', 'c'),
  org INT REFERENCES orgs(id)
) ENGINE=x;
CREATE TABLE members (a INT, b INT, PRIMARY KEY (a, b), CONSTRAINT u UNIQUE KEY uk (b), FOREIGN KEY (a) REFERENCES users(id));
"""


def test_ddl(spark, tmp_path):
    assert ddl.parse_ddl(DDL) == [
        ("users", "PRIMARY", ["id"]), ("users", "UNIQUE", ["email"]), ("users", "FOREIGN_KEY", ["org", "orgs.id"]),
        ("members", "PRIMARY", ["a", "b"]), ("members", "UNIQUE", ["b"]), ("members", "FOREIGN_KEY", ["a", "users.id"]),
    ]
    (tmp_path / "x.sql").write_text(DDL)
    found = {(r.type, tuple(r.fields)) for r in ddl.keys_from_ddl(spark, {"db": str(tmp_path / "x.sql")}).collect()}
    assert ("FOREIGN_KEY", ("db.members.a", "db.users.id")) in found and ("PRIMARY", ("db.members.a", "db.members.b")) in found


def test_json_schema_and_lines(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"$jsonSchema": {"database": "d", "collection": "c", "uniqueItems": ["x"], "properties": {}}}))
    assert files.keys_from_json_schema(spark, str(tmp_path / "s.json")).first().type == "UNIQUE"
    assert files.keys_from_json_schema(spark, str(tmp_path / "s.json"), AnalysisConfig(nosql_indexes_as_primary_keys=True)).first().fields == ["d.c.x"]
    lines = spark.createDataFrame([("FOREIGN_KEY a.b.c REFERENCES d.e.f",), ("nonsense",), (None,)], "value string")
    assert [r.fields for r in files.references_from_lines(lines).collect()] == [["a.b.c", "d.e.f"]]
    tags = spark.createDataFrame([("d", "c", "ID", 'bson:"_id,omitempty"'), ("d", "c", "Name", 'bson:"name"')], "db string, collection string, field string, tag string")
    assert [(r.alias, r.path) for r in files.primary_keys_from_tags(tags).collect()] == [("d.c.ID", "d.c._id")]


def test_suppressions_and_registry(spark):
    shop = "# known\napp: shop\nignore_cascade:\n  - database: orders   # always\n    entity: 'order'\n  - entity: cart\n    database: carts\n    trigger_database: users\n    trigger_entity: user\n  - database: logs\n    entity: log\n    trigger_database: users\n\n"
    texts = lambda *t: spark.createDataFrame(list(enumerate(t)), "file int, value string")
    rows = {tuple(r) for r in files.suppressions(texts(shop, "app: mail\nignore_cascade:\n- database: a\n  entity: b"), None).collect()}
    assert rows == {("shop", "orders", "order", None, None), ("shop", "carts", "cart", "users", "user"), ("shop", "logs", "log", None, None), ("mail", "a", "b", None, None)}
    with pytest.raises(ValueError):
        files.suppressions(texts(shop), "other")
    assert files.suppressions(texts(shop), "shop").count() == 3 and files.suppressions(texts(), "shop").count() == 0
    apps = files.app_registry(texts("build_tag: x\napps:\n  - name: shop\n    app_root: \"r:8/x\"\n  -\n    name: mail\n")).collect()
    assert {(r.name, r.app_root, r.spec_name) for r in apps} == {("shop", "r:8/x", None), ("mail", None, None)}


def test_wiring(spark):
    clients = spark.createDataFrame([("app", "user_db.client", "MongoDBClient"), ("app", "cache.client", "RedisClient"), ("app", "x", "Other")], "app string, name string, client_type string")
    assert {(r.db, r.kind) for r in wiring.databases(clients).collect()} == {("user_db", "NoSQLDatabase"), ("cache", "Cache")}
    services = spark.createDataFrame([("app", "S", "pkg", ["Get", "Init"], ["T"], ["f"]), ("app", "T", "pkg", ["Run"], [], [])], "app string, service string, package string, methods array<string>, deps array<string>, fields array<string>")
    front = spark.createDataFrame([("app", "S")], "app string, service string")
    assert {r.entry for r in wiring.entrypoints(front, services).collect()} == {"pkg.S.Get", "pkg.T.Run"}
    edges = spark.createDataFrame([("new", "STORE_VALUE", "p1", "st", None), ("new", "STORE_ADDRESS", "ad", "st", None), ("new", "FIELD", "s", "ad", "db")], "fn string, etype string, src string, dst string, param string")
    names = spark.createDataFrame([("new", "p1", "S", "user_db")], "fn string, param string, service string, wiring_name string")
    assert [tuple(r) for r in wiring.constructor_bindings(edges, names).collect()] == [("S", "db", "user_db")]
    calls = spark.createDataFrame([("1", "S", "db", "FindOne"), ("2", "S", "zz", "M")], "id string, service string, field string, method string")
    targets = wiring.call_targets(calls, wiring.constructor_bindings(edges, names), wiring.databases(clients), services)
    assert {(r.id, r.kind) for r in targets.collect()} == {("1", "database"), ("2", "method")}
    assert wiring.method_catalogue(spark).where("kind = 'Queue'").count() == 2


#: Statements and (op, path, role, placeholder) of what they touch, in order.
STATEMENTS = {
    "SELECT * FROM users WHERE id = ?": [("read", "users.*", "value", None), ("read", "users.id", "key", 1)],
    "select u.name from users u join orgs o on o.id = u.org where o.id = ? and u.x > ?": [("read", "users.name", "value", None), ("read", "orgs.id", "key", 1), ("read", "users.x", "key", 2)],
    "INSERT INTO t (a, b) VALUES (?, 1)": [("write", "t.a", "value", 1)],
    "INSERT INTO t (a, b, c) VALUES (?, UPPER(?), 3), (4, 5, ?) ON DUPLICATE KEY UPDATE a = ?": [("write", "t.a", "value", 1), ("write", "t.b", "value", 2), ("write", "t.c", "value", 3), ("write", "t.a", "value", 4)],
    "update t set a = ?, b = ? where c = ?": [("update", "t.a", "value", 1), ("update", "t.b", "value", 2), ("update", "t.c", "key", 3)],
    "DELETE FROM t": [("delete", "t.*", "key", None)],
    "DELETE FROM t WHERE t.x = ? AND y = 'a?b'": [("delete", "t.x", "key", 1)],
    "SELECT a, COUNT(b) AS n, `x y`.c FROM t AS z, `x y` WHERE z.a IN (?, ?) AND (b LIKE ? OR ? = c) AND d BETWEEN ? AND ? AND e IN (SELECT f FROM g h WHERE h.k = ? AND z.q = ?) LIMIT ?": [
        ("read", "t.a", "value", None), ("read", "t.b", "value", None), ("read", "x y.c", "value", None), ("read", "t.a", "key", 1), ("read", "t.a", "key", 2), ("read", "t.b", "key", 3), ("read", "t.c", "key", 4),
        ("read", "t.d", "key", 5), ("read", "t.d", "key", 6), ("read", "g.f", "value", None), ("read", "g.k", "key", 7), ("read", "t.q", "key", 8), ("read", None, "limit", 9),
    ],
    "SELECT a FROM t UNION SELECT b FROM u WHERE u.c = ?": [("read", "t.a", "value", None), ("read", "u.b", "value", None), ("read", "u.c", "key", 1)],
    "": [],
    "not sql ((": [],
}


def test_statements(spark):
    rows = spark.createDataFrame([(q,) for q in (*STATEMENTS, None, "DELETE FROM t")], "statement string")
    found: dict = {}
    for r in statements.statement_columns(rows).orderBy("pos").collect():
        found.setdefault(r.statement, []).append((r.op, r.path, r.role, r.placeholder))
    assert found == {q: e for q, e in STATEMENTS.items() if e}
    one = {r.statement: [tuple(e) for e in r.effects] for r in statements.with_effects(rows, "statement").collect()}
    assert one[None] == [] and one["DELETE FROM t"] == [("delete", "t.*", "key")] and len(one) == len(STATEMENTS) + 1


#: Documents and (field, value) of what they hold.
DOCUMENTS = {
    '{"$and": [{"a": "t1"}, {"b": {"$in": ["t2", "t3"]}}]}': [("a", "t1"), ("b[*]", "t2"), ("b[*]", "t3")], '{"$set": {"x": 1, "y": {"z": 2}}}': [("x", "1"), ("y", "2")], '{"n": {"$gt": 5}}': [("n", "5")], '{"$inc": {"k": 1}}': [("k", "1")],
    '{"e": {}, "f": [], "g": {"$each": [1], "$nin": ["u"], "h": {"$lt": "w"}}, "$or": [{"i": [1, {"j": 2}]}]}': [("e", None), ("f", None), ("g", "w"), ("g[*]", "u"), ("i", "1"), ("i", "2")], "[]": [], "{}": [], "{bad": [], '{"p": null}': [("p", None)], "7": [],
}


def test_documents(spark):
    rows = spark.createDataFrame([(d,) for d in (*DOCUMENTS, None, "{}")], "document string")
    found: dict = {}
    for r in documents.document_values(rows).collect():
        found.setdefault(r.document, []).append((r.field, r.value))
    key = lambda x: (x[0], x[1] or "")
    assert {d: sorted(v, key=key) for d, v in found.items()} == {d: v for d, v in DOCUMENTS.items() if v}
    fields = {r.document: r.fields for r in documents.with_fields(rows, "document").collect()}
    assert fields[None] == [] and fields['{"$set": {"x": 1, "y": {"z": 2}}}'] == ["x", "y"]


def test_sinks(spark, tmp_path):
    services = spark.createDataFrame([("app", "S", ["b", "a"], ["f"], ["N", "M"])], "app string, service string, deps array<string>, fields array<string>, methods array<string>")
    dbs = spark.createDataFrame([("app", "d", "Cache")], "app string, db string, kind string")
    doc = json.loads(writers.app_json(services, dbs).first().value)
    assert doc["services"][0]["methods"] == ["M", "N"] and doc["databases"] == [{"db": "d", "kind": "Cache"}]
    fields = spark.createDataFrame([("app", "d.c.b", "d", "c", "b"), ("app", "d.c.a", "d", "c", "a")], SCHEMAS["field"])
    keys = spark.createDataFrame([("app", "1", "UNIQUE", ["d.c.a"], False)], SCHEMAS["constraint"])
    doc = json.loads(writers.schema_document(fields, keys).first().value)
    assert doc == {"db": "d", "schema": "c", "fields": ["d.c.a", "d.c.b"], "constraints": ["UNIQUE (d.c.a)"]}
    old = spark.createDataFrame([("x",), ("y",)], "line string")
    new = spark.createDataFrame([(1, "y"), (2, "z")], "n long, line string")
    assert {(r.status, r.line) for r in writers.write_report(new, str(tmp_path / "r"), old).collect()} == {("added", "z"), ("removed", "x"), ("unmodified", "y")}
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["y", "z"]
    nodes = spark.createDataFrame([("A.B", "SERVICE"), ("d", "DATABASE")], "node string, kind string")
    edges = spark.createDataFrame([("A.B", "d", "Find", "read", 1)], "src string, dst string, method string, op string, ord int")
    lines = [r.value for r in writers.call_graph_dot(nodes, edges, detailed=True).collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and '  A_B -> d [label="Find [read]"];' in lines
    m = writers.Metrics()
    with m.timed("step"):
        pass
    m.write(spark, str(tmp_path / "m"))
    assert "step_s" in spark.read.text(str(tmp_path / "m")).first().value


def test_reports_are_compared_in_one_pass(spark):
    """Lines keep their multiplicity, and each report is read and dealt out once."""
    old, new = (spark.createDataFrame([(x,) for x in rows], "line string") for rows in (["a", "a", "b", None], ["a", "b", "b", "c", None]))
    found = files.changed_lines(old, new)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert sorted(((r.status, r.line) for r in found.collect()), key=repr) == sorted([("removed", "a"), ("unmodified", "a"), ("unmodified", "b"), ("added", "b"), ("added", "c"), ("unmodified", None)], key=repr)
