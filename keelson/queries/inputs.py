"""Queries over sources and sinks: files are written to the shared folder from the tables, read as the analysis reads them, and compared with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import detectors, graph, references, taints
from ..plans.config import AnalysisConfig
from ..plans.facts import is_primary, is_unique
from ..plans.staging import scratch_path, stage, write_file
from ..sinks import writers
from ..sources import ddl, files, wiring
from .integrity import _CASCADE, _COORD, _FK, _OPS, _RACES, _UNIQUE, daily_ops_and_refs_of, daily_ops_of, ops_and_refs_of, ops_of, ops_refs_votes_of, query, staged_refs_of, table
from .program import _GRAPH, graph_input, text


def _written(lines: DataFrame, name: str) -> str:
    """Write a column of lines as text; returns the folder."""
    path = scratch_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _file(spark: SparkSession, name: str, content: str) -> str:
    path = scratch_path(spark, name)
    write_file(spark, path, [content.encode()])
    return path


@query("ddl_keys", """SELECT 'PRIMARY' AS type, 'db.t' || n_nationkey || '.id' AS fields FROM nation UNION ALL SELECT 'UNIQUE', 'db.t' || n_nationkey || '.code' FROM nation UNION ALL SELECT 'UNIQUE', 'db.t' || n_nationkey || '.a,db.t' || n_nationkey || '.b' FROM nation
    UNION ALL SELECT 'FOREIGN_KEY', 'db.t' || n_nationkey || '.region,db.r' || n_regionkey || '.id' FROM nation""")
def ddl_keys(spark, d):
    """Keys of SQL DDL files, one table for each nation."""
    sql = "CREATE TABLE IF NOT EXISTS `t%d` (id INT PRIMARY KEY, code VARCHAR(10) NOT NULL UNIQUE, a INT, b DECIMAL(8, 2), region INT, UNIQUE KEY ab (a, b), FOREIGN KEY (region) REFERENCES r%d(id)); -- end"
    path = _written(table(spark, d, "nation").select(F.format_string(sql, "n_nationkey", "n_regionkey")), "ddl")
    return ddl.keys_from_ddl(spark, {"db": path}).select("type", F.array_join("fields", ",").alias("fields"))


for _flag, _kind, _name in ((False, "UNIQUE", "json_schema_keys"), (True, "PRIMARY", "json_schema_primary_keys")):

    @query(_name, f"SELECT '{_kind}' AS type, 'db' || n_regionkey || '.c' || n_nationkey || '.' || f AS field FROM nation, (VALUES ('code'), ('name')) v(f)")
    def _json_schema(spark, d, flag=_flag):
        """Keys of JSON schemas' unique items, one document for each nation."""
        doc = '{"$jsonSchema": {"database": "db%d", "collection": "c%d", "uniqueItems": ["code", "name"], "properties": {"code": "string"}}}'
        rows = table(spark, d, "nation").select(F.format_string(doc, "n_regionkey", "n_nationkey").alias("v"))
        content = "[" + ",\n".join(r["v"] for r in rows.collect()) + "]"  # nation has 25 rows at every scale
        found = files.keys_from_json_schema(spark, _file(spark, "schema.json", content), AnalysisConfig(nosql_indexes_as_primary_keys=flag))
        return found.select("type", F.element_at("fields", 1).alias("field"))


@query("reference_lines", "SELECT 'db1.c.f' || s_suppkey AS src, 'db2.c.f' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 3 <> 0")
def reference_lines(spark, d):
    """References of a user's file; lines of another form are left out."""
    key = F.col("s_suppkey")
    line = F.when(key % 3 == 0, text("FOREIGN_KEY db1.f", key, " REFERENCES db2")).otherwise(text("  FOREIGN_KEY db1.c.f", key, "   REFERENCES db2.c.f", F.col("s_nationkey")))
    path = _written(table(spark, d, "supplier").select(line), "references")
    return files.references_from_lines(spark.read.text(path)).select(F.col("fields")[0].alias("src"), F.col("fields")[1].alias("dst"))


@query("tagged_keys", "SELECT 'db' AS db, 'c' || (p_partkey % 9) AS collection, 'db.c' || (p_partkey % 9) || '.F' || p_partkey AS alias, 'db.c' || (p_partkey % 9) || '._id' AS path FROM part WHERE p_size % 2 = 0")
def tagged_keys(spark, d):
    """Primary keys and aliases of struct tags."""
    key = F.col("p_partkey")
    tag = F.when(F.col("p_size") % 2 == 0, 'json:"id" bson:"_id,omitempty"').otherwise('bson:"size"')
    return files.primary_keys_from_tags(table(spark, d, "part").select(F.lit("db").alias("db"), text("c", key % 9).alias("collection"), text("F", key).alias("field"), tag.alias("tag")))


@query("alias_redirect", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'db.c' || (p_partkey % 9) || '._id' ELSE 'db.c' || (p_partkey % 9) || '.F' || p_partkey END AS path FROM part")
def alias_redirect(spark, d):
    """Fields by their canonical paths: a join with the aliases of tags."""
    key = F.col("p_partkey")
    fields = table(spark, d, "part").select("p_partkey", text("db.c", key % 9, ".F", key).alias("p"))
    joined = fields.join(tagged_keys(spark, d).select("alias", F.col("path").alias("canonical")), F.col("p") == F.col("alias"), "left")
    return joined.select("p_partkey", paths.resolve_alias(F.col("p"), F.col("canonical")).alias("path"))


#: Suppressions: one file a nation, one item a supplier.
_SUPPLIED = "s AS (SELECT *, 's' || s_suppkey AS db, 'u' || (s_suppkey % 4) AS trigger FROM supplier)"


@query("suppression_file", f"WITH {_SUPPLIED} SELECT 'app' || s_nationkey AS app, db, 'entity' || s_nationkey AS entity, CASE WHEN s_suppkey % 3 = 1 THEN trigger END AS trigger_db, CASE WHEN s_suppkey % 3 = 1 THEN 'user' END AS trigger_entity FROM s")
def suppression_file(spark, d):
    """Suppressions of files, one for each application; a trigger needs database and entity."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    item = F.concat(text("  - database: s", key, "   # always\n    entity: 'entity", nation, "'\n"), F.when(key % 3 > 0, text("    trigger_database: u", key % 4, "\n")).otherwise(""), F.when(key % 3 == 1, "    trigger_entity: user\n").otherwise(""))
    content = F.concat(text("# what is known\napp: app", nation, "\nignore_cascade:\n"), F.array_join(F.array_sort(F.collect_list(item)), ""))
    path = scratch_path(spark, "suppressions")
    table(spark, d, "supplier").groupBy(nation).agg(content.alias("value")).write.partitionBy("s_nationkey").text(path)
    return files.suppressions(files.whole_texts(spark, path))


#: Applications: one a supplier, in as many registry files as there are parts.
_APPS = """(SELECT 'my-app' || s_suppkey AS name, 'host.org/examples/a' || s_suppkey AS app_root, CASE WHEN s_suppkey % 2 = 0 THEN 'workflow/a' || s_nationkey END AS package_path, 'my-app' || s_suppkey || '_' || CASE WHEN s_suppkey % 3 = 0 THEN 'docker' ELSE 'plain' END AS spec_name,
    'wiring/specs' AS spec_path, CASE WHEN s_suppkey % 5 = 0 THEN 'db/a.sql' END AS sql_tables, CAST(NULL AS VARCHAR) AS nosql_path FROM supplier) v"""
_METHOD_OF = "CASE WHEN ends_with(spec_name, 'docker') THEN 'Docker' ELSE 'Plain' END"


@query("app_registry", f"SELECT * FROM {_APPS}")
def app_registry(spark, d):
    """Applications of registry files."""
    key = F.col("s_suppkey")
    item = F.concat(
        text("  - name: my-app", key, "\n    app_root: \"host.org/examples/a", key, "\"\n"), F.when(key % 2 == 0, text("    package_path: workflow/a", F.col("s_nationkey"), "\n")).otherwise(""),
        text("    spec_name: 'my-app", key, "_"), F.when(key % 3 == 0, "docker").otherwise("plain"), F.lit("'\n    spec_path: wiring/specs"), F.when(key % 5 == 0, "\n    sql_tables: db/a.sql").otherwise(""),
    )
    return files.app_registry(files.whole_texts(spark, _written(table(spark, d, "supplier").select(item), "registry")))


@query("registry_source", f"""SELECT 'import' AS part, name, chr(9) || 'specs_' || replace(name, '-', '_') || ' "' || app_root || '/' || spec_path || '"' AS line FROM {_APPS}
    UNION ALL SELECT 'case', name, chr(9) || 'case "' || name || '": return specs_' || replace(name, '-', '_') || '.' || {_METHOD_OF} FROM {_APPS}""")
def registry_source(spark, d):
    """Generated registry lines of the applications, written and read back."""
    rows = writers.registry_source(app_registry(spark, d))
    path = scratch_path(spark, "registry")
    rows.write.json(path)
    return spark.read.schema(rows.schema).json(path)


@query("registry_names", f"""SELECT name, 'specs_' || replace(name, '-', '_') AS alias, {_METHOD_OF} AS method, app_root || '/wiring' AS wiring, app_root || '/workflow' AS workflow,
    './blueprint/examples/' || split_part(app_root, '/', 3) AS folder, 'out/' || name || '.go' AS output, app_root || '/' || coalesce(package_path, '') AS package FROM {_APPS}""")
def registry_names(spark, d):
    """Names derived for generated registries, and packages of applications."""
    n, root = F.col("name"), F.col("app_root")
    paths_of = names.module_paths(root)
    config = text("config/", n, ".yaml")
    return app_registry(spark, d).select(
        "name", names.import_alias(n).alias("alias"), names.spec_method(n, F.col("spec_name")).alias("method"), paths_of["wiring"].alias("wiring"), paths_of["workflow"].alias("workflow"), paths_of["folder"].alias("folder"),
        names.output_file(config, "out").alias("output"), names.app_package(root, F.coalesce("package_path", F.lit(""))).alias("package"),
    )


@query("report_changes", """WITH o AS (SELECT 'order ' || o_custkey AS line FROM orders WHERE o_orderstatus <> 'O'), n AS (SELECT 'order ' || o_custkey AS line FROM orders WHERE o_orderstatus <> 'F')
    SELECT 'added' AS status, line FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT 'removed', line FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) UNION ALL SELECT 'unmodified', line FROM (SELECT * FROM n INTERSECT ALL SELECT * FROM o)""")
def report_changes(spark, d):
    """What a report adds to, drops and keeps of the one before, which is read from its file: orders that were not open, then those that are not finished."""
    o = table(spark, d, "orders")
    line = text("order ", F.col("o_custkey")).alias("line")
    earlier = _written(o.where("o_orderstatus <> 'O'").select(line), "earlier-report")
    return files.changed_lines(files.previous_lines(spark, earlier), o.where("o_orderstatus <> 'F'").select(line))


@query("wiring_databases", "SELECT DISTINCT 'app' AS app, 'store' || s_suppkey AS db, CASE s_suppkey % 7 WHEN 0 THEN 'Cache' WHEN 1 THEN 'Cache' WHEN 2 THEN 'Queue' WHEN 3 THEN 'NoSQLDatabase' WHEN 4 THEN 'RelationalDB' END AS kind FROM supplier WHERE s_suppkey % 7 < 5")
def wiring_databases(spark, d):
    """Datastores of client instances; other clients are none."""
    key = F.col("s_suppkey")
    kinds = F.array(*map(F.lit, ("*redis.Redis", "*memcached.MemcachedCache", "*rabbitmq.RabbitMQ", "*mongodb.MongoDB", "*mysql.MySQLDB", "*http.Server", "*grpc.Client")))
    return wiring.databases(table(spark, d, "supplier").select(F.lit("app").alias("app"), text("store", key, ".client").alias("name"), F.element_at(kinds, (key % 7 + 1).cast("int")).alias("client_type")))


#: Services are regions, their methods nations.
_METHOD = "m AS (SELECT 'S' || n_regionkey AS service, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, CASE WHEN n_nationkey % 6 = 0 THEN 'Run' WHEN n_nationkey % 6 = 1 THEN 'Init' ELSE 'M' || n_nationkey END AS method FROM nation)"


def _services(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    method = F.when(key % 6 == 0, "Run").when(key % 6 == 1, "Init").otherwise(text("M", key))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", method.alias("m")))), lambda x: x["m"])
    return n.groupBy("n_regionkey").agg(listed.alias("methods")).select(
        F.lit("app").alias("app"), text("S", region).alias("service"), text("p", region).alias("package"), "methods", F.array(text("dep", region), text("dep", region + 1)).alias("deps"), F.array(text("fa", region), F.lit("fb")).alias("fields")
    )


@query("service_methods", f"WITH {_METHOD} SELECT 'app' AS app, * FROM m")
def service_methods(spark, d):
    """Methods of services, numbered."""
    return wiring.service_methods(_services(spark, d)).withColumn("pos", F.col("pos").cast("long"))


@query("service_members", "SELECT 'S' || r_regionkey AS service, 'dependency' AS part, 'dep' || (r_regionkey + i) AS name FROM region, range(2) t(i) UNION ALL SELECT 'S' || r_regionkey, 'field 0', 'fa' || r_regionkey FROM region UNION ALL SELECT 'S' || r_regionkey, 'field 1', 'fb' FROM region")
def service_members(spark, d):
    """Dependencies and fields of services."""
    s = _services(spark, d)
    deps = wiring.service_dependencies(s).select("service", F.lit("dependency").alias("part"), F.col("dependency").alias("name"))
    return deps.unionByName(wiring.service_fields(s).select("service", text("field ", F.col("idx")).alias("part"), F.col("field").alias("name")))


@query("entrypoints", f"WITH {_METHOD} SELECT DISTINCT 'app' AS app, replace(service, 'S', 'p') || '.' || service || '.' || method AS entry FROM m WHERE (service IN ('S1', 'S2') AND method <> 'Init') OR method = 'Run'")
def entrypoints(spark, d):
    """Entries of an application: methods behind frontends, and initializers named Run."""
    fronts = spark.createDataFrame([("app", "S1"), ("app", "S2")], "app string, service string")
    return wiring.entrypoints(fronts, _services(spark, d))


@query("service_lookups", "SELECT 'S' || r_regionkey AS name, 'S' || r_regionkey AS service, 'service' AS found_by FROM region UNION ALL SELECT 'app/S' || r_regionkey || 'Impl', 'S' || r_regionkey, 'impl_path' FROM region UNION ALL SELECT 'NewS' || r_regionkey, 'S' || r_regionkey, 'constructor' FROM region")
def service_lookups(spark, d):
    """Services by name, path of the implementation or constructor."""
    r = F.col("r_regionkey")
    s = table(spark, d, "region").select(text("S", r).alias("service"), text("app/S", r, "Impl").alias("impl_path"), text("NewS", r).alias("constructor"))
    wanted = s.select(F.explode(F.array("service", "impl_path", "constructor", F.lit("nothing"))).alias("name"))
    return wiring.lookups(s, wanted)


@query("database_lookups", "SELECT 'd' || s_suppkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN CASE s_suppkey % 3 WHEN 0 THEN 'Cache' WHEN 1 THEN 'Queue' ELSE 'NoSQLDatabase' END END AS kind, s_suppkey % 2 = 0 AS is_known FROM supplier")
def database_lookups(spark, d):
    """Databases by name, and names that are none."""
    key = F.col("s_suppkey")
    s = table(spark, d, "supplier").select(key, text("d", key).alias("db"), F.when(key % 3 == 0, "Cache").when(key % 3 == 1, "Queue").otherwise("NoSQLDatabase").alias("kind"))
    return wiring.database_lookups(s.where(key % 2 == 0), s.select(F.col("db").alias("name")))


#: A deployment: nations are containers with one process each, suppliers handlers in them, every fifth behind an address; parts are arguments.
_ARG_TYPES = ("*redis.RedisGoClient", "*mongodb.MongoDBGoClient", "*workflow.WorkflowClient", "*ir.IRValue", "*zap.Logger")


@query("wiring_tree", f"""WITH h AS (SELECT 'svc' || s_suppkey AS service, s_suppkey FROM supplier WHERE s_nationkey % 4 <> 3), a AS (SELECT h.service, p_partkey, 'a' || (p_partkey % 50) AS name, p_partkey % {len(_ARG_TYPES)} AS t FROM part JOIN h ON s_suppkey = p_size)
    SELECT 'service' AS what, service, NULL AS name FROM h UNION SELECT 'frontend', 'svc' || s_suppkey, NULL FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT 'dependency', service, name FROM a WHERE t = 2
    UNION SELECT 'database', CASE t WHEN 0 THEN 'Cache' ELSE 'NoSQLDatabase' END, name FROM a WHERE t < 2 UNION SELECT 'unknown', service, name FROM a WHERE t = 4""")
def wiring_tree(spark, d):
    """Services, frontends, dependencies and databases of a deployment tree."""
    n, s, p = (table(spark, d, t) for t in ("nation", "supplier", "part"))
    nation, key, part = F.col("n_nationkey"), F.col("s_suppkey"), F.col("p_partkey")
    node = lambda df, i, parent, kind, name: df.select(F.lit("app").alias("app"), i.alias("id"), parent.alias("parent"), F.lit(kind).alias("kind"), name.alias("name"))
    none = F.lit(None).cast("string")
    nodes = node(n.where(nation % 4 != 3), text("c", nation), none, "Container", none).unionByName(node(n, text("p", nation), text("c", nation), "Process", none))
    nodes = nodes.unionByName(node(s, text("h", key), text("p", F.col("s_nationkey")), "WorkflowHandler", text("svc", key)))
    shown = s.where(key % 5 == 0)
    nodes = nodes.unionByName(node(shown, text("addr", key), none, "Address", none)).unionByName(node(shown, text("http", key), text("addr", key), "GolangHttpServer", none)).unionByName(node(shown, text("w", key), text("http", key), "WorkflowHandler", text("svc", key)))
    kind = F.element_at(F.array(*map(F.lit, _ARG_TYPES)), (part % len(_ARG_TYPES) + 1).cast("int"))
    args = p.select(F.lit("app").alias("app"), text("h", F.col("p_size")).alias("handler"), part.alias("pos"), kind.alias("type"), text("a", part % 50).alias("name"))
    found = wiring.deployed(nodes, args)
    row = lambda what, df, service, name: df.select(F.lit(what).alias("what"), service.alias("service"), name.cast("string").alias("name")).distinct()
    out = row("service", found["services"], F.col("service"), none).unionByName(row("frontend", found["frontends"], F.col("service"), none)).unionByName(row("dependency", found["dependencies"], F.col("service"), F.col("dependency")))
    return out.unionByName(row("database", found["databases"], F.col("kind"), F.col("db"))).unionByName(row("unknown", found["arguments"].where("what = 'unknown'"), F.col("service"), F.col("name")))


@query("call_pairs", """WITH a AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, l_suppkey AS callee, l_linenumber AS pos, 'x' || l_partkey AS obj, l_linenumber * 2 AS enter, l_linenumber * 2 + 1 AS leave FROM lineitem),
    m AS (SELECT a.*, 'p' || s_suppkey AS param, 'r' || s_suppkey AS result FROM a JOIN supplier ON callee = s_suppkey AND pos = s_nationkey % 7 + 1)
    SELECT src, dst, time, count(*) AS n FROM (SELECT obj AS src, param AS dst, enter AS time FROM m UNION ALL SELECT param, obj, leave FROM m UNION ALL SELECT result, obj || 'y', leave FROM m) GROUP BY ALL""")
def call_pairs(spark, d):
    """Arguments with parameters and results with what callers take out of calls, by position, at the times when calls are entered and left."""
    at = F.col("l_linenumber")
    calls = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + at).alias("call_id"), F.col("l_suppkey").alias("callee"), at.alias("pos"), text("x", F.col("l_partkey")).alias("obj"), (at * 2).alias("enter"), (at * 2 + 1).alias("leave"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("callee"), (F.col("s_nationkey") % 7 + 1).alias("pos"), text("p", F.col("s_suppkey")).alias("param"), text("r", F.col("s_suppkey")).alias("result"))
    pairs = graph.call_pairs(calls, s, calls.withColumn("obj", F.concat("obj", F.lit("y"))), s, calls.select("call_id", "enter", "leave").distinct())
    return pairs.groupBy("src", "dst", "time").agg(F.count(F.lit(1)).alias("n"))


@query("constructor_bindings", "SELECT 'svc' || s_nationkey AS service, 'f' || (s_suppkey % 5) AS field, 'wired' || s_suppkey AS wiring_name FROM supplier WHERE s_suppkey % 3 <> 0")
def constructor_bindings(spark, d):
    """Fields of services that constructors store their parameters in."""
    key, fn = F.col("s_suppkey"), text("new", F.col("s_nationkey"))
    s = table(spark, d, "supplier")
    edge = lambda kind, src, dst, param: s.select(fn.alias("fn"), F.lit(kind).alias("etype"), src.alias("src"), dst.alias("dst"), param.alias("param"))
    none = F.lit(None).cast("string")
    edges = edge("STORE_VALUE", text("p", key), text("st", key), none).unionByName(edge("STORE_ADDRESS", text("a", key), text("st", key), none))
    edges = edges.unionByName(edge("FIELD", F.lit("self"), text("a", key), text("f", key % 5)))
    wired = s.where(key % 3 != 0).select(fn.alias("fn"), text("p", key).alias("param"), text("svc", F.col("s_nationkey")).alias("service"), text("wired", key).alias("wiring_name"))
    return wiring.constructor_bindings(edges, wired)


@query("call_targets", "SELECT s_suppkey AS id, 'svc' AS service, 'M' AS method, CASE WHEN s_suppkey % 4 < 3 THEN 'w' || (s_suppkey % 4) END AS wiring_name, CASE s_suppkey % 4 WHEN 0 THEN 'database' WHEN 1 THEN 'service' ELSE 'method' END AS kind FROM supplier")
def call_targets(spark, d):
    """Calls as database, service or method calls, through the field they are made on."""
    calls = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("svc").alias("service"), text("f", F.col("s_suppkey") % 4).alias("field"), F.lit("M").alias("method"))
    fields = spark.createDataFrame([("svc", f"f{i}", f"w{i}") for i in range(3)], "service string, field string, wiring_name string")
    dbs, services = spark.createDataFrame([("w0",)], "db string"), spark.createDataFrame([("w1",)], "service string")
    return wiring.call_targets(calls, fields, dbs, services).select("id", "service", "method", "wiring_name", "kind")


_METHOD_VALUES = "(VALUES ('Queue', 'Push', 'write'), ('Queue', 'Pop', 'read'), ('Cache', 'Get', 'read'), ('Cache', 'Mget', 'read_many'), ('RelationalDB', 'Exec', 'write'), ('NoSQLDatabase', 'FindOne', 'read'), ('NoSQLDatabase', 'Upsert', 'update'), ('NoSQLDatabase', 'DeleteMany', 'delete')) v(kind, method, op)"


@query("datastore_calls", f"SELECT l_orderkey, l_linenumber, kind, method, op FROM lineitem JOIN (SELECT *, row_number() OVER () - 1 AS i FROM {_METHOD_VALUES}) ON l_partkey % 10 = i")
def datastore_calls(spark, d):
    """Operations of datastore calls by the method catalogue and the live methods; other calls are none."""
    asked = (("Queue", "Push"), ("Queue", "Pop"), ("Cache", "Get"), ("Cache", "Mget"), ("RelationalDB", "Exec"), ("NoSQLDatabase", "FindOne"), ("NoSQLDatabase", "Upsert"), ("NoSQLDatabase", "DeleteMany"), ("NoSQLDatabase", "Drop"), ("Cache", "Push"))
    at = (F.col("l_partkey") % 10 + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(x[i]) for x in asked)), at)
    return wiring.datastore_calls(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", pick(0).alias("kind"), pick(1).alias("method"))).select("l_orderkey", "l_linenumber", "kind", "method", "op")


@query("fact_files", "SELECT 'app' AS app, CAST(s_suppkey % 20 AS INT) AS req, s_name AS entry FROM supplier")
def fact_files(spark, d):
    """A fact table written as JSON lines and read by its declared schema."""
    folder = scratch_path(spark, "facts")
    table(spark, d, "supplier").select(F.lit("app").alias("app"), (F.col("s_suppkey") % 20).cast("int").alias("req"), F.col("s_name").alias("entry")).write.json(f"{folder}/request.json")
    return files.read_facts(spark, folder, "request", "json")


@query("app_json", f"""WITH {_METHOD}, s AS (SELECT service, list(method ORDER BY method) AS methods FROM m GROUP BY service),
    d AS (SELECT list({{'db': 'd' || n_nationkey, 'kind': 'Cache'}} ORDER BY 'd' || n_nationkey) AS databases FROM nation)
    SELECT 'app' AS app, CAST(to_json({{'app': 'app', 'services': (SELECT list({{'service': service, 'deps': ['dep' || substr(service, 2), 'dep' || (CAST(substr(service, 2) AS INT) + 1)], 'fields': ['fa' || substr(service, 2), 'fb'], 'methods': methods}} ORDER BY service) FROM s), 'databases': databases}}) AS VARCHAR) AS value FROM d""")
def app_json(spark, d):
    """The application document, written and read back."""
    dbs = table(spark, d, "nation").select(F.lit("app").alias("app"), text("d", F.col("n_nationkey")).alias("db"), F.lit("Cache").alias("kind"))
    path = _written(writers.app_json(_services(spark, d), dbs).select("value"), "app.json")
    return spark.read.text(path).select(F.get_json_object("value", "$.app").alias("app"), "value")


@query("schema_documents", f"""WITH {_FK}, f AS (SELECT db, 'c' AS schema, list(DISTINCT field ORDER BY field) AS fields FROM ops GROUP BY db),
    c AS (SELECT src_db AS db, list('FOREIGN_KEY ' || src || ' REFERENCES ' || dst ORDER BY 'FOREIGN_KEY ' || src || ' REFERENCES ' || dst) AS constraints FROM fk GROUP BY src_db)
    SELECT f.db, f.schema, CAST(to_json({{'db': f.db, 'schema': f.schema, 'fields': fields, 'constraints': coalesce(constraints, [])}}) AS VARCHAR) AS value FROM f LEFT JOIN c ON f.db = c.db""")
def schema_documents(spark, d):
    """Fields and constraints of each schema, written as JSON and read back."""
    fields = ops_of(spark, d).select(F.lit("app").alias("app"), "db", F.lit("c").alias("schema"), F.col("field").alias("path")).distinct()
    constraints = staged_refs_of(spark, d).select(F.lit("app").alias("app"), F.lit("FOREIGN_KEY").alias("type"), F.array("src", "dst").alias("fields"))
    path = _written(writers.schema_document(fields, constraints).select("value"), "schema.json")
    return spark.read.text(path).select(F.get_json_object("value", "$.db").alias("db"), F.get_json_object("value", "$.schema").alias("schema"), "value")


_NODES = "nodes AS (SELECT 'S' || r_regionkey AS node, 'box' AS shape FROM region UNION ALL SELECT 'db ' || n_nationkey, 'cylinder' FROM nation)"
for _detailed, _name in ((False, "call_graph_dot"), (True, "call_graph_dot_detailed")):

    @query(_name, f"""WITH {_NODES} SELECT 'digraph G {{' AS value UNION ALL SELECT '}}' UNION ALL SELECT '  ' || replace(node, ' ', '_') || ' [label="' || node || '", shape=' || shape || '];' FROM nodes
        UNION ALL SELECT '  S' || n_regionkey || ' -> db_' || n_nationkey || ' [label="' || n_name || '{" [write]" if _detailed else ""}"];' FROM nation""")
    def _dot(spark, d, detailed=_detailed):
        """The call graph as DOT, written and read back."""
        n = table(spark, d, "nation")
        nodes = table(spark, d, "region").select(text("S", F.col("r_regionkey")).alias("node"), F.lit("SERVICE").alias("kind")).unionByName(n.select(text("db ", F.col("n_nationkey")).alias("node"), F.lit("DATABASE").alias("kind")))
        edges = n.select(text("S", F.col("n_regionkey")).alias("src"), text("db ", F.col("n_nationkey")).alias("dst"), F.col("n_name").alias("method"), F.lit("write").alias("op"), F.col("n_nationkey").alias("ord"))
        return spark.read.text(_written(writers.call_graph_dot(nodes, edges, detailed), "calls.dot"))


@query("value_graph_dot", """SELECT 'digraph G {' AS value UNION ALL SELECT '}' UNION ALL SELECT '  t' || p_partkey || '_x [label="t' || p_partkey || ' x", shape=box];' FROM part
    UNION ALL SELECT '  t' || p_partkey || ' -> t' || (p_partkey + 1) || ' [label="FIELD"];' FROM part WHERE p_partkey % 10 <> 9""")
def value_graph_dot(spark, d):
    """The value graph as DOT, written and read back."""
    key = F.col("p_partkey")
    p = table(spark, d, "part")
    edges = p.where(key % 10 != 9).select(text("t", key).alias("src"), text("t", key + 1).alias("dst"), F.lit("FIELD").alias("etype"), key.alias("ord"))
    path = _written(writers.value_graph_dot(p.select(text("t", key).alias("id"), F.lit("x").alias("name")), edges), "values.dot")
    return spark.read.text(path)


@query("value_graph_text", """SELECT 'f' || (p_partkey // 10) AS fn, row_number() OVER (PARTITION BY p_partkey // 10 ORDER BY 't' || p_partkey) AS n,
    't' || p_partkey || ' = Call' || CASE WHEN p_partkey % 10 <> 9 THEN ': FIELD -> t' || (p_partkey + 1) || ', INDEX -> t0' ELSE '' END AS line FROM part""")
def value_graph_text(spark, d):
    """The text of every function's value graph."""
    key = F.col("p_partkey")
    p = table(spark, d, "part").withColumn("fn", text("f", F.floor(key / 10)))
    nodes = p.select("fn", text("t", key).alias("id"), F.lit("Call").alias("kind"))
    e = p.where(key % 10 != 9)
    edges = e.select("fn", text("t", key).alias("src"), F.lit(1).alias("ord"), F.lit("FIELD").alias("etype"), text("t", key + 1).alias("dst")).unionByName(e.select("fn", text("t", key).alias("src"), F.lit(2).alias("ord"), F.lit("INDEX").alias("etype"), F.lit("t0").alias("dst")))
    return writers.value_graph_text(nodes, edges)


@query("metrics_file", f"""WITH RECURSIVE {_GRAPH} SELECT 'app: tables' AS value UNION ALL SELECT 'callgraphs: ' || count(DISTINCT n_regionkey) FROM nation UNION ALL SELECT 'ds_count: ' || count(DISTINCT dst) FROM reached WHERE etype = 'database'
    UNION ALL SELECT 'dbaccesses: ' || count(*) FROM reached WHERE etype = 'database' UNION ALL SELECT 'rpcs: ' || count(*) FROM reached WHERE etype = 'service' UNION ALL SELECT 'ms_count: ' || count(DISTINCT src) FROM reached""")
def metrics_file(spark, d):
    """Counters of the abstract graph, observed while it is written, and times of the phases, as YAML, written and read back; times differ from run to run and are left out here."""
    metrics = writers.Metrics()
    entries, calls = graph_input(spark, d)
    with metrics.timed("parsing"):
        edges = metrics.observed(taints.abstract_graph(entries, calls), "graph", rpcs=F.count_if(F.col("etype") == "service"), dbaccesses=F.count_if(F.col("etype") == "database"))
        staged = stage(edges, "abstract-graph")
    metrics.count("callgraphs", entries.count())
    metrics.count("ms_count", staged.select("src").distinct().count())
    metrics.count("ds_count", staged.where("etype = 'database'").select("dst").distinct().count())
    path = scratch_path(spark, "metrics.yaml")
    metrics.write(spark, path, app="tables")
    return spark.read.text(path).where(~F.rlike("value", F.lit("_s: ")))


@query("cascade_report", f"""WITH {_CASCADE}, x AS (SELECT *, row_number() OVER (ORDER BY req, seq, pending_db) AS n FROM cascades)
    SELECT n, 'delete ' || req || '.' || seq || ': ' || db || chr(9) || 'missing cascade #' || n || ': database={{' || pending_db || '}}, pending_fields={{' || fields || '}}' AS line FROM x""")
def cascade_report(spark, d):
    """The report of missing cascades."""
    return writers.cascade_report(detectors.missing_cascades(*daily_ops_and_refs_of(spark, d)))


@query("race_report", f"""WITH {_FK}, {_RACES}, x AS (SELECT *, row_number() OVER (ORDER BY req, event_id, db) AS n FROM races)
    SELECT n, 'delete #' || n || ': ' || req || '.' || event_id || ', database={{' || db || '}}, writes=' || n_writes || ', written_fields={{' || fields || '}}' AS line FROM x""")
def race_report(spark, d):
    """The report of deletes that race with writes."""
    return writers.race_report(detectors.dangerous_deletes(*ops_and_refs_of(spark, d)))


for _primary, _name, _kept in ((False, "fk_report", "NOT both_pk AND (fresh_a OR fresh_b)"), (True, "pk_report", "both_pk AND CASE WHEN a_exists THEN fresh_a ELSE fresh_b END")):

    @query(_name, f"""WITH {_COORD}, x AS (SELECT *, row_number() OVER (ORDER BY req, e1, e2, f1, f2) AS n FROM cf WHERE {_kept})
        SELECT n, '{"PRIMARY" if _primary else "FOREIGN"} KEY READS #' || n || ': request ' || req || ', READ ' || e1 || ': ' || f1 || ', READ ' || e2 || ': ' || f2 AS line FROM x""")
    def _coordination(spark, d, primary=_primary):
        """The report of uncoordinated reads."""
        return writers.coordination_report(detectors.key_coordination(*ops_refs_votes_of(spark, d), primary), primary)


@query("unique_report", f"""WITH {_UNIQUE}, x AS (SELECT *, row_number() OVER (ORDER BY req, event_id) AS n FROM uniq)
    SELECT 'added' AS status, 'write #' || n || ': ' || req || '.' || event_id || ', field (constrained): ' || field || ' (UNIQUE), affected writes=' || n_affected AS line FROM x""")
def unique_report(spark, d):
    """The report of conflicting unique writes, written; against no earlier report every line is new."""
    return writers.write_report(writers.unique_report(detectors.unique_conflicts(ops_of(spark, d))), scratch_path(spark, "unique.txt"))


def _report_sql(kept: str, name: str) -> str:
    """Lines of the five reports over the findings that ``kept`` holds for."""
    of = {
        "cascade": ("cascades", "req, seq, pending_db", "'delete ' || req || '.' || seq || ': ' || db || chr(9) || 'missing cascade #' || n || ': database={' || pending_db || '}, pending_fields={' || fields || '}'"),
        "race": ("races", "req, event_id, db", "'delete #' || n || ': ' || req || '.' || event_id || ', database={' || db || '}, writes=' || n_writes || ', written_fields={' || fields || '}'"),
        "foreign": ("(SELECT * FROM cf WHERE NOT both_pk AND (fresh_a OR fresh_b))", "req, e1, e2, f1, f2", "'FOREIGN KEY READS #' || n || ': request ' || req || ', READ ' || e1 || ': ' || f1 || ', READ ' || e2 || ': ' || f2"),
        "primary": ("(SELECT * FROM cf WHERE both_pk AND CASE WHEN a_exists THEN fresh_a ELSE fresh_b END)", "req, e1, e2, f1, f2", "'PRIMARY KEY READS #' || n || ': request ' || req || ', READ ' || e1 || ': ' || f1 || ', READ ' || e2 || ': ' || f2"),
        "unique": ("uniq", "req, event_id", "'write #' || n || ': ' || req || '.' || event_id || ', field (constrained): ' || field || ' (UNIQUE), affected writes=' || n_affected"),
    }
    parts = [f"SELECT '{k}' AS report, {line} AS line FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS n FROM {source} x WHERE {kept})" for k, (source, order, line) in of.items()]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


@query("report_statuses", f"""WITH {_CASCADE}, {_COORD.removeprefix(_FK + ', ')}, {_UNIQUE.removeprefix(_OPS + ', ')}, {_RACES}, {_report_sql("true", "new")}, {_report_sql("req % 3 > 0", "old")}
    SELECT report, status, count(*) AS n FROM (SELECT 'added' AS status, * FROM (SELECT * FROM new EXCEPT ALL SELECT * FROM old) UNION ALL SELECT 'removed', * FROM (SELECT * FROM old EXCEPT ALL SELECT * FROM new)
        UNION ALL SELECT 'unmodified', * FROM (SELECT * FROM new INTERSECT ALL SELECT * FROM old)) GROUP BY ALL""")
def report_statuses(spark, d):
    """All five reports written, and what each changes in the one before; then, a third of the requests had not been seen."""
    ops, refs, votes = ops_refs_votes_of(spark, d)
    findings = {
        "cascade": detectors.missing_cascades(stage(daily_ops_of(spark, d), "daily-operations"), refs), "race": detectors.dangerous_deletes(ops, refs), "foreign": detectors.key_coordination(ops, refs, votes, False),
        "primary": detectors.key_coordination(ops, refs, votes, True), "unique": detectors.unique_conflicts(ops),
    }
    findings = {k: stage(f, f"findings-{k}") for k, f in findings.items()}
    folder = scratch_path(spark, "reports")
    writers.save_reports({k: f.where("req % 3 > 0") for k, f in findings.items()}, f"{folder}/earlier")
    saved = writers.save_reports(findings, f"{folder}/now", f"{folder}/earlier")
    return saved.groupBy("report", "status").agg(F.count(F.lit(1)).alias("n"))


_CALLED = "'Svc' || (req % 7) || '.Handle' || (req % 11) AS entry, 'Svc' || (req % 7) || '.M.t' || event_id AS call"


@query("report_order", f"""WITH {_UNIQUE}, e AS (SELECT *, {_CALLED} FROM uniq), x AS (SELECT *, row_number() OVER (ORDER BY entry, call, req, event_id) AS n FROM e)
    SELECT n, 'write #' || n || ': ' || req || '.' || event_id || ', field (constrained): ' || field || ' (UNIQUE), affected writes=' || n_affected AS line FROM x""")
def report_order(spark, d):
    """A report in the order of entries and call strings."""
    ops = ops_of(spark, d)
    service = text("Svc", F.col("req") % 7)
    requests = ops.select("req").distinct().select("req", F.concat(service, text(".Handle", F.col("req") % 11)).alias("entry"))
    calls = ops.select("event_id", F.concat(service, text(".M.t", F.col("event_id"))).alias("call"))
    return writers.unique_report(writers.with_entries(detectors.unique_conflicts(ops), requests, calls))


@query("call_names", """SELECT s_suppkey, 'S.M.t' || s_suppkey AS call_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -1 END AS number, 'store' || s_suppkey AS store, 'topic' || s_nationkey AS literal, 'i' || md5('f|' || s_suppkey) AS instruction,
    CASE WHEN s_suppkey % 2 = 0 THEN 'reviews' ELSE '*' END AS namespace, 'a\\"b' || s_suppkey || '\\nc' AS label, 'a_b_' || s_suppkey AS dot_id FROM supplier""")
def call_names(spark, d):
    """Ids and names of calls, clients, literals, cache keys and DOT nodes."""
    key = F.col("s_suppkey")
    edge = F.when(key % 2 == 0, text("Svc.M.t", key)).otherwise(text("client", key))
    cache = F.when(key % 2 == 0, text("id", key, ":reviews")).otherwise(text("id", key))
    return table(spark, d, "supplier").select(
        "s_suppkey", names.call_id(F.lit("S"), F.lit("M"), key).alias("call_id"), names.edge_number(edge).cast("long").alias("number"), names.strip_client(text("store", key, ".client")).alias("store"),
        names.string_literal(text('"topic', F.col("s_nationkey"), '"')).alias("literal"), names.instruction_id(F.lit("f"), key.cast("string")).alias("instruction"), paths.cache_namespace(cache).alias("namespace"),
        names.dot_label(text('a"b', key, "\nc")).alias("label"), names.dot_id(text("a-b.", key)).alias("dot_id"),
    )


@query("display_labels", f"WITH {_OPS} SELECT event_id, 'UNIQUE (' || field || ', ' || field || '2)' AS uniq, 'PRIMARY (' || field || ')' AS prim, 'FOREIGN_KEY ' || field || ' REFERENCES ' || db || '.c.f0' AS ref, 'S -> ' || db || '.M' AS edge, CASE WHEN k % 3 = 0 THEN field || ' (PRIMARY, UNIQUE)' ELSE field END AS label FROM ops")
def display_labels(spark, d):
    """Display strings of constraints, edges and fields."""
    f = F.col("field")
    kinds = F.when(F.col("k") % 3 == 0, F.array(F.lit("UNIQUE"), F.lit("PRIMARY"))).otherwise(F.array().cast("array<string>"))
    return ops_of(spark, d).select(
        "event_id", names.constraint_label(F.lit("UNIQUE"), F.array(f, F.concat(f, F.lit("2")))).alias("uniq"), names.constraint_label(F.lit("PRIMARY"), F.array(f)).alias("prim"),
        names.constraint_label(F.lit("FOREIGN_KEY"), F.array(f, F.concat("db", F.lit(".c.f0")))).alias("ref"), names.edge_label(F.lit("S"), F.col("db"), F.lit("M")).alias("edge"), names.field_label(f, kinds).alias("label"),
    )


@query("object_annotations", f"WITH {_OPS} SELECT req, k % 4 AS part, string_agg('_obj' || (k % 2) || ': ' || op || ' ' || field, '; ' ORDER BY '_obj' || (k % 2), seq, field, op) AS lines FROM ops GROUP BY req, k % 4")
def object_annotations(spark, d):
    """Lines of objects' taints, by path, then program order."""
    # One object per request and part: at most the operations of a request, as the reports need them in one text.
    row = F.struct(text("_obj", F.col("k") % 2).alias("path"), F.array(F.col("seq").cast("int")).alias("t"), F.col("field").alias("fieldpath"), "op")
    grouped = ops_of(spark, d).groupBy("req", (F.col("k") % 4).alias("part")).agg(F.collect_list(row).alias("taints"))
    return grouped.select("req", "part", F.array_join(names.taint_annotations(F.col("taints")), "; ").alias("lines"))


@query("field_key_predicates", f"""WITH {_FK}, u AS (SELECT DISTINCT field, CAST(regexp_extract(field, 'f([0-9]+)$', 1) AS INT) AS n FROM ops)
    SELECT field, EXISTS (SELECT 1 FROM fk WHERE dst = field) AS referenced, EXISTS (SELECT 1 FROM fk WHERE src = field AND dst_db = 'db1') AS fk_to_db1, EXISTS (SELECT 1 FROM fk WHERE src = field AND dst_db = 'db1' AND NOT mandatory) AS optional_to_db1,
           n % 5 = 0 AS single_primary, n % 5 = 0 OR n % 3 = 0 AS unique_or_primary, n % 3 = 0 AND n % 5 <> 0 AS unique_only FROM u""")
def field_key_predicates(spark, d):
    """Predicates of fields on references to a schema and on keys of one column."""
    f = ops_of(spark, d).select("field").distinct()
    refs = detectors.with_databases(staged_refs_of(spark, d))
    out = refs.groupBy(F.col("src").alias("field")).agg(F.bool_or(F.col("dst_db") == "db1").alias("fk_to_db1"), F.bool_or((F.col("dst_db") == "db1") & ~F.col("mandatory")).alias("optional_to_db1"))
    into = refs.select(F.col("dst").alias("field"), F.lit(True).alias("referenced")).distinct()
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    key = F.col("field")
    return f.join(into, "field", "left").join(out, "field", "left").select("field", no("referenced"), no("fk_to_db1"), no("optional_to_db1"), is_primary(key).alias("single_primary"), (is_primary(key) | is_unique(key)).alias("unique_or_primary"), is_unique(key).alias("unique_only"))


@query("first_operation_pairs", f"""WITH {_OPS}, p AS (SELECT a.req, least(a.event_id, b.event_id) AS lo, greatest(a.event_id, b.event_id) AS hi, a.obj FROM ops a JOIN ops b ON a.req = b.req AND a.obj = b.obj AND a.event_id <> b.event_id WHERE a.op = 'R' AND b.op = 'R')
    SELECT req, lo, hi, min(obj) AS obj FROM p GROUP BY req, lo, hi""")
def first_operation_pairs(spark, d):
    """Each unordered pair of reads once, whichever comes first."""
    return references.unordered_pairs(ops_of(spark, d).where("op = 'R'"))


@query("fact_schemas", f"WITH {_OPS} SELECT 'events' AS app, CAST(req AS INT) AS req, CAST(NULL AS INT) AS req_idx, CAST(seq AS INT) AS seq, CAST(NULL AS VARCHAR) AS edge_id, op, db, split_part(field, '.', 2) AS schema FROM ops")
def fact_schemas(spark, d):
    """Operations as the fact table of that name, by its declared schema."""
    return files.as_facts(ops_of(spark, d).select(F.lit("events").alias("app"), "req", "seq", "op", "db", paths.schema_name(F.col("field")).alias("schema"), "event_id"), "op")
