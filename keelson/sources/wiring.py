"""Deployment wiring as facts, and the catalogue of datastore methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Client type -> datastore kind.
STORE_KINDS = {"Redis": "Cache", "Memcached": "Cache", "RabbitMQ": "Queue", "MongoDB": "NoSQLDatabase", "MySQL": "RelationalDB"}
#: (kind, method, operation, argument that is written or asked for, argument that receives what is read).
METHODS = [
    ("Queue", "Push", "write", 1, None), ("Queue", "Pop", "read", None, 1),
    ("Cache", "Put", "write", 2, None), ("Cache", "Get", "read", 1, 2), ("Cache", "Mget", "read_many", 1, 2),
    ("RelationalDB", "Select", "read", 2, 1), ("RelationalDB", "Get", "read", 2, 1), ("RelationalDB", "Exec", "write", 1, None),
    ("NoSQLDatabase", "InsertOne", "write", 1, None), ("NoSQLDatabase", "InsertMany", "write", 1, None),
    ("NoSQLDatabase", "FindOne", "read", 1, None), ("NoSQLDatabase", "FindMany", "read_many", 1, None),
    ("NoSQLDatabase", "UpdateOne", "update", 1, None), ("NoSQLDatabase", "UpdateMany", "update", 1, None), ("NoSQLDatabase", "ReplaceOne", "update", 1, None),
    ("NoSQLDatabase", "Upsert", "update", 1, None), ("NoSQLDatabase", "DeleteOne", "delete", 1, None), ("NoSQLDatabase", "DeleteMany", "delete", 1, None),
]
#: Methods that calls are recognised by; the catalogue lists more.
LIVE_METHODS = {
    "Queue": ("Push", "Pop"), "Cache": ("Put", "Get", "Mget"), "RelationalDB": ("Select", "Get", "Exec"),
    "NoSQLDatabase": ("InsertOne", "InsertMany", "FindOne", "FindMany", "UpdateOne", "UpdateMany", "ReplaceOne", "Upsert", "DeleteOne", "DeleteMany"),
}


def method_catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(METHODS, "kind string, method string, op string, key_arg int, value_arg int")


def live_methods(spark: SparkSession) -> DataFrame:
    """(kind, method) that calls of datastores are recognised by."""
    return spark.createDataFrame([(k, m) for k, ms in LIVE_METHODS.items() for m in ms], "kind string, method string")


def datastore_calls(calls: DataFrame) -> DataFrame:
    """Calls (kind, method, ...) of live methods, with the operation and the arguments of the catalogue."""
    spark = calls.sparkSession
    known = method_catalogue(spark).join(live_methods(spark), ["kind", "method"])
    return calls.join(F.broadcast(known), ["kind", "method"])  # one row per method of the catalogue


def lookups(services: DataFrame, wanted: DataFrame) -> DataFrame:
    """Services (service, impl_path, constructor) by any of their names: (name, service, found_by), the service's own name first, then path, then constructor."""
    by = [services.select(F.col(c).alias("name"), "service", F.lit(i).alias("rank"), F.lit(c).alias("found_by")) for i, c in enumerate(("service", "impl_path", "constructor"))]
    names = by[0].unionByName(by[1]).unionByName(by[2])
    first = wanted.select("name").distinct().join(names, "name").groupBy("name").agg(F.min(F.struct("rank", "service", "found_by")).alias("f"))
    return first.select("name", "f.service", "f.found_by")


def database_lookups(dbs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, kind, is_known) of the wanted names: the database of that name, if there is one."""
    known = dbs.groupBy(F.col("db").alias("name")).agg(F.min("kind").alias("kind")).withColumn("is_known", F.lit(True))
    return wanted.select("name").distinct().join(known, "name", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def deployed(nodes: DataFrame, args: DataFrame) -> dict[str, DataFrame]:
    """What a deployment tree holds: ``services`` (app, service, handler), ``arguments`` (app, service, pos, name, what), ``databases`` (app, db, kind), ``dependencies`` (app, service, dependency), ``frontends`` (app, service).

    ``nodes`` (app, id, parent, kind, name): services are the handlers in processes in containers; an address leads to an http server that wraps a handler, which is a frontend.  ``args``
    (app, handler, pos, type, name): clients of datastores, clients of services (``WorkflowClient``), values (``IRValue``); others are ``unknown``.  A service without arguments is one as well.
    """
    of = lambda kind, *cs: nodes.where(F.col("kind") == kind).select("app", *cs)
    containers = of("Container", F.col("id").alias("container"))
    processes = of("Process", F.col("id").alias("process"), F.col("parent").alias("container")).join(containers, ["app", "container"])
    handlers = of("WorkflowHandler", F.col("id").alias("handler"), F.col("parent").alias("process"), F.col("name").alias("service"))
    services = handlers.join(processes, ["app", "process"]).select("app", "service", "handler").distinct()
    servers = of("GolangHttpServer", F.col("id").alias("server"), F.col("parent").alias("address")).join(of("Address", F.col("id").alias("address")), ["app", "address"])
    frontends = servers.join(handlers.withColumnRenamed("process", "server"), ["app", "server"]).select("app", "service").distinct()
    what = F.coalesce(*(F.when(F.contains("type", F.lit(k)), F.lit("database")) for k in STORE_KINDS), F.when(F.contains("type", F.lit("WorkflowClient")), "service"), F.when(F.contains("type", F.lit("IRValue")), "value"), F.lit("unknown"))
    arguments = args.join(services, ["app", "handler"]).select("app", "service", "pos", "name", what.alias("what"), "type")
    found = databases(arguments.where("what = 'database'").select("app", "name", F.col("type").alias("client_type")))
    needs = arguments.where("what = 'service'").select("app", "service", F.col("name").alias("dependency")).distinct()
    return {"services": services, "arguments": arguments.drop("type"), "databases": found, "dependencies": needs, "frontends": frontends}


def databases(clients: DataFrame) -> DataFrame:
    """(app, db, kind) from client instances (app, name, client_type)."""
    kind = F.coalesce(*(F.when(F.contains("client_type", F.lit(k)), F.lit(v)) for k, v in STORE_KINDS.items()))
    return clients.select("app", F.substring_index("name", ".", 1).alias("db"), kind.alias("kind")).where("kind IS NOT NULL").distinct()


def service_methods(services: DataFrame) -> DataFrame:
    return services.select("app", "service", F.posexplode("methods").alias("pos", "method"))


def service_dependencies(services: DataFrame) -> DataFrame:
    return services.select("app", "service", F.explode("deps").alias("dependency"))


def service_fields(services: DataFrame) -> DataFrame:
    return services.select("app", "service", F.posexplode("fields").alias("idx", "field"))


def entrypoints(frontends: DataFrame, services: DataFrame) -> DataFrame:
    """(app, entry): methods of services behind a frontend, as package.Service.Method, and every service's Run."""
    m = service_methods(services).join(services.select("app", "service", "package"), ["app", "service"])
    exposed = m.join(frontends.select("app", "service").distinct(), ["app", "service"], "left_semi").where("method <> 'Init'")
    return exposed.unionByName(m.where("method = 'Run'")).select("app", F.concat_ws(".", "package", "service", "method").alias("entry")).distinct()


def constructor_bindings(edges: DataFrame, wiring: DataFrame) -> DataFrame:
    """(service, field, wiring_name): a constructor stores its parameter into a field of the service.

    Three equi-joins over value-flow edges: the parameter is stored (STORE_VALUE) at an address (STORE_ADDRESS) that is a FIELD of the new service.
    """
    value = edges.where("etype = 'STORE_VALUE'").select("fn", F.col("src").alias("param"), F.col("dst").alias("store"))
    address = edges.where("etype = 'STORE_ADDRESS'").select("fn", F.col("src").alias("addr"), F.col("dst").alias("store"))
    fields = edges.where("etype = 'FIELD'").select("fn", F.col("dst").alias("addr"), F.col("param").alias("field"))
    bound = value.join(address, ["fn", "store"]).join(fields, ["fn", "addr"])
    return bound.join(wiring.select("fn", "param", "service", "wiring_name"), ["fn", "param"]).select("service", "field", "wiring_name")


def call_targets(calls: DataFrame, fields: DataFrame, dbs: DataFrame, services: DataFrame) -> DataFrame:
    """Calls (id, service, field, method) as database, service or method calls, tried in this order."""
    f = fields.select("service", "field", "wiring_name")
    c = calls.join(f, ["service", "field"], "left")
    d = dbs.select(F.col("db").alias("wiring_name"), F.lit(True).alias("is_db")).distinct()
    s = services.select(F.col("service").alias("wiring_name"), F.lit(True).alias("is_service")).distinct()
    kind = F.when(F.col("is_db"), "database").when(F.col("is_service"), "service").otherwise("method")
    return c.join(d, "wiring_name", "left").join(s, "wiring_name", "left").select("id", "service", "method", "wiring_name", kind.alias("kind"))
