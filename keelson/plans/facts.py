"""Fact tables: schemas, and the adapter that derives operation facts from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import keyed_row_number

#: Every fact table by name, as a DDL string.
SCHEMAS = {
    "database": "app string, db string, kind string",
    "schema": "app string, db string, schema string",
    "field": "app string, path string, db string, schema string, name string",
    "constraint": "app string, cid string, type string, fields array<string>, transitive boolean",
    "constraint_vote": "app string, cid string, req int, mandatory boolean",
    "acg_node": "app string, node string, kind string, service string, method string, db string, schema string",
    "acg_edge": "app string, ord int, edge_id string, etype string, src string, dst string, method string, op string, t array<int>",
    "acg_obj": "app string, obj_id string, owner_kind string, owner string, pos int, name string",
    "taint": "app string, obj_id string, objpath string, t array<int>, fieldpath string, call_id string, op string, primary boolean, traced boolean, read_key boolean, read_val boolean",
    "trace": "app string, obj_id string, objpath string, t array<int>, svpath string, sv_call_id string",
    "request": "app string, req int, entry string",
    "op": "app string, req int, req_idx int, seq int, edge_id string, op string, db string, schema string",
    "ignore_cascade": "app string, db string, entity string, trigger_db string, trigger_entity string",
    "ssa_node": "fn string, id string, name string, kind string, used_in_bson boolean",
    "ssa_edge": "fn string, ord int, etype string, src string, dst string, index int, param string",
    "ssa_taint": "fn string, id string, objpath string, fieldpath string, call_id string, op string, kind string",
}

#: Fixed values of the event adapter.
FIELDS, DATABASES, QUEUE_DB = 24, 6, "db5"


def operation_facts(events: DataFrame, daily: bool = False, ranged: bool = False) -> DataFrame:
    """One operation per event: a user's events are one request, in time order; with ``daily`` those of one day are.

    With ``ranged`` operations are numbered by ranges, so that a user with very many events is no single task; without it by one window over a user.

    click reads by key, view reads a value, purchase writes, signup updates, error deletes; ``k`` of the properties chooses database and
    field, and events of one whole value act on one object.
    """
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    op = F.when(kind.isin("click", "view"), "R").when(kind == "purchase", "W").when(kind == "signup", "U").when(kind == "error", "D")
    db = F.concat(F.lit("db"), (k % DATABASES).cast("string"))
    req = F.col("user_id") * 100_000 + F.unix_date(F.to_date("ts")) if daily else F.col("user_id")
    placed = events.withColumn("req", req)
    if ranged:
        placed = keyed_row_number(placed.select("req", "ts", "event_id", "event_type", "props", "value"), "seq", "req", "ts", "event_id")
    else:
        placed = placed.withColumn("seq", F.row_number().over(Window.partitionBy("req").orderBy("ts", "event_id")).cast("long"))
    return placed.select(
        "req", "seq", "event_id", op.alias("op"), (kind == "click").alias("rk"), (kind == "view").alias("rv"),
        k.alias("k"), db.alias("db"), F.concat(db, F.lit(".c.f"), (k % FIELDS).cast("string")).alias("field"), F.floor("value").cast("long").alias("obj"),
    )


def field_number(field):
    """Number at the end of a field path of the adapter."""
    return F.regexp_extract(field, r"f(\d+)$", 1).cast("int")


def is_primary(field):
    """Every fifth field of the adapter is a single-column primary key."""
    return field_number(field) % 5 == 0


def is_unique(field):
    """Every third field that is no primary key is unique."""
    return (field_number(field) % 3 == 0) & (field_number(field) % 5 != 0)


def is_queue(db):
    return db == QUEUE_DB
