"""Taints and traces of values and across calls: seeding, look-ups by place, matching traces to objects, merging, pushing new taints, combining
callees into callers, and the abstract graph of services that comes out of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import trace_argument, trace_object_path
from ..plans.config import AnalysisConfig
from ..plans.staging import input_tasks
from .graph import TAINT_KEYS, closure, earliest_arrivals, fixpoint, insert_new, prefix_pairs, propagate


#: Parts that the traces of one call and name are dealt into, arguments that a block of them lists on average, and tasks a core that rows are listed in.
TRACE_SALTS, ARGUMENT_BLOCK, LISTING_TASKS = 32, 512, 4


def argument_blocks(args: DataFrame) -> DataFrame:
    """Arguments (call_id, name, obj_id) of each call and name in blocks (call_id, name, _targets) of one size, so a block holds no more where a name has more of them; equal ones share a block.

    Arguments without call or name are left out.
    """
    known = args.where("call_id IS NOT NULL AND name IS NOT NULL").select("call_id", "name", F.col("obj_id").alias("target"))
    sizes = known.groupBy("call_id", "name").agg(F.ceil(F.count("*") / ARGUMENT_BLOCK).alias("_blocks"))
    block = F.pmod(F.xxhash64("target"), F.col("_blocks"))
    return known.join(sizes, ["call_id", "name"]).groupBy("call_id", "name", block.alias("_block")).agg(F.collect_list(F.struct("target")).alias("_targets")).drop("_block")


def traces_to_arguments(traces: DataFrame, args: DataFrame) -> DataFrame:
    """Traces (sv_call_id, svpath, ...) with the argument (call_id, name, obj_id) of another call that they name: call and argument name agree.

    A call and name may have very many traces and arguments, and each trace meets all of the latter: traces are dealt out below their key, and meet blocks of arguments that are listed after the join.
    Few bytes give very many rows here, so there is a number of tasks, not what the planner makes of the bytes.  The key is a struct, which is never null: a test for nulls would work out the paths again below the traces.
    """
    tasks = LISTING_TASKS * input_tasks(traces.sparkSession)
    salt = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in traces.columns)), F.lit(TRACE_SALTS))
    key = lambda call, name, part: F.struct(F.col(call).alias("call"), name.alias("name"), part.alias("part")).cast("struct<call:string,name:string,part:int>")
    named = traces.withColumns({"at": trace_object_path(F.col("svpath")), "_salted": key("sv_call_id", trace_argument(F.col("svpath")), salt)})
    blocks = argument_blocks(args).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(TRACE_SALTS - 1))))
    dealt = blocks.select(key("call_id", F.col("name"), F.col("_part")).alias("_salted"), "_targets")
    met = named.repartition(tasks, "_salted").hint("merge").join(dealt.repartition(tasks, "_salted"), "_salted")
    return met.select(*(F.col(f"`{c}`") for c in traces.columns), "at", F.inline("_targets"))


def traces_to_traces(traces: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of objects (obj_id, target) whose traces have the same call and service path.

    Equal rows of both sides are met once: only pairs of different objects are listed.
    """
    t = traces.select("obj_id", "sv_call_id", "svpath").distinct()
    o = others.select(F.col("obj_id").alias("target"), "sv_call_id", "svpath").distinct()
    return t.join(o, ["sv_call_id", "svpath"]).where("obj_id <> target").select("obj_id", "target").distinct()


def union_of_traces(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def push_taints(taints: DataFrame, new: DataFrame, targets: DataFrame) -> DataFrame:
    """``taints`` with those of ``new`` written onto their targets (obj_id, target, at), secondary there, if not present.

    What lies below ``at`` keeps its remaining path.
    """
    t = targets.select(F.col("obj_id").alias("o"), "target", "at").distinct()
    moved = new.join(t, F.col("obj_id") == F.col("o"))
    path = F.concat(F.col("at"), F.substring(F.col("objpath"), F.lit(5), F.length("objpath")))
    moved = moved.withColumns({"obj_id": F.col("target"), "objpath": path, "primary": F.lit(False), "traced": F.lit(True)}).select(*taints.columns)
    return insert_new(taints, moved, ("obj_id", "objpath", "fieldpath", "call_id", "op"))


def ordered_union(first: DataFrame, second: DataFrame, prepend: bool = False) -> DataFrame:
    """Pairs of two ordered tables (ord, ...): those of the second after, or before, all of the first."""
    side = -1 if prepend else 1
    tag = lambda df, s: df.withColumn("ord", F.struct(F.lit(s).alias("part"), F.col("ord").alias("pos")))
    return tag(first, 0).unionByName(tag(second, side))


def later_edges(edges: DataFrame) -> DataFrame:
    """For each edge the later ones of its node: (edge_id, later_id)."""
    l = edges.select("src", F.col("edge_id").alias("later_id"), F.col("ord").alias("_later"))  # noqa: E741
    return edges.join(l, "src").where("_later > ord").select("edge_id", "later_id")


def combine_calls(calls: DataFrame, taints: DataFrame, edges: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Taints (fn, obj, objpath, fieldpath, stamp array<int>) seen from every caller.

    Calls map a callee's parameter or result to the caller's object: (caller, callee, site int, inner, outer).  A taint of ``inner`` becomes one of
    ``outer`` whose stamp begins with the call's, and spreads over the caller's value-flow ``edges`` (fn, etype, src, dst, segment, op) before it is seen from the caller's callers.  A callee is summarised once:
    of several call paths the shortest gives the stamp, of equal ones the first in program order, so that neither recursion nor layers of calls multiply rows.
    """
    at = lambda fn, obj: F.concat_ws("\u0001", F.col(fn).cast("string"), F.col(obj).cast("string"))
    seeds = taints.select(at("fn", "obj").alias("id"), "objpath", "fieldpath", "stamp")
    up = calls.select(at("callee", "inner").alias("inner"), at("caller", "outer").alias("outer"), "site")
    flows = edges if edges is not None else taints.sparkSession.createDataFrame([], "fn string, etype string, src string, dst string, segment string, op string")
    inside = flows.withColumns({"src": at("fn", "src"), "dst": at("fn", "dst")})
    found = propagate(inside, seeds, None if blocked is None else blocked.select(at("fn", "obj").alias("id")), up)
    where = F.split("id", "\u0001")
    return found.select(where[0].cast(taints.schema["fn"].dataType).alias("fn"), where[1].cast(taints.schema["obj"].dataType).alias("obj"), "objpath", "fieldpath", "stamp")


def primary_taints(taints: DataFrame, primary: bool = True) -> DataFrame:
    """Taints that belong to an object itself, or (``primary`` false) those it got from elsewhere."""
    return taints.where(F.col("primary") if primary else ~F.col("primary"))


def fields_of_calls(taints: DataFrame) -> DataFrame:
    """(call_id, fieldpath): the distinct fields that each datastore call touches."""
    return taints.select("call_id", "fieldpath").distinct()


def callee_parameters(params: DataFrame) -> DataFrame:
    """Parameters (callee, pos, ...) without receiver and context, numbered from 0."""
    return params.where("pos >= 2").withColumn("pos", F.col("pos") - 2)


def edges_of_kind(edges: DataFrame, *kinds: str) -> DataFrame:
    return edges.where(F.col("etype").isin(*kinds))


def taints_at_or_below(taints: DataFrame, places: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Taints of ``places`` (obj_id, place) and of all lower paths of the same object, with what the path adds (rest)."""
    p = places.select("obj_id", "place").distinct()
    pairs = prefix_pairs(p.select("place"), taints.select("objpath"), config).select(F.col("upper").alias("place"), F.col("lower").alias("objpath"))
    joined = taints.join(pairs, "objpath").join(p, ["obj_id", "place"])
    return joined.withColumn("rest", F.substring(F.col("objpath"), F.length("place") + 1, F.length("objpath")))


def taints_of_traced_places(taints: DataFrame, traced: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Taints written onto the places (obj_id, place) of their object that lie at or below them: the field path grows by the difference."""
    p = traced.select("obj_id", "place").distinct()
    pairs = prefix_pairs(taints.select("objpath"), p.select("place"), config).select(F.col("upper").alias("objpath"), F.col("lower").alias("place"))
    joined = taints.join(p.join(pairs, "place"), ["obj_id", "objpath"])
    return joined.withColumn("fieldpath", F.concat("fieldpath", F.substring(F.col("place"), F.length("objpath") + 1, F.length("place")))).withColumn("objpath", F.col("place")).drop("place")


def place_of_upper_taint(taints: DataFrame, wanted: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """For each of ``wanted`` (id, obj_id, fieldpath, call_id) the first place, by path, whose taint is the same or an upper one of the same call;
    below an upper taint the place goes on with the rest of the field path."""
    t = taints.select("obj_id", "objpath", F.col("fieldpath").alias("own"), "call_id")
    pairs = prefix_pairs(t.select("own"), wanted.select("fieldpath"), config).select(F.col("upper").alias("own"), F.col("lower").alias("fieldpath"))
    joined = wanted.join(pairs, "fieldpath").join(t, ["obj_id", "call_id", "own"])
    place = F.concat("objpath", F.substring(F.col("fieldpath"), F.length("own") + 1, F.length("fieldpath")))
    return joined.groupBy("id").agg(F.min(F.struct("objpath", place.alias("place"))).alias("first")).select("id", "first.place")


def specific_places_first(places: DataFrame) -> DataFrame:
    """Places (obj_id, place) with their rank in the object in reverse order of their paths: lower paths come before upper ones."""
    return places.select("obj_id", "place").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("obj_id").orderBy(F.desc("place"))).cast("long"))


def first_operation_of_call(ops: DataFrame) -> DataFrame:
    """The first operation of each call id in each request."""
    return ops.groupBy("req", "call_id").agg(F.min(F.struct("seq", "event_id", "op")).alias("o")).select("req", "call_id", "o.seq", "o.event_id", "o.op")


def callee_graphs(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """A copy of the callee's edges (fn, ...) for each call (caller, callee, site): ``context`` tells the copies apart."""
    e = edges.withColumnRenamed("fn", "callee")
    return calls.select("caller", "callee", "site").join(e, "callee").withColumn("context", F.concat_ws("@", "caller", F.col("site").cast("string"))).drop("caller", "site")


def references_to(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, src): all fields that reference a target."""
    return targets.select(F.col("path").alias("target")).distinct().join(refs, F.col("target") == F.col("dst")).select("target", "src")


def cursor_calls(collection_calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, call, cursor, cursor_call): calls on the cursor that a collection call (fn, call) returns as its first value."""
    first = edges_of_kind(edges, "EXTRACT").where("index = 0").select("fn", F.col("src").alias("call"), F.col("dst").alias("cursor"))
    later = edges_of_kind(edges, "RECEIVER_ON_CALL").select("fn", F.col("src").alias("cursor"), F.col("dst").alias("cursor_call"))
    return collection_calls.select("fn", "call").join(first, ["fn", "call"]).join(later, ["fn", "cursor"]).select("fn", "call", "cursor", "cursor_call")


def returned_values(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(fn, call, value): what a call (fn, call, results) returns: the extracted values of several, or the call itself."""
    e = edges_of_kind(edges, "EXTRACT").select("fn", F.col("src").alias("call"), F.col("dst").alias("extracted"))
    many = calls.where("results > 1").join(e, ["fn", "call"]).select("fn", "call", F.col("extracted").alias("value"))
    return many.unionByName(calls.where("results <= 1").select("fn", "call", F.col("call").alias("value")))


def merge_returns(returns: DataFrame) -> DataFrame:
    """Taints of all return tuples (node, tuple, pos, objpath, fieldpath, call_id, op) as those of one tuple: by position, the first tuple's first."""
    first = Window.partitionBy("node", "pos", "objpath", *TAINT_KEYS["similar"]).orderBy("tuple", "op")
    return returns.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "tuple")


def concatenate(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two taint maps with all their rows, equal ones too."""
    return first.unionByName(second)


def seed_taints(db_args: DataFrame, service_values: DataFrame) -> DataFrame:
    """Where propagation starts: (fn, id, objpath, fieldpath, call_id, op, kind).

    Values of datastore calls (fn, id, field, call_id, op, many) carry their field at the root, those that arrays were read into (``many``) at
    their elements.  Arguments and results of service calls (fn, id, call_id, name) carry the service path of the call.
    """
    d = db_args.select("fn", "id", F.when(F.col("many"), F.lit("_obj[*]")).otherwise(F.lit("_obj")).alias("objpath"), F.col("field").alias("fieldpath"), "call_id", "op", F.lit("database").alias("kind"))
    s = service_values.select("fn", "id", F.lit("_obj").alias("objpath"), F.concat_ws(".", "call_id", "name").alias("fieldpath"), "call_id", F.lit(None).cast("string").alias("op"), F.lit("service").alias("kind"))
    return d.unionByName(s).distinct()


def write_taints(new: DataFrame) -> DataFrame:
    """Taints (id, objpath, fieldpath, kind, mode) as a value gets them: nearby ones as they are; datastore taints fetched upwards with their object
    path behind the field path, whose root is rebuilt."""
    below = F.substring(F.col("objpath"), F.lit(5), F.length("objpath"))
    up = (F.col("mode") == "upwards") & (F.col("kind") == "database")
    return new.withColumn("fieldpath", F.when(up, F.concat("fieldpath", below)).otherwise(F.col("fieldpath"))).drop("mode").distinct()


def abstract_taints(ssa_taints: DataFrame) -> DataFrame:
    """Datastore taints of values as primary taints of objects (the value's id is the object's)."""
    d = ssa_taints.where("kind = 'database'")
    return d.select(F.concat_ws(".", "fn", "id").alias("obj_id"), "objpath", "fieldpath", "call_id", "op", F.lit(True).alias("primary"), F.lit(False).alias("traced")).distinct()


def abstract_traces(ssa_taints: DataFrame) -> DataFrame:
    """Service taints of values as traces of objects."""
    s = ssa_taints.where("kind = 'service'")
    return s.select(F.concat_ws(".", "fn", "id").alias("obj_id"), "objpath", F.col("fieldpath").alias("svpath"), F.col("call_id").alias("sv_call_id")).distinct()


def datastore_nodes(ssa_taints: DataFrame, known: DataFrame) -> DataFrame:
    """(db, schema, is_new): the nodes that datastore taints bring into the abstract graph, and whether their schema was unknown."""
    path = F.split("fieldpath", r"\.")
    seen = ssa_taints.where("kind = 'database'").select(path[0].alias("db"), F.try_element_at(path, F.lit(2)).alias("schema")).distinct()
    k = known.select("db", "schema").distinct().withColumn("_known", F.lit(True))
    return seen.join(k, ["db", "schema"], "left").select("db", "schema", F.col("_known").isNull().alias("is_new"))


def merge_taints(existing: DataFrame, incoming: DataFrame, mode: str) -> DataFrame:
    """``existing`` taints of objects and those of ``incoming`` that they lack; the mode tells what new ones are.

    ``parse``: taints of the object itself (primary); ``taint``: taken over from another object; ``trace``: taken over along a trace; ``debug``: nothing is
    written.  Equality is that of field path, call and operation at one place.
    """
    if mode not in ("parse", "taint", "trace", "debug"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "debug":
        return existing
    new = incoming.withColumns({"primary": F.lit(mode == "parse"), "traced": F.lit(mode == "trace")})
    return insert_new(existing, new, ("obj_id", "objpath", "fieldpath", "call_id", "op"))


def request_taints(taints: DataFrame, pairs: DataFrame, hops: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """Taints (req, obj_id, objpath, fieldpath, call_id, op, primary, at) of a request after its traversal.

    ``pairs`` (src, dst, time) are objects that stand for each other across calls, at the time when the walk hands taints on: from arguments to parameters before a callee is entered, from parameters and results to the
    caller's objects after it has been left.  A taint takes a pair only if it was there before that time, so what reaches a callee after it has been left stays there.  ``hops`` (src, dst, time) lead from arguments of a push
    to those of its pop; only primary taints take them, if ``propagate_across_queues``.  Requests start with primary taints, there from time 0: what they got from others does not outlive them.
    """
    columns = ("req", "obj_id", "objpath", "fieldpath", "call_id", "op")
    own = primary_taints(taints).select(*columns).distinct()
    seeds = own.withColumn("at", F.lit(0).cast("long"))
    if config.propagate_across_queues:
        over = own.join(hops.select(F.col("src").alias("obj_id"), "dst", F.col("time").cast("long").alias("at")).distinct(), "obj_id")
        seeds = seeds.unionByName(over.withColumn("obj_id", F.col("dst")).select(*columns, "at"))
    reached = earliest_arrivals(seeds, pairs, "at", "obj_id", "request-taints")
    return reached.join(own.withColumn("primary", F.lit(True)), list(columns), "left").withColumn("primary", F.coalesce("primary", F.lit(False)))


def abstract_graph(entries: DataFrame, calls: DataFrame) -> DataFrame:
    """Edges (src, dst, etype, call_id) of the abstract graph that entries (node) reach.

    ``calls`` (fn, call_id, callee, kind) are those of single functions; a call of a method of the same service is inlined: its calls become those of
    the function around it.  Nodes are shared per service method, edges are per call site.
    """
    inner = calls.where("kind = 'method'").select(F.col("fn").alias("src"), F.col("callee").alias("dst"))
    names = calls.select(F.col("fn").alias("src")).distinct()
    bodies = names.select("src", F.col("src").alias("fn")).unionByName(closure(inner).select("src", F.col("dst").alias("fn"))).distinct()
    outer = calls.where("kind <> 'method'").select("fn", "call_id", F.col("callee").alias("dst"), F.col("kind").alias("etype"))
    edges = bodies.join(outer, "fn").select("src", "dst", "etype", "call_id").distinct()
    rpc = edges.where("etype = 'service'").select(F.col("src").alias("node"), "dst")
    reached = fixpoint(entries.select("node"), lambda f: f.join(rpc, "node").select(F.col("dst").alias("node")), "abstract-nodes")
    return edges.join(reached, edges["src"] == reached["node"], "left_semi")
