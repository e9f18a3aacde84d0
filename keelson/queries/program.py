"""Queries over program facts: taints and traces of objects, value-flow graphs, calls.  The facts are derived from the tables, each with the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, paths
from ..operators import graph, references, taints
from ..plans.config import AnalysisConfig
from .integrity import _OPS, _PAIRS, counted_rules_of, ops_of, query, staged_refs_of, table
from .integrity import _FK as _REFS


def text(*parts) -> F.Column:
    """Parts joined as strings; plain strings are literals."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


#: Objects are those of a request and value; a third of the taints is their own.
_TAINT = """taint AS (
    SELECT req || ':' || obj AS obj_id, CASE k % 4 WHEN 0 THEN '_obj' WHEN 1 THEN '_obj.A' WHEN 2 THEN '_obj.A.B' ELSE '_obj.AC' END AS objpath, field AS fieldpath,
           'S' || (req % 7) || '.M.t' || (k % 9) AS call_id, op, event_id % 3 = 0 AS own, event_id, seq, req FROM ops
)"""


def taints_of(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    objpath = F.when(k % 4 == 0, "_obj").when(k % 4 == 1, "_obj.A").when(k % 4 == 2, "_obj.A.B").otherwise("_obj.AC")
    return ops_of(spark, d).select(
        text(F.col("req"), ":", F.col("obj")).alias("obj_id"), objpath.alias("objpath"), F.col("field").alias("fieldpath"), text("S", F.col("req") % 7, ".M.t", k % 9).alias("call_id"), "op",
        (F.col("event_id") % 3 == 0).alias("primary"), (F.col("event_id") % 5 == 0).alias("traced"), F.col("rk").alias("read_key"), F.col("rv").alias("read_val"), F.array(F.col("seq").cast("int")).alias("t"), "event_id", "seq", "req",
    )


@query("taint_origins", f"WITH {_OPS}, {_TAINT} SELECT call_id, own, count(*) AS n FROM taint GROUP BY call_id, own")
def taint_origins(spark, d):
    """Primary and secondary taints of each call."""
    t = taints_of(spark, d)
    both = taints.primary_taints(t).select("call_id", F.lit(True).alias("own")).unionByName(taints.primary_taints(t, False).select("call_id", F.lit(False).alias("own")))
    return both.groupBy("call_id", "own").agg(F.count(F.lit(1)).alias("n"))


@query("call_fields", f"WITH {_OPS}, {_TAINT} SELECT DISTINCT call_id, fieldpath FROM taint")
def call_fields(spark, d):
    """Fields that each call touches."""
    return taints.fields_of_calls(taints_of(spark, d))


@query("taint_equalities", f"""WITH {_OPS}, {_TAINT}, x AS (SELECT t.*, t.event_id % 5 = 0 AS traced, o.rk, o.rv FROM taint t JOIN ops o USING (event_id))
    SELECT 'similar' AS equality, count(DISTINCT (obj_id, objpath, fieldpath, call_id)) AS n FROM x UNION ALL SELECT 'except_read', count(DISTINCT (obj_id, objpath, fieldpath, call_id, op, own, traced)) FROM x
    UNION ALL SELECT 'except_primary', count(DISTINCT (obj_id, objpath, fieldpath, call_id, op, rk, rv)) FROM x""")
def taint_equalities(spark, d):
    """Taints that are left under each of the three equalities."""
    t = taints_of(spark, d)
    kept = [graph.distinct_taints(t, e).groupBy().agg(F.count(F.lit(1)).alias("n")).select(F.lit(e).alias("equality"), "n") for e in graph.TAINT_KEYS]
    return kept[0].unionAll(kept[1]).unionAll(kept[2])


@query("taint_places_below", f"""WITH {_OPS}, {_TAINT}, p AS (SELECT DISTINCT obj_id, objpath AS place FROM taint WHERE own)
    SELECT place, objpath, substr(objpath, length(place) + 1) AS rest, count(*) AS n FROM p JOIN taint USING (obj_id) WHERE starts_with(objpath, place) GROUP BY ALL""")
def taint_places_below(spark, d):
    """Taints at a place and at the lower paths of its object, raw prefixes."""
    t = taints_of(spark, d)
    places = t.where("primary").select("obj_id", F.col("objpath").alias("place"))
    return taints.taints_at_or_below(t, places).groupBy("place", "objpath", "rest").agg(F.count(F.lit(1)).alias("n"))


@query("taint_ancestors", f"""WITH {_OPS}, {_TAINT}, p AS (SELECT DISTINCT obj_id, objpath AS place FROM taint)
    SELECT p.obj_id, place, objpath, fieldpath || CASE WHEN place = objpath THEN '' ELSE regexp_extract(place, '(\\.[^.]*)$', 1) END AS fieldpath, call_id, event_id
    FROM p JOIN taint t ON p.obj_id = t.obj_id AND (place = objpath OR starts_with(place, objpath || '.'))""")
def taint_ancestors(spark, d):
    """Taints of upper paths seen from lower ones; the suffix is the last segment."""
    return graph.taints_of_ancestors(taints_of(spark, d)).select("obj_id", "place", "objpath", "fieldpath", "call_id", "event_id")


@query("taint_traced_places", f"""WITH {_OPS}, {_TAINT}, p AS (SELECT DISTINCT obj_id, objpath AS place FROM taint WHERE NOT own)
    SELECT t.obj_id, place AS objpath, fieldpath || substr(place, length(objpath) + 1) AS fieldpath, call_id, event_id FROM taint t JOIN p ON t.obj_id = p.obj_id AND starts_with(place, objpath) WHERE own""")
def taint_traced_places(spark, d):
    """Primary taints written onto the traced places at or below them; places with taints from elsewhere are traced."""
    t = taints_of(spark, d)
    traced = t.where("NOT primary").select("obj_id", F.col("objpath").alias("place"))
    return taints.taints_of_traced_places(t.where("primary"), traced).select("obj_id", "objpath", "fieldpath", "call_id", "event_id")


@query("taint_upper_place", f"""WITH {_OPS}, {_TAINT}, w AS (SELECT event_id AS id, obj_id, fieldpath || '.ID' AS fieldpath, call_id FROM taint WHERE NOT own)
    SELECT id, arg_min(place, (objpath, place)) AS place FROM (SELECT id, t.objpath, t.objpath || substr(w.fieldpath, length(t.fieldpath) + 1) AS place FROM w JOIN taint t ON w.obj_id = t.obj_id AND w.call_id = t.call_id AND starts_with(w.fieldpath, t.fieldpath)) GROUP BY id""")
def taint_upper_place(spark, d):
    """The first place that holds the same or an upper taint of a call."""
    t = taints_of(spark, d)
    wanted = t.where("NOT primary").select(F.col("event_id").alias("id"), "obj_id", F.concat("fieldpath", F.lit(".ID")).alias("fieldpath"), "call_id")
    return taints.place_of_upper_taint(t, wanted)


@query("places_specific_first", f"WITH {_OPS}, {_TAINT}, p AS (SELECT DISTINCT obj_id, objpath AS place FROM taint) SELECT obj_id, place, row_number() OVER (PARTITION BY obj_id ORDER BY place DESC) AS rank FROM p")
def places_specific_first(spark, d):
    """Places of objects, lower paths first."""
    return taints.specific_places_first(taints_of(spark, d).select("obj_id", F.col("objpath").alias("place")))


@query("call_first_operation", f"WITH {_OPS}, {_TAINT} SELECT req, call_id, min(seq) AS seq, arg_min(event_id, seq) AS event_id, arg_min(op, seq) AS op FROM taint GROUP BY req, call_id")
def call_first_operation(spark, d):
    """The first operation of each call in its request."""
    return taints.first_operation_of_call(taints_of(spark, d))


_MODES = {"parse": (True, False), "taint": (False, False), "trace": (False, True)}


@query("taint_merge_modes", f"WITH {_OPS}, {_TAINT}, e AS (SELECT DISTINCT obj_id, objpath, fieldpath, call_id, op FROM taint WHERE event_id % 2 = 0), i AS (SELECT DISTINCT obj_id, objpath, fieldpath, call_id, op FROM taint WHERE event_id % 2 = 1 EXCEPT SELECT * FROM e), m(mode, own, traced) AS (VALUES ('parse', true, false), ('taint', false, false), ('trace', false, true)) SELECT mode, own, traced, (SELECT count(*) FROM i) AS n_new FROM m UNION ALL SELECT 'debug', NULL, NULL, 0")
def taint_merge_modes(spark, d):
    """What each merge mode adds to the taints of even events from those of odd ones."""
    columns = ["obj_id", "objpath", "fieldpath", "call_id", "op"]
    t = taints_of(spark, d)
    old = t.where("event_id % 2 = 0").select(*columns).distinct().withColumns({"primary": F.lit(None).cast("boolean"), "traced": F.lit(None).cast("boolean")})
    new = t.where("event_id % 2 = 1").select(*columns).distinct()
    out = None
    for mode in ("parse", "taint", "trace", "debug"):
        added = taints.merge_taints(old, new, mode).where("primary IS NOT NULL")
        own, traced = _MODES.get(mode, (None, None))
        right = F.count_if((F.col("primary") == F.lit(own)) & (F.col("traced") == F.lit(traced)))
        row = added.agg(right.alias("n_new")).select(F.lit(mode).alias("mode"), F.lit(own).cast("boolean").alias("own"), F.lit(traced).cast("boolean").alias("traced"), "n_new")
        out = row if out is None else out.unionAll(row)
    return out


#: An operation calls the next one of its request if both act on one database; it is entered at twice its number and left three steps later.  Writes to the queue are pushes.
_WALK = """steps AS (SELECT req, seq, obj, db, op, lead(obj) OVER w AS callee, lead(db) OVER w AS callee_db FROM ops WINDOW w AS (PARTITION BY req ORDER BY seq)),
calls2 AS (SELECT req || ':' || obj AS caller, req || ':' || callee AS callee, seq FROM steps WHERE db = callee_db),
pairs2 AS (SELECT caller AS src, callee AS dst, 2 * seq AS t FROM calls2 UNION SELECT callee, caller, 2 * seq + 3 FROM calls2),
hops AS (SELECT DISTINCT req || ':' || obj AS src, req || ':' || (obj + 100) AS dst, 2 * seq + 1 AS t FROM ops WHERE db = 'db5' AND op = 'W')"""


@query("request_taints", f"""WITH RECURSIVE {_OPS}, {_TAINT}, {_WALK},
    o AS (SELECT DISTINCT req, obj_id, objpath, fieldpath, call_id, op FROM taint WHERE own),
    r AS (SELECT *, CAST(0 AS BIGINT) AS "at" FROM o UNION SELECT o.req, h.dst, objpath, fieldpath, call_id, op, h.t FROM o JOIN hops h ON o.obj_id = h.src
          UNION SELECT r.req, p.dst, objpath, fieldpath, call_id, op, p.t FROM r JOIN pairs2 p ON r.obj_id = p.src AND r."at" < p.t),
    e AS (SELECT req, obj_id, objpath, fieldpath, call_id, op, min("at") AS "at" FROM r GROUP BY ALL)
    SELECT e.*, o.req IS NOT NULL AS own FROM e LEFT JOIN o USING (req, obj_id, objpath, fieldpath, call_id, op)""")
def request_taints(spark, d):
    """Taints that requests hand on between callers and callees in the order of the walk, and across queues."""
    t, o = taints_of(spark, d), ops_of(spark, d)
    following = Window.partitionBy("req").orderBy("seq")
    named = lambda c: text(F.col("req"), ":", F.col(c))
    steps = o.withColumns({"callee": F.lead("obj").over(following), "callee_db": F.lead("db").over(following)}).where("db = callee_db").select(named("obj").alias("caller"), named("callee").alias("callee"), "seq")
    down = steps.select(F.col("caller").alias("src"), F.col("callee").alias("dst"), (2 * F.col("seq")).alias("time"))
    back = steps.select(F.col("callee").alias("src"), F.col("caller").alias("dst"), (2 * F.col("seq") + 3).alias("time"))
    hops = o.where("db = 'db5' AND op = 'W'").select(named("obj").alias("src"), text(F.col("req"), ":", F.col("obj") + 100).alias("dst"), (2 * F.col("seq") + 1).alias("time"))
    return taints.request_taints(t, down.unionByName(back), hops).withColumnRenamed("primary", "own")


#: Kinds of value-flow edges take turns; the fixed segment of each, and its steps forward and backward.
_KINDS = tuple(graph.EDGE_RULES)
_SEGMENTS = {"INDEX": "[*]", "MAP_UPDATE": ".MapVal", "MAP_KEY": ".MapKey.Key", "MAP_VALUE": ".MapVal", "LOOKUP_MAP": ".MapVal", "LOOKUP_MAP_INDEX": ".MapVal"}
_OPERATORS, _CALLEES = ("+", "==", "-", "<"), ("append", "Print", "Itoa", "ParseInt", "Sprintf")


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


#: Value flow: parts are values, ten in a row are a function.
_FLOW = f"""flow AS (
    SELECT fn, src, dst, etype, CASE WHEN etype = 'FIELD' THEN '.f' || (src % 3) ELSE coalesce(s.segment, '') END AS segment,
           CASE WHEN etype IN ('BINOP_X', 'BINOP_Y') THEN {_list(_OPERATORS)}[src % {len(_OPERATORS)} + 1] WHEN etype = 'ARG_ON_CALL' THEN {_list(_CALLEES)}[src % {len(_CALLEES)} + 1] END AS op
    FROM (SELECT p_partkey // 10 AS fn, p_partkey AS src, p_partkey + 1 AS dst, {_list(_KINDS)}[(p_size + p_partkey) % {len(_KINDS)} + 1] AS etype FROM part WHERE p_partkey % 10 <> 9)
    LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in _SEGMENTS.items())}) s(etype, segment) USING (etype)
)"""


def flow_of(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    kind = pick(_KINDS, F.col("p_size") + key)
    segment = F.when(F.col("etype") == "FIELD", text(".f", key % 3)).otherwise(F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in _SEGMENTS.items() for x in p)), F.col("etype")), F.lit("")))
    op = F.when(F.col("etype").isin("BINOP_X", "BINOP_Y"), pick(_OPERATORS, key)).when(F.col("etype") == "ARG_ON_CALL", pick(_CALLEES, key))
    return table(spark, d, "part").where(key % 10 != 9).withColumn("etype", kind).select(
        F.floor(key / 10).alias("fn"), key.alias("src"), (key + 1).alias("dst"), "etype", segment.alias("segment"), op.alias("op"),
        F.lit(0).alias("index"), key.cast("int").alias("ord"),
    )


_RULES = ", ".join(f"('{k}', '{f}', '{b}')" for k, (f, b) in graph.EDGE_RULES.items())
_COMPARED, _FLOWING = (", ".join(f"'{x}'" for x in xs) for xs in (graph.COMPARISONS, graph.FLOWING_CALLS))
_MOVES = f"""rules(etype, f, b) AS (VALUES {_RULES}),
    inside AS (SELECT p_partkey AS id FROM part WHERE p_size = 13),
    u AS (SELECT f.src, f.dst, f.segment, r.f, r.b FROM flow f JOIN rules r USING (etype) WHERE NOT (etype IN ('BINOP_X', 'BINOP_Y') AND op IN ({_COMPARED})) AND NOT (etype = 'ARG_ON_CALL' AND op NOT IN ({_FLOWING}))
          AND src NOT IN (SELECT id FROM inside) AND dst NOT IN (SELECT id FROM inside)),
    moves AS (SELECT src AS a, dst AS z, segment, f AS how FROM u WHERE f <> 'stop' UNION SELECT dst, src, segment, b FROM u WHERE b <> 'stop')"""
_STEP = """SELECT z AS id, CASE WHEN how = 'copy' THEN objpath WHEN how = 'push' THEN '_obj' || segment || substr(objpath, 5) WHEN objpath = '_obj' THEN '_obj' ELSE '_obj' || substr(objpath, 5 + length(segment)) END AS objpath,
                CASE WHEN how = 'pop' AND objpath = '_obj' THEN fieldpath || segment ELSE fieldpath END AS fieldpath
          FROM r JOIN moves ON r.id = moves.a WHERE how <> 'pop' OR objpath = '_obj' OR starts_with(substr(objpath, 5), segment)"""
_SEEDS = "SELECT p_partkey AS id, '_obj' AS objpath, 'db.c.f' || (p_partkey % 5) AS fieldpath FROM part"


def _flow_parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges, seeds (every part) and the values used inside filter documents."""
    part, key = table(spark, d, "part"), F.col("p_partkey")
    seeds = part.select(key.alias("id"), F.lit("_obj").alias("objpath"), text("db.c.f", key % 5).alias("fieldpath"))
    return flow_of(spark, d), seeds, part.where("p_size = 13").select(key.alias("id"))


@query("value_taints", f"WITH RECURSIVE {_FLOW}, {_MOVES}, r AS ({_SEEDS} UNION {_STEP}) SELECT id, objpath, fieldpath FROM r")
def value_taints(spark, d):
    """Taints of every value inside its function, both ways over all kinds of value-flow edges; values inside filter documents stop them."""
    flow, seeds, inside = _flow_parts(spark, d)
    texts = lambda df, *cs: df.withColumns({c: F.col(c).cast("string") for c in cs})
    found = graph.propagate(texts(flow, "src", "dst"), texts(seeds, "id"), texts(inside, "id"))
    return found.select(F.col("id").cast("long").alias("id"), "objpath", "fieldpath")


#: Map updates, look-ups and calls: ten values in a row are a function; the even ones up to the sixth are operands together with the next two, the last two are a struct and its field.
_CALLED = ["append", "copy", "delete", "Itoa", "Println"]
_INSTRUCTIONS = f"""ins AS (
    SELECT c_custkey AS a, c_custkey + 1 AS b, c_custkey + 2 AS c, c_nationkey % 3 AS kind, {_list(_CALLED)}[c_nationkey % {len(_CALLED)} + 1] AS name,
           CASE WHEN c_custkey % 4 = 0 THEN '.k' || (c_nationkey % 2) ELSE '.MapKey' END AS entry
    FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 10 <= 6),
    moves AS (
        SELECT b AS a, a AS z, entry || '.Key' AS segment, 'push' AS how FROM ins WHERE kind IN (0, 1) UNION SELECT c, a, entry || '.Val', 'push' FROM ins WHERE kind IN (0, 1)
        UNION SELECT a, b, '.MapKey.Key', 'cut' FROM ins WHERE kind = 0 UNION SELECT a, c, '.MapKey.Val', 'cut' FROM ins WHERE kind = 0
        UNION SELECT a, b, entry || '.Key', 'cut' FROM ins WHERE kind = 1 UNION SELECT a, c, entry || '.Val', 'cut' FROM ins WHERE kind = 1
        UNION SELECT unnest([a, c, b, c, a, b]), unnest([c, a, c, b, b, a]), '', 'copy' FROM ins WHERE kind = 2 AND name = 'append'
        UNION SELECT unnest([a, b]), unnest([b, a]), '', 'copy' FROM ins WHERE kind = 2 AND name = 'copy'
        UNION SELECT a, b, '.MapKey.Key', 'cut' FROM ins WHERE kind = 2 AND name = 'delete' UNION SELECT b, a, '.MapKey.Key', 'push' FROM ins WHERE kind = 2 AND name = 'delete'
        UNION SELECT unnest([a, c]), unnest([c, a]), '', 'copy' FROM ins WHERE kind = 2 AND name = 'Itoa'
        UNION SELECT c_custkey, c_custkey + 1, '.f' || (c_nationkey % 3), 'pop' FROM customer WHERE c_custkey % 10 = 8
        UNION SELECT c_custkey + 1, c_custkey, '.f' || (c_nationkey % 3), 'push' FROM customer WHERE c_custkey % 10 = 8)"""


def _instructions(spark: SparkSession, d: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    name = F.element_at(F.array(*map(F.lit, _CALLED)), (nation % len(_CALLED) + 1).cast("int"))
    literal = F.when(key % 4 == 0, text("k", nation % 2))
    ids = [(key + i).cast("string").alias(c) for i, c in enumerate("abc")]
    ins = table(spark, d, "customer").where((key % 2 == 0) & (key % 10 <= 6)).select(*ids, (nation % 3).alias("kind"), name.alias("name"), literal.alias("literal"))
    of = lambda kind, *names: ins.where(F.col("kind") == kind).select(*(F.col(c).alias(n) for c, n in zip("abc", names, strict=True)), "literal")
    args = ins.where("kind = 2").select(F.col("a").alias("call"), "name", F.posexplode(F.array("a", "b")).alias("pos", "arg"), F.col("c").alias("result"))
    return graph.instruction_moves(of(0, "map", "key", "value"), of(1, "map", "key", "result"), args)


@query("map_taints", f"""WITH RECURSIVE {_INSTRUCTIONS}, r AS (SELECT c_custkey AS id, '_obj' AS objpath, 'db.c.f' || (c_custkey % 5) AS fieldpath FROM customer UNION {_STEP.replace("how <> 'pop' OR objpath = '_obj'", "how IN ('copy', 'push') OR (how = 'pop' AND objpath = '_obj')").replace("WHEN objpath = '_obj' THEN", "WHEN how = 'pop' AND objpath = '_obj' THEN")})
    SELECT id, objpath, fieldpath FROM r""")
def map_taints(spark, d):
    """Taints of every value over map entries under literal and dynamic keys, look-ups, built-in calls and conversions."""
    customer, key = table(spark, d, "customer"), F.col("c_custkey")
    fields = customer.where(key % 10 == 8).select(F.lit("FIELD").alias("etype"), key.cast("string").alias("src"), (key + 1).cast("string").alias("dst"), text(".f", F.col("c_nationkey") % 3).alias("segment"), F.lit(None).cast("string").alias("op"))
    seeds = customer.select(key.cast("string").alias("id"), F.lit("_obj").alias("objpath"), text("db.c.f", key % 5).alias("fieldpath"))
    found = graph.propagate(fields, seeds, instructions=_instructions(spark, d))
    return found.select(F.col("id").cast("long").alias("id"), "objpath", "fieldpath")


@query("flow_edges_of_kind", f"WITH {_FLOW} SELECT fn, src, dst, etype FROM flow WHERE etype IN ('FIELD', 'INDEX')")
def flow_edges_of_kind(spark, d):
    """Edges by kind."""
    return taints.edges_of_kind(flow_of(spark, d), "FIELD", "INDEX").select("fn", "src", "dst", "etype")


@query("flow_neighbours", f"WITH {_FLOW} SELECT src AS node, dst AS neighbour, true AS outgoing FROM flow UNION ALL SELECT dst, src, false FROM flow")
def flow_neighbours(spark, d):
    """Edges out of and into nodes."""
    e = flow_of(spark, d)
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
    return graph.neighbours(nodes, e).withColumn("outgoing", F.lit(True)).unionByName(graph.neighbours(nodes, e, False).withColumn("outgoing", F.lit(False)))


@query("flow_one_edge", "SELECT l_partkey AS src, l_suppkey AS dst, min((l_orderkey, l_linenumber)) AS o, arg_min(l_returnflag, (l_orderkey, l_linenumber)) AS etype FROM lineitem GROUP BY ALL".replace("min((l_orderkey, l_linenumber)) AS o, ", ""))
def flow_one_edge(spark, d):
    """One edge per pair of nodes, the first whatever its kind."""
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.col("l_returnflag").alias("etype"))
    return graph.one_edge_per_pair(e).select("src", "dst", "etype")


#: Calls: an extract of a collection call is its cursor, a receiver edge a call on it.
_CALLS = "ssa AS (SELECT l_orderkey AS fn, l_linenumber AS call, l_linenumber + 10 AS cursor, l_linenumber + 20 AS cursor_call, l_linenumber % 3 AS index, l_suppkey % 2 AS used FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_suppkey))"


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))  # noqa: E741
    n = F.col("l_linenumber").cast("int")
    extract = l.select(F.col("l_orderkey").alias("fn"), F.lit("EXTRACT").alias("etype"), n.alias("src"), (n + 10).alias("dst"), (n % 3).alias("index"))
    receiver = l.where("l_suppkey % 2 = 1").select(F.col("l_orderkey").alias("fn"), F.lit("RECEIVER_ON_CALL").alias("etype"), (n + 10).alias("src"), (n + 20).alias("dst"), F.lit(0).alias("index"))
    return l.select(F.col("l_orderkey").alias("fn"), n.alias("call"), (n % 2 + 1).alias("results")), extract.unionByName(receiver)


@query("cursor_calls", f"WITH {_CALLS} SELECT fn, call, cursor, cursor_call FROM ssa WHERE index = 0 AND used = 1")
def cursor_calls(spark, d):
    """Calls on the cursors of collection calls."""
    return taints.cursor_calls(*_calls(spark, d))


@query("returned_values", f"WITH {_CALLS} SELECT fn, call, CASE WHEN call % 2 + 1 > 1 THEN cursor ELSE call END AS value FROM ssa")
def returned_values(spark, d):
    """What calls return: extracted values, or the call itself."""
    return taints.returned_values(*_calls(spark, d))


@query("seed_taints", f"WITH {_OPS} SELECT DISTINCT 'f' || (req % 9) AS fn, 'v' || (k % 30) AS id, CASE WHEN rv AND k % 2 = 0 THEN '_obj[*]' ELSE '_obj' END AS objpath, field AS fieldpath, 'S.M.t' || (k % 30) AS call_id, op, 'database' AS kind FROM ops UNION ALL SELECT DISTINCT 'f' || (req % 9), 'a' || (k % 30), '_obj', 'S.M.t' || (k % 30) || '.t' || (k % 4), 'S.M.t' || (k % 30), NULL, 'service' FROM ops")
def seed_taints(spark, d):
    """Taints that datastore and service calls start with."""
    o, k = ops_of(spark, d), F.col("k")
    call = text("S.M.t", k % 30)
    db = o.select(text("f", F.col("req") % 9).alias("fn"), text("v", k % 30).alias("id"), "field", call.alias("call_id"), "op", (F.col("rv") & (k % 2 == 0)).alias("many"))
    sv = o.select(text("f", F.col("req") % 9).alias("fn"), text("a", k % 30).alias("id"), call.alias("call_id"), text("t", k % 4).alias("name"))
    return taints.seed_taints(db, sv)


_SSA = "ssa AS (SELECT 'f' || (req % 9) AS fn, 'v' || (k % 30) AS id, CASE WHEN k % 3 = 0 THEN '_obj.A' ELSE '_obj' END AS objpath, CASE WHEN k % 4 = 0 THEN 'S.M.t1' ELSE field END AS fieldpath, 'S.M.t' || (k % 30) AS call_id, op, CASE WHEN k % 4 = 0 THEN 'service' ELSE 'database' END AS kind, CASE WHEN k % 5 = 0 THEN 'upwards' ELSE 'nearby' END AS mode FROM ops)"


def _ssa(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return ops_of(spark, d).select(
        text("f", F.col("req") % 9).alias("fn"), text("v", k % 30).alias("id"), F.when(k % 3 == 0, "_obj.A").otherwise("_obj").alias("objpath"), F.when(k % 4 == 0, F.lit("S.M.t1")).otherwise(F.col("field")).alias("fieldpath"),
        text("S.M.t", k % 30).alias("call_id"), "op", F.when(k % 4 == 0, "service").otherwise("database").alias("kind"), F.when(k % 5 == 0, "upwards").otherwise("nearby").alias("mode"),
    )


@query("write_taints", f"WITH {_OPS}, {_SSA} SELECT DISTINCT id, objpath, CASE WHEN mode = 'upwards' AND kind = 'database' THEN fieldpath || substr(objpath, 5) ELSE fieldpath END AS fieldpath, kind FROM ssa")
def write_taints(spark, d):
    """Taints as values get them, nearby or fetched upwards."""
    return taints.write_taints(_ssa(spark, d).select("id", "objpath", "fieldpath", "kind", "mode"))


@query("abstract_taints", f"WITH {_OPS}, {_SSA} SELECT DISTINCT fn || '.' || id AS obj_id, objpath, fieldpath, call_id, op, true AS own, false AS traced FROM ssa WHERE kind = 'database'")
def abstract_taints(spark, d):
    """Datastore taints of values as taints of objects."""
    return taints.abstract_taints(_ssa(spark, d)).withColumnRenamed("primary", "own")


@query("abstract_traces", f"WITH {_OPS}, {_SSA} SELECT DISTINCT fn || '.' || id AS obj_id, objpath, fieldpath AS svpath, call_id AS sv_call_id FROM ssa WHERE kind = 'service'")
def abstract_traces(spark, d):
    """Service taints of values as traces of objects."""
    return taints.abstract_traces(_ssa(spark, d))


@query("datastore_nodes", f"WITH {_OPS}, {_SSA} SELECT DISTINCT split_part(fieldpath, '.', 1) AS db, split_part(fieldpath, '.', 2) AS schema, split_part(fieldpath, '.', 1) NOT IN ('db1', 'db3') AS is_new FROM ssa WHERE kind = 'database'")
def datastore_nodes(spark, d):
    """Datastores and schemas that taints bring into the abstract graph."""
    known = spark.createDataFrame([("db1", "c"), ("db3", "c")], "db string, schema string")
    return taints.datastore_nodes(_ssa(spark, d), known)


@query("merge_returns", f"WITH {_OPS} SELECT DISTINCT req AS node, k % 3 AS pos, '_obj' AS objpath, field AS fieldpath, 'c' || (k % 9) AS call_id, first_value(op) OVER (PARTITION BY req, k % 3, field, k % 9 ORDER BY seq % 2, op) AS op FROM ops")
def merge_returns(spark, d):
    """Taints of all return tuples of a function as those of one."""
    k = F.col("k")
    r = ops_of(spark, d).select(F.col("req").alias("node"), (F.col("seq") % 2).alias("tuple"), (k % 3).alias("pos"), F.lit("_obj").alias("objpath"), F.col("field").alias("fieldpath"), text("c", k % 9).alias("call_id"), "op")
    return taints.merge_returns(r)


@query("taint_concatenation", f"WITH {_OPS}, {_TAINT} SELECT objpath, fieldpath, count(*) AS n FROM (SELECT * FROM taint WHERE own UNION ALL SELECT * FROM taint) GROUP BY ALL")
def taint_concatenation(spark, d):
    """Two taint maps with all their rows."""
    t = taints_of(spark, d)
    return taints.concatenate(t.where("primary"), t).groupBy("objpath", "fieldpath").agg(F.count(F.lit(1)).alias("n"))


@query("callee_parameters", "SELECT s_suppkey AS callee, s_nationkey % 7 - 2 AS pos, s_name AS name FROM supplier WHERE s_nationkey % 7 >= 2")
def callee_parameters(spark, d):
    """Parameters without receiver and context."""
    return taints.callee_parameters(table(spark, d, "supplier").select(F.col("s_suppkey").alias("callee"), (F.col("s_nationkey") % 7).alias("pos"), F.col("s_name").alias("name")))


@query("callee_graphs", "SELECT s_suppkey % 10 AS callee, 'f' || n_nationkey || '@' || n_regionkey AS context, s_suppkey AS src, s_suppkey + 1 AS dst FROM nation JOIN supplier ON s_suppkey % 10 = n_nationkey % 10")
def callee_graphs(spark, d):
    """A copy of the callee's graph for each call."""
    calls = table(spark, d, "nation").select(text("f", F.col("n_nationkey")).alias("caller"), (F.col("n_nationkey") % 10).cast("long").alias("callee"), F.col("n_regionkey").alias("site"))
    edges = table(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("fn"), F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"))
    return taints.callee_graphs(calls, edges).select("callee", "context", "src", "dst")


@query("call_edges_later", "SELECT a.s_suppkey AS edge_id, b.s_suppkey AS later_id FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND b.s_suppkey > a.s_suppkey")
def call_edges_later(spark, d):
    """Edges of a node after each of its edges."""
    return taints.later_edges(table(spark, d, "supplier").select(F.col("s_nationkey").alias("src"), F.col("s_suppkey").alias("edge_id"), F.col("s_suppkey").alias("ord")))


_TRACE = "trace AS (SELECT DISTINCT req || ':' || obj AS obj_id, 'S' || (k % 5) || '.M.t' || (k % 6) || CASE WHEN k % 2 = 0 THEN '.F' ELSE '' END AS svpath, 'c' || (k % 10) AS sv_call_id FROM ops)"


def _traces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    path = F.concat(text("S", k % 5, ".M.t", k % 6), F.when(k % 2 == 0, ".F").otherwise(""))
    return ops_of(spark, d).select(text(F.col("req"), ":", F.col("obj")).alias("obj_id"), path.alias("svpath"), text("c", k % 10).alias("sv_call_id")).distinct()


@query("trace_arguments", f"WITH {_OPS}, {_TRACE}, a AS (SELECT 'c' || s_suppkey % 10 AS call_id, 't' || s_nationkey % 6 AS name, s_suppkey AS target FROM supplier) SELECT obj_id, svpath, sv_call_id, CASE WHEN ends_with(svpath, '.F') THEN '_obj.F' ELSE '_obj' END AS at, target FROM trace JOIN a ON sv_call_id = call_id AND split_part(svpath, '.', 3) = name")
def trace_arguments(spark, d):
    """Traces with the arguments of other calls that they name."""
    args = table(spark, d, "supplier").select(text("c", F.col("s_suppkey") % 10).alias("call_id"), text("t", F.col("s_nationkey") % 6).alias("name"), F.col("s_suppkey").alias("obj_id"))
    return taints.traces_to_arguments(_traces(spark, d), args)


@query("trace_partners", f"WITH {_OPS}, {_TRACE}, p AS (SELECT 'p' || (s_suppkey % 50) AS target, 'c' || (s_suppkey % 10) AS sv_call_id, 'S' || (s_suppkey % 5) || '.M.t' || (s_nationkey % 6) AS svpath FROM supplier) SELECT DISTINCT obj_id, target FROM trace JOIN p USING (sv_call_id, svpath)")
def trace_partners(spark, d):
    """Objects and parameters whose traces have one call and service path."""
    key = F.col("s_suppkey")
    params = table(spark, d, "supplier").select(text("p", key % 50).alias("obj_id"), text("c", key % 10).alias("sv_call_id"), text("S", key % 5, ".M.t", F.col("s_nationkey") % 6).alias("svpath"))
    return taints.traces_to_traces(_traces(spark, d), params)


@query("trace_union", f"WITH {_OPS}, {_TRACE} SELECT DISTINCT svpath, sv_call_id FROM trace UNION SELECT 'S' || s_nationkey || '.M.t0', 'c0' FROM supplier")
def trace_union(spark, d):
    """Distinct traces of two tables."""
    more = table(spark, d, "supplier").select(text("S", F.col("s_nationkey"), ".M.t0").alias("svpath"), F.lit("c0").alias("sv_call_id"))
    return taints.union_of_traces(_traces(spark, d).select("svpath", "sv_call_id"), more)


@query("pair_union", "SELECT n_nationkey AS id, 0 AS part, n_nationkey AS pos FROM nation UNION ALL SELECT s_suppkey, -1, s_suppkey FROM supplier")
def pair_union(spark, d):
    """Pairs of a second table before those of a first."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_nationkey").cast("long").alias("ord"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("ord"))
    return taints.ordered_union(n, s, prepend=True).select("id", "ord.part", "ord.pos")


@query("taint_inserts", f"WITH {_OPS}, {_TAINT}, e AS (SELECT DISTINCT obj_id, fieldpath FROM taint WHERE event_id % 2 = 0), i AS (SELECT DISTINCT obj_id, fieldpath FROM taint WHERE event_id % 2 = 1) SELECT * FROM e UNION SELECT * FROM i")
def taint_inserts(spark, d):
    """Taints inserted unless they exist."""
    t = taints_of(spark, d).select("obj_id", "fieldpath", "event_id")
    side = lambda m: t.where(F.col("event_id") % 2 == m).select("obj_id", "fieldpath")
    return graph.insert_new(side(0).distinct(), side(1), ("obj_id", "fieldpath"))


@query("taint_pushes", f"""WITH {_OPS}, {_TAINT}, e AS (SELECT DISTINCT obj_id, objpath, fieldpath, call_id, op, own FROM taint WHERE op <> 'R'),
    n AS (SELECT DISTINCT obj_id || 'x' AS obj_id, '_obj.P' || substr(objpath, 5) AS objpath, fieldpath, call_id, op FROM taint WHERE op = 'R')
    SELECT obj_id, objpath, fieldpath, call_id, op, own, false AS traced FROM e UNION ALL SELECT *, false, true FROM n""")
def taint_pushes(spark, d):
    """Taints of reads, new ones, written onto their target objects below a path; those of other operations are there."""
    t = taints_of(spark, d)
    columns = ["obj_id", "objpath", "fieldpath", "call_id", "op", "primary", "traced"]
    old = t.where("op <> 'R'").withColumn("traced", F.lit(False)).select(*columns).distinct()
    new = t.where("op = 'R'")
    targets = new.select("obj_id", F.concat("obj_id", F.lit("x")).alias("target"), F.lit("_obj.P").alias("at"))
    return taints.push_taints(old, new.select(*columns), targets).withColumnRenamed("primary", "own")


@query("combine_calls", f"""WITH RECURSIVE {_FLOW}, {_MOVES.replace("moves AS (", "within AS (")},
    moves AS (SELECT * FROM within UNION SELECT p_partkey, (p_partkey // 10) // 3 * 10 + (p_partkey // 10) % 3, '', 'copy' FROM part WHERE p_partkey % 10 = 5 AND p_partkey >= 10),
    r AS ({_SEEDS} UNION {_STEP})
    SELECT id // 10 AS fn, id AS obj, objpath, fieldpath FROM r""")
def combine_calls(spark, d):
    """Taints of every function seen from its callers and spread inside them: three callees a function, a result of each is one of its first values."""
    flow, seeds, inside = _flow_parts(spark, d)
    key, fn = F.col("p_partkey"), F.floor(F.col("p_partkey") / 10)
    of = lambda df: df.withColumnRenamed("id", "obj").withColumn("fn", F.floor(F.col("obj") / 10))
    results = table(spark, d, "part").where((key % 10 == 5) & (key >= 10))
    calls = results.select(F.floor(fn / 3).alias("caller"), fn.alias("callee"), (fn % 3).cast("int").alias("site"), key.alias("inner"), (F.floor(fn / 3) * 10 + fn % 3).alias("outer"))
    found = taints.combine_calls(calls, of(seeds).withColumn("stamp", F.array(F.col("obj").cast("int"))), flow, of(inside))
    return found.select("fn", "obj", "objpath", "fieldpath")


_BODY = """calls AS (SELECT 'n' || n_nationkey AS fn, 'c' || n_nationkey AS call_id, 'n' || (n_nationkey + 5) AS callee, CASE WHEN n_nationkey % 2 = 0 THEN 'method' ELSE 'service' END AS kind FROM nation
    UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'db' || (s_suppkey % 6), 'database' FROM supplier)"""


_GRAPH = f"""{_BODY}, body AS (SELECT DISTINCT fn AS src, fn FROM calls UNION SELECT b.src, c.callee FROM body b JOIN calls c ON b.fn = c.fn WHERE c.kind = 'method'),
    e AS (SELECT DISTINCT b.src, c.callee AS dst, c.kind AS etype, c.call_id FROM body b JOIN calls c ON b.fn = c.fn WHERE c.kind <> 'method'),
    seen AS (SELECT DISTINCT 'n' || n_regionkey AS node FROM nation UNION SELECT e.dst FROM seen JOIN e ON seen.node = e.src WHERE e.etype = 'service'),
    reached AS (SELECT e.* FROM e WHERE src IN (SELECT node FROM seen))"""


def graph_input(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Entries and calls: nations call on as methods or services, and their suppliers are calls of databases."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    key = F.col("n_nationkey")
    calls = n.select(text("n", key).alias("fn"), text("c", key).alias("call_id"), text("n", key + 5).alias("callee"), F.when(key % 2 == 0, "method").otherwise("service").alias("kind"))
    calls = calls.unionByName(s.select(text("n", F.col("s_nationkey")).alias("fn"), text("s", F.col("s_suppkey")).alias("call_id"), text("db", F.col("s_suppkey") % 6).alias("callee"), F.lit("database").alias("kind")))
    return n.select(text("n", F.col("n_regionkey")).alias("node")).distinct(), calls


@query("abstract_graph", f"WITH RECURSIVE {_GRAPH} SELECT * FROM reached")
def abstract_graph(spark, d):
    """Calls that entries reach, with methods of a service inlined."""
    return taints.abstract_graph(*graph_input(spark, d))


#: Requests: five entries, one of them an initializer; suppliers divisible by 4 are pushes that the consumer of their number modulo 5 pops.  A consumer writes to a database and pushes on to the last one.
_CALLGRAPH = """e AS (SELECT 'E' || n_regionkey AS src, 'N' || n_nationkey AS dst, n_nationkey AS ord, 'e' || n_nationkey AS eid FROM nation
    UNION ALL SELECT 'N' || s_nationkey, CASE WHEN s_suppkey % 4 = 0 THEN 'queue' ELSE 'db' END, s_suppkey + 100, 's' || s_suppkey FROM supplier
    UNION ALL SELECT 'C' || r_regionkey, CASE p WHEN 2 THEN 'queue' ELSE 'db' END, p, 'c' || r_regionkey || '.' || p FROM region, (VALUES (1), (2)) v(p)
    UNION ALL SELECT 'Z' || r_regionkey, 'db', 1, 'z' || r_regionkey FROM region)"""


@query("request_walk", f"""WITH RECURSIVE {_CALLGRAPH}, entries AS (SELECT *, row_number() OVER (ORDER BY entry) - 1 AS req FROM (SELECT DISTINCT 'E' || n_regionkey AS node, 'E' || n_regionkey || CASE WHEN n_regionkey = 2 THEN '.Run' ELSE '.Handle' END AS entry FROM nation)),
    steps AS (SELECT src, dst, ord, eid, false AS hop FROM e UNION ALL SELECT 'N' || s_nationkey, 'C' || (s_suppkey % 5), s_suppkey + 100, 's' || s_suppkey, true FROM supplier WHERE s_suppkey % 4 = 0
              UNION ALL SELECT 'C' || r_regionkey, 'Z' || r_regionkey, 2, 'c' || r_regionkey || '.2', true FROM region),
    walk AS (SELECT req, node, CAST([] AS BIGINT[]) AS path, [node] AS way, CAST(NULL AS VARCHAR) AS eid, CAST([] AS BIGINT[]) AS opened, false AS hop FROM entries WHERE NOT ends_with(entry, '.Run')
             UNION ALL SELECT w.req, s.dst, list_append(w.path, s.ord), list_append(w.way, s.dst), s.eid, CASE WHEN s.hop THEN list_append(w.path, s.ord) ELSE w.opened END, s.hop
             FROM walk w JOIN steps s ON w.node = s.src WHERE NOT list_contains(w.way, s.dst)),
    opened AS (SELECT *, row_number() OVER (ORDER BY req, path) - 1 AS req_idx FROM (SELECT req, path FROM walk WHERE hop UNION ALL SELECT req, CAST([] AS BIGINT[]) FROM entries))
    SELECT CAST(w.req AS INT) AS req, array_to_string(w.path, '.') AS path, w.node, w.eid AS edge_id, CAST(o.req_idx AS INT) AS req_idx FROM walk w JOIN opened o ON w.req = o.req AND w.opened = o.path WHERE NOT w.hop AND w.eid IS NOT NULL""")
def request_walk(spark, d):
    """Operations of requests in call order; consumers of queues are walked where they are pushed to, under indices of their own."""
    n, s, r = table(spark, d, "nation"), table(spark, d, "supplier"), table(spark, d, "region")
    key, region, long = F.col("s_suppkey"), F.col("r_regionkey"), lambda x: F.lit(x).cast("long").alias("ord")
    edges = n.select(text("E", F.col("n_regionkey")).alias("src"), text("N", F.col("n_nationkey")).alias("dst"), F.col("n_nationkey").cast("long").alias("ord"), text("e", F.col("n_nationkey")).alias("edge_id"))
    edges = edges.unionByName(s.select(text("N", F.col("s_nationkey")).alias("src"), F.when(key % 4 == 0, "queue").otherwise("db").alias("dst"), (key + 100).alias("ord"), text("s", key).alias("edge_id")))
    entries = n.select(text("E", F.col("n_regionkey")).alias("node"), F.concat(text("E", F.col("n_regionkey")), F.when(F.col("n_regionkey") == 2, ".Run").otherwise(".Handle")).alias("entry")).distinct()
    edges = edges.unionByName(r.select(text("C", region).alias("src"), F.lit("db").alias("dst"), long(1), text("c", region, ".1").alias("edge_id"))).unionByName(r.select(text("C", region).alias("src"), F.lit("queue").alias("dst"), long(2), text("c", region, ".2").alias("edge_id")))
    edges = edges.unionByName(r.select(text("Z", region).alias("src"), F.lit("db").alias("dst"), long(1), text("z", region).alias("edge_id")))
    hops = s.where(key % 4 == 0).select(text("s", key).alias("edge_id"), text("C", key % 5).alias("consumer")).unionByName(r.select(text("c", region, ".2").alias("edge_id"), text("Z", region).alias("consumer")))
    walked = graph.traverse(edges, entries, hops)
    return walked.select("req", F.array_join("path", ".").alias("path"), "node", "edge_id", "req_idx")


@query("references_to", f"WITH {_REFS} SELECT f.path AS target, src FROM (SELECT DISTINCT field AS path FROM ops) f JOIN fk ON fk.dst = f.path")
def references_to(spark, d):
    """All fields that reference a field."""
    targets = ops_of(spark, d).select(F.col("field").alias("path"))
    return taints.references_to(staged_refs_of(spark, d), targets)


@query("fk_value_key", f"WITH {_PAIRS} SELECT f1 AS src, f2 AS dst, count(*) AS n FROM pairs WHERE op1 = 'R' AND op2 = 'R' AND NOT (rk1 AND rk2) AND rv1 AND rk2 GROUP BY f1, f2")
def fk_value_key(spark, d):
    """References that pairs of value and key reads make, under their switch."""
    rules = counted_rules_of(spark, d, AnalysisConfig(references_from_read_value_key=True))
    return rules.where("rule = 'R5' AND creates").groupBy("src", "dst").agg(F.sum("n").alias("n"))


@query("fk_deletes_infer_nothing", f"WITH {_PAIRS} SELECT op1, op2, count(*) AS n FROM pairs WHERE op1 <> 'D' AND op2 <> 'D' AND NOT (op1 = 'R' AND op2 = 'R' AND NOT (rk1 AND rk2)) GROUP BY op1, op2")
def fk_deletes_infer_nothing(spark, d):
    """Kinds of pairs that fall under a rule: none with a delete."""
    return counted_rules_of(spark, d).groupBy("op1", "op2").agg(F.sum("n").alias("n"))


@query("operation_kinds", f"WITH {_OPS} SELECT event_id, CASE op WHEN 'W' THEN 'write' WHEN 'U' THEN 'update' WHEN 'D' THEN 'delete' ELSE 'read' END AS label, op = 'R' AS is_read, op = 'W' AS is_write, op IN ('W', 'U') AS is_write_or_update, op = 'U' AS is_update, op = 'D' AS is_delete FROM ops")
def operation_kinds(spark, d):
    """Labels and classes of operations."""
    o = F.col("o")
    named = F.when(F.col("op") == "W", "write").when(F.col("op") == "U", "update").when(F.col("op") == "D", "delete").when(F.col("rk"), "read").otherwise("read_many")
    return ops_of(spark, d).select("event_id", named.alias("o")).select("event_id", names.operation_label(o).alias("label"), names.is_read(o).alias("is_read"), names.is_write(o).alias("is_write"), names.is_write_or_update(o).alias("is_write_or_update"), names.is_update(o).alias("is_update"), names.is_delete(o).alias("is_delete"))


_TWO = f"WITH {_OPS}, s AS (SELECT event_id, field AS a, 'db' || (k % 6) || '.c.f' || (k % 24) || CASE WHEN k % 3 = 0 THEN '' WHEN k % 3 = 1 THEN '.x' ELSE '9' END AS b, k % 2 AS ca, k % 4 % 3 AS cb FROM ops)"


@query("path_relations", f"""{_TWO} SELECT event_id, starts_with(b, a) AND a <> b AS strictly_above, starts_with(b, a) AS above, starts_with(b, a) AND (length(b) = length(a) OR b[length(a) + 1] IN ('.', '[')) AS above_by_segments,
    substr(b, length(a) + 1) AS rest, starts_with(b, a) AND a <> b AND ca = cb AS upper_taint FROM s""")
def path_relations(spark, d):
    """Prefix tests of paths: strict, inclusive, by segments, and of taints of one call; and what the lower path adds."""
    a, b, k = F.col("a"), F.col("b"), F.col("k")
    s = ops_of(spark, d).select("event_id", "k", F.col("field").alias("a"), F.concat("field", F.when(k % 3 == 0, "").when(k % 3 == 1, ".x").otherwise("9")).alias("b"))
    return s.select(
        "event_id", paths.is_prefix(a, b).alias("strictly_above"), paths.is_prefix(a, b, False).alias("above"), paths.is_prefix(a, b, False, True).alias("above_by_segments"),
        paths.remainder(a, b).alias("rest"), paths.is_upper_taint(a, k % 2, b, k % 4 % 3).alias("upper_taint"),
    )


@query("path_edits", f"WITH {_OPS} SELECT event_id, field || '.ID' AS appended, CASE WHEN k % 2 = 0 THEN '_obj.A' ELSE '_obj.A.B' END AS cut, '_obj.P' || CASE WHEN k % 2 = 0 THEN '.A.B' ELSE '.A.B.C' END AS prepended, CASE WHEN k % 3 = 0 THEN 'db' || (k % 6) || '.c._id' ELSE field END AS resolved, 'c' AS schema, 'S.M.t' || k || '.ret' AS call_appended, 'S' || (k % 3) || '.S.M.t' || k AS call_prepended FROM ops")
def path_edits(spark, d):
    """Paths with parts appended, cut and put in, names resolved, element marks dropped."""
    k = F.col("k")
    p = F.when(k % 2 == 0, "_obj.A.B").otherwise("_obj.A.B.C")
    marked = F.concat(F.col("db"), F.lit(".c[*].x"))
    alias = F.when(k % 3 == 0, F.concat("db", F.lit(".c._id")))
    return ops_of(spark, d).select("event_id", paths.append_suffix(F.col("field"), F.lit(".ID")).alias("appended"), paths.cut_suffix(p, F.when(k % 2 == 0, ".B").otherwise(".C")).alias("cut"), paths.prepend_after_root(p, F.lit(".P")).alias("prepended"), paths.resolve_alias(F.col("field"), alias).alias("resolved"), paths.schema_name(marked).alias("schema"), paths.append_to_call(text("S.M.t", k), F.lit(".ret")).alias("call_appended"), paths.prepend_to_call(text("S.M.t", k), text("S", k % 3)).alias("call_prepended"))


_DUAL = _REFS.replace("ORDER BY req, seq2, seq1", "ORDER BY rule = 'R4', req, seq2, seq1").replace("(r.req, r.seq2, r.seq1) >= (f.req, f.seq2, f.seq1)", "(r.rule = 'R4', r.req, r.seq2, r.seq1) >= (f.rule = 'R4', f.req, f.seq2, f.seq1)")


@query("fk_dual_pass", f"WITH {_DUAL} SELECT src, dst, mandatory, n_votes FROM fk")
def fk_dual_pass(spark, d):
    """References when pairs of reads are met after all other pairs."""
    return references.infer_references(ops_of(spark, d), AnalysisConfig(dual_pass=True)).select("src", "dst", "mandatory", "n_votes")
