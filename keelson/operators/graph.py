"""Graph and fixpoint operators: closure, request traversal, queue hops, taint propagation and merging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ancestors, is_prefix, upper_path
from ..plans.config import AnalysisConfig
from ..plans.ranking import global_row_number
from ..plans.staging import bucketed_keys, dealt_by, input_tasks, scratch_path, stage, stage_bucketed, unstage

#: Rounds after which the tables of a fixpoint are written together, so that a long one does not read ever more of them.
COMPACT_ROUNDS = 16
#: The same where rounds lie in buckets: each adds a file a bucket, and writing them together deals all rows out again.
BUCKETED_ROUNDS = 64

#: How each kind of value-flow edge hands a taint on: forward, backward.  ``copy`` keeps the object path, ``push``
#: appends the edge's segment to it, ``pop`` removes it, ``stop`` ends the walk.
EDGE_RULES = {
    "USAGE": ("copy", "copy"), "LOAD": ("copy", "copy"), "PHI_ON": ("copy", "copy"), "RANGE_OF": ("copy", "copy"), "ITERATOR_OF": ("copy", "copy"),
    "RECEIVER_ON_CALL": ("copy", "copy"), "STORE_ADDRESS": ("copy", "copy"), "STORE_VALUE": ("copy", "copy"),
    "FIELD": ("pop", "push"), "INDEX": ("pop", "push"), "MAP_UPDATE": ("push", "stop"), "MAP_KEY": ("push", "stop"), "MAP_VALUE": ("push", "stop"),
    "LOOKUP_MAP": ("pop", "push"), "LOOKUP_MAP_INDEX": ("pop", "push"), "BINOP_X": ("copy", "stop"), "BINOP_Y": ("copy", "stop"),
    "ARG_ON_CALL": ("copy", "stop"), "RETURN_ON": ("stop", "stop"), "EXTRACT": ("stop", "stop"), "PARAMETER": ("stop", "stop"),
}
#: Conversions whose result is their first argument; calls that hand their arguments' taints on; and comparisons, whose results carry none.
CONVERSIONS = ("FormatInt", "Itoa", "Atoi", "ParseInt", "ParseFloat")
FLOWING_CALLS = ("append", "copy", "delete", *CONVERSIONS)
COMPARISONS = ("==", "!=", "<", "<=", ">", ">=")


def one_edge_per_pair(edges: DataFrame, order: str = "ord") -> DataFrame:
    """The first edge between two nodes, whatever its kind."""
    first = Window.partitionBy("src", "dst").orderBy(order)
    return edges.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def neighbours(nodes: DataFrame, edges: DataFrame, outgoing: bool = True) -> DataFrame:
    """(node, neighbour) over the edges out of ``nodes``, or into them."""
    near, far = ("src", "dst") if outgoing else ("dst", "src")
    return nodes.select("node").join(edges.select(F.col(near).alias("node"), F.col(far).alias("neighbour")), "node")


def _met_again(seen: DataFrame, moved: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``seen`` with keys that ``moved`` has.  Few rows of ``moved``, as late rounds have, are broadcast: what was seen is read where it lies and not dealt out once a round."""
    m = moved.select(*(F.col(k).alias(f"_moved_{k}") for k in keys))
    return seen.join(m, [F.col(k).eqNullSafe(F.col(f"_moved_{k}")) for k in keys], "left_semi")


def _rounds(seed: DataFrame, step, settle, keys: list[str], name: str) -> DataFrame:
    """``seed`` and all rows that ``step`` makes of those that the round before found; ``settle`` folds rows of equal ``keys``, and those whose keys are known are left out.

    What was seen lies in buckets by the keys: a round deals out the rows that it makes, never those of earlier rounds.
    """
    root = scratch_path(seed.sparkSession, name)
    settled = lambda df: settle(dealt_by(df.select(*seed.columns), keys))
    frontier = stage_bucketed(settled(seed), f"{root}/0", keys)
    parts, n = [frontier], 0
    while True:
        n += 1
        new = stage_bucketed(settled(step(frontier)).join(bucketed_keys(frontier, root, keys), keys, "left_anti"), f"{root}/{n}", keys)
        if new.isEmpty():
            unstage(new)
            return reduce(DataFrame.unionByName, parts)
        if len(parts) == BUCKETED_ROUNDS:
            together = stage_bucketed(dealt_by(reduce(DataFrame.unionByName, parts), keys), f"{root}/to-{n}", keys)
            unstage(*parts)
            parts = [together]
        parts.append(new)
        frontier = new


def fixpoint(seed: DataFrame, step, name: str = "fixpoint") -> DataFrame:
    """All rows reachable from ``seed`` by ``step``: each round extends only the rows that the last one found."""
    return _rounds(seed, step, lambda df: df.distinct(), seed.columns, name)


def closure(edges: DataFrame) -> DataFrame:
    """(src, dst) connected by one edge or more."""
    e = stage(edges.select("src", "dst").distinct(), "closure-edges")
    nxt = e.select(F.col("src").alias("mid"), F.col("dst").alias("next"))
    return fixpoint(e, lambda f: f.join(nxt, f["dst"] == nxt["mid"]).select("src", F.col("next").alias("dst")), "closure")


def first_arrivals(seed: DataFrame, step, label: str, name: str) -> DataFrame:
    """All keys (every column but ``label``) that ``step`` reaches from ``seed``, one row each: a key keeps the least label of the round that reaches it first."""
    keys = [c for c in seed.columns if c != label]
    return _rounds(seed, step, lambda df: df.groupBy(*keys).agg(F.min(label).alias(label)), keys, name)


def earliest_arrivals(seed: DataFrame, moves: DataFrame, at: str, on: str, name: str) -> DataFrame:
    """Rows of ``seed`` carried over timed ``moves`` (src, dst, time): what is at ``on`` by an earlier time than that of a move takes it and arrives at its time.

    Each row keeps its earliest arrival; a round goes on from what arrived, or arrived earlier than known.
    """
    keys = [c for c in seed.columns if c != at]
    least = lambda df: df.groupBy(*keys).agg(F.min(at).alias(at))
    frontier = stage(least(seed), name)
    seen, parts = frontier, [frontier]
    m = stage(moves.select(F.col("src").alias("_src"), F.col("dst").alias("_dst"), F.col("time").alias("_time")).distinct(), "moves")
    while True:
        met = frontier.join(m, (F.col(on) == F.col("_src")) & (F.col(at) < F.col("_time")))
        moved = stage(least(met.withColumns({on: F.col("_dst"), at: F.col("_time")}).select(*seed.columns)), name)
        known = _met_again(seen, moved, keys).select(*(F.col(c).alias(f"_{c}") for c in seed.columns))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        new = stage(moved.join(known, [*same, F.col(f"_{at}") <= F.col(at)], "left_anti"), name)
        unstage(moved)
        if new.isEmpty():
            unstage(new)
            return least(seen)
        parts.append(new)
        seen, frontier = seen.unionByName(new), new
        if len(parts) == COMPACT_ROUNDS:
            seen = stage(least(seen), name)
            unstage(*parts[:-1])
            parts = [seen]


_MARKS = "array<struct<at:string,segment:string>>"
#: Path part of map entries whose key is no literal.
DYNAMIC_KEY = ".MapKey"


def _outside(moves: DataFrame, blocked: DataFrame | None, ends: tuple[str, str]) -> DataFrame:
    """``moves`` without those from or to a value of ``blocked`` (id)."""
    if blocked is None:
        return moves
    inside = blocked.select("id").distinct()
    for end in ends:
        moves = moves.join(inside.withColumnRenamed("id", end), end, "left_anti")
    return moves


def edge_moves(edges: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """(a, b, segment, how): the steps that taints take over edges (etype, src, dst, segment, op), forward and backward.

    Comparisons and calls that hand nothing on are left out, and so are edges of ``blocked`` values (id): those used inside filter documents neither get taints nor hand them on.
    """
    rules = edges.sparkSession.createDataFrame([(k, d, r) for k, pair in EDGE_RULES.items() for d, r in zip(("f", "b"), pair, strict=True)], "etype string, dir string, how string")
    usable = edges.where(~(F.col("etype").isin("BINOP_X", "BINOP_Y") & F.col("op").isin(*COMPARISONS)) & ~((F.col("etype") == "ARG_ON_CALL") & ~F.col("op").isin(*FLOWING_CALLS)))
    usable = _outside(usable, blocked, ("src", "dst"))
    side = lambda d, a, b: usable.select("etype", F.lit(d).alias("dir"), F.col(a).alias("a"), F.col(b).alias("b"), "segment")
    both = side("f", "src", "dst").unionByName(side("b", "dst", "src"))
    return both.join(F.broadcast(rules), ["etype", "dir"]).where("how <> 'stop'").select("a", "b", "segment", "how").distinct()


def instruction_moves(updates: DataFrame, lookups: DataFrame, args: DataFrame, upwards: bool = False) -> DataFrame:
    """(a, b, segment, how): the steps that taints take between the operands of map updates, look-ups and calls.

    ``updates`` (map, key, value, literal) and ``lookups`` (map, key, result, literal): an entry lies below its ``literal`` key, or below ``DYNAMIC_KEY`` if that is null; its key and its value lie below the entry.  A look-up is read
    both ways.  An update hands taints to the map; from the map only those of entries with a dynamic key come back, and none if taints go ``upwards``.  ``args`` (call, name, pos, arg, result): ``append`` joins its arguments and its
    result, ``copy`` its two arguments, ``delete`` a map (position 0) with the key of a dynamic entry (1), a conversion its first argument and its result; other calls join nothing.  ``cut`` takes a segment away and, unlike
    ``pop``, lets no taint of the whole object pass.  Operands that are null (constants) take no part; of arguments with one position in a call the least counts.
    """
    entry = F.coalesce(F.concat(F.lit("."), F.col("literal")), F.lit(DYNAMIC_KEY))
    move = lambda df, a, b, segment, how: df.select(F.col(a).alias("a"), F.col(b).alias("b"), segment.alias("segment"), F.lit(how).alias("how"))
    key, val = (lambda of: F.concat(of, F.lit(".Key"))), (lambda of: F.concat(of, F.lit(".Val")))
    dynamic, none = F.lit(DYNAMIC_KEY), F.lit("")
    name = F.col("name")
    two = args.where(name.isin("copy", "delete")).groupBy("call", "name").agg(*(F.min(F.when(F.col("pos") == i, F.col("arg"))).alias(f"arg{i}") for i in (0, 1)))
    through = args.where((name == "append") | (name.isin(*CONVERSIONS) & (F.col("pos") == 0)))
    copied, deleted = two.where(name == "copy"), two.where(name == "delete")
    moves = [
        move(updates, "key", "map", key(entry), "push"), move(updates, "value", "map", val(entry), "push"),
        move(lookups, "key", "map", key(entry), "push"), move(lookups, "result", "map", val(entry), "push"),
        move(lookups, "map", "key", key(entry), "cut"), move(lookups, "map", "result", val(entry), "cut"),
        move(through, "arg", "result", none, "copy"), move(through, "result", "arg", none, "copy"),
        move(copied, "arg0", "arg1", none, "copy"), move(copied, "arg1", "arg0", none, "copy"),
        move(deleted, "arg0", "arg1", key(dynamic), "cut"), move(deleted, "arg1", "arg0", key(dynamic), "push"),
    ]
    if not upwards:
        moves += [move(updates, "map", "key", key(dynamic), "cut"), move(updates, "map", "value", val(dynamic), "cut")]
    return reduce(DataFrame.unionByName, moves).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def propagate(edges: DataFrame, seeds: DataFrame, blocked: DataFrame | None = None, calls: DataFrame | None = None, instructions: DataFrame | None = None) -> DataFrame:
    """Taints (id, objpath, fieldpath, stamp) that reach each value over value-flow edges and out of callees.

    ``edges`` (etype, src, dst, segment, op): ``segment`` is the path part that field, index and map edges add or remove, ``op`` names the operator or callee of BINOP and ARG edges.  ``calls`` (inner, outer, site): a taint of a
    callee's ``inner`` becomes one of the caller's ``outer``, its stamp begins with the site of the call, and from there it spreads inside the caller.  ``instructions`` are further moves, of ``instruction_moves``.

    There is one state for each value and path, however many routes lead to it: it keeps the stamp and the open pushes of the first round that reaches it, the least of them.  Paths have no greatest length; only a
    cycle that would lengthen one without end is cut where it repeats: a value does not get the same segment again while the first one is still in the path.
    """
    moves = edge_moves(edges, blocked)
    if instructions is not None:
        moves = moves.unionByName(_outside(instructions, blocked, ("a", "b")).select(*moves.columns))
    moves = moves.withColumn("site", F.lit(None).cast("int"))
    if calls is not None:
        moves = moves.unionByName(calls.select(F.col("inner").alias("a"), F.col("outer").alias("b"), F.lit("").alias("segment"), F.lit("copy").alias("how"), F.col("site").cast("int").alias("site")))
    moves = stage(moves.distinct(), "moves")

    def step(front: DataFrame) -> DataFrame:
        rest = F.substring(F.col("objpath"), F.lit(5), F.length("objpath"))
        at_root, is_push, is_pop = F.col("objpath") == "_obj", F.col("how") == "push", F.col("how") == "pop"
        fits = (is_pop | (F.col("how") == "cut")) & ~at_root & F.startswith(rest, F.col("segment"))
        is_deep = is_pop & at_root
        path = (
            F.when((F.col("how") == "copy") | is_deep, F.col("objpath"))
            .when(is_push, F.concat(F.lit("_obj"), F.col("segment"), rest))
            .when(fits, F.concat(F.lit("_obj"), F.substring(rest, F.length("segment") + 1, F.length(rest))))
        )
        field = F.when(is_deep, F.concat(F.col("fieldpath"), F.col("segment"))).otherwise(F.col("fieldpath"))
        # Where pushes and field steps took place, a push until it is popped.
        pushed, deepened, stamp = (F.col(f"label.{c}") for c in ("pushed", "deepened", "stamp"))
        mark, top = F.struct(F.col("b").alias("at"), "segment"), F.try_element_at(pushed, F.lit(-1))
        popped = F.slice(pushed, F.lit(1), F.greatest(F.size(pushed) - 1, F.lit(0)))
        open_ = F.when(is_push, F.concat(pushed, F.array(mark))).when(fits & F.coalesce(top["segment"] == F.col("segment"), F.lit(False)), popped).otherwise(pushed)
        deep = F.when(is_deep, F.concat(deepened, F.array(mark))).otherwise(deepened)
        repeats = (is_push & F.array_contains(pushed, mark)) | (is_deep & F.array_contains(deepened, mark))
        later = F.when(F.col("site").isNotNull(), F.concat(F.array("site"), stamp)).otherwise(stamp)
        reached = front.join(moves, front["id"] == moves["a"]).where(~repeats)
        return reached.select(F.col("b").alias("id"), path.alias("objpath"), field.alias("fieldpath"), _label(later, open_, deep)).where(F.col("objpath").isNotNull())

    none = F.array().cast(_MARKS)
    stamp = F.col("stamp").cast("array<int>") if "stamp" in seeds.columns else F.array().cast("array<int>")
    found = first_arrivals(seeds.select(F.col("id").cast("string").alias("id"), "objpath", "fieldpath", _label(stamp, none, none)), step, "label", "taints")
    return found.select("id", "objpath", "fieldpath", F.col("label.stamp").alias("stamp"))


def _label(stamp: Column, pushed: Column, deepened: Column) -> Column:
    """What a state carries; shorter stamps come first."""
    return F.struct(F.size(stamp).alias("depth"), stamp.alias("stamp"), pushed.alias("pushed"), deepened.alias("deepened")).alias("label")


TAINT_KEYS = {
    "similar": ("fieldpath", "call_id"),
    "except_read": ("fieldpath", "call_id", "op", "primary", "traced"),
    "except_primary": ("fieldpath", "call_id", "op", "read_key", "read_val"),
}


def distinct_taints(taints: DataFrame, equality: str = "similar") -> DataFrame:
    """One taint per place and key of the given equality: the earliest in program order."""
    first = Window.partitionBy("obj_id", "objpath", *TAINT_KEYS[equality]).orderBy("t", "fieldpath", "call_id", "op")
    return taints.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def insert_new(existing: DataFrame, incoming: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``existing`` and those rows of ``incoming`` whose key it does not have."""
    fresh = incoming.dropDuplicates(list(keys)).join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def taints_of_ancestors(taints: DataFrame, inclusive: bool = True) -> DataFrame:
    """Taints of upper paths seen from every lower path of the same object: an equi-join on exploded ancestors.

    The suffix appended to the field path is the last segment only, also for ancestors further up.
    """
    places = taints.select("obj_id", F.col("objpath").alias("place")).distinct()
    ups = places.withColumn("up", F.explode(ancestors(F.col("place"), inclusive)))
    t = taints.withColumnRenamed("obj_id", "o")
    joined = ups.join(t, (F.col("obj_id") == F.col("o")) & (F.col("up") == F.col("objpath"))).drop("o")
    tail = F.regexp_extract("place", r"(\.[^.]*)$", 1)
    return joined.withColumn("fieldpath", F.when(F.col("place") == F.col("objpath"), F.col("fieldpath")).otherwise(F.concat("fieldpath", tail)))


def prefix_pairs(uppers: DataFrame, lowers: DataFrame, config: AnalysisConfig = AnalysisConfig()) -> DataFrame:
    """(upper, lower): which of the paths in the only column of ``uppers`` begin which of those in ``lowers``, equal ones too.

    A dictionary of the distinct paths, without a join on prefixes: what stands above the last segment of an upper path is an ancestor of every path that it begins.
    """
    u, l = (df.toDF("p").where("p IS NOT NULL").distinct() for df in (uppers, lowers))  # noqa: E741
    above = u.select(F.col("p").alias("upper"), F.coalesce(upper_path(F.col("p")), F.lit("")).alias("at"))
    below = l.select(F.col("p").alias("lower"), F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("p"), True))).alias("at"))
    return above.join(below, "at").where(is_prefix(F.col("upper"), F.col("lower"), False, config.segment_aware_paths)).select("upper", "lower").distinct()


def fields_with_prefix(fields: DataFrame, prefixes: DataFrame, config: AnalysisConfig = AnalysisConfig(), inclusive: bool = True) -> DataFrame:
    """(prefix, path) in one schema; the equi-join on database and schema bounds the prefix test."""
    f = fields.select(F.col("db").alias("fdb"), F.col("schema").alias("fschema"), "path")
    joined = prefixes.join(f, (F.col("db") == F.col("fdb")) & (F.col("schema") == F.col("fschema")))
    return joined.where(is_prefix(F.col("prefix"), F.col("path"), not inclusive, config.segment_aware_paths)).select("prefix", "path")


def traverse(edges: DataFrame, entries: DataFrame, hops: DataFrame | None = None) -> DataFrame:
    """Operations of each request in call order: (req, path array<int>, node, edge_id, req_idx).

    Depth-first order is the order of the arrays of edge numbers on the way down.  Entries named Run or Init are skipped but keep their
    number; a node already on the way is not entered again, which ends every cycle.  ``hops`` (edge_id, consumer) name pushes to queues and the nodes that
    pop them: the consumer is walked right after its push, below the push's path, as part of the request, but under an index of its own.  Indices count what is opened, requests
    and consumers, in call order.
    """
    entry = global_row_number(entries, "req", "entry").withColumn("req", (F.col("req") - 1).cast("int"))
    open_ = entry.where(~F.element_at(F.split("entry", r"\."), -1).isin("Run", "Init"))
    ints = F.array().cast("array<int>")
    front = open_.select("req", F.col("node"), ints.alias("path"), F.array("node").alias("way"), F.lit(None).cast("string").alias("edge_id"), ints.alias("opened"))
    e = edges.select("src", F.col("dst"), F.col("ord").cast("int").alias("step"), F.col("edge_id").alias("eid"), F.lit(False).alias("is_hop"))
    if hops is not None:
        h = edges.select("src", "ord", "edge_id").join(hops.select("edge_id", "consumer"), "edge_id")
        e = e.unionByName(h.select("src", F.col("consumer").alias("dst"), F.col("ord").cast("int").alias("step"), F.col("edge_id").alias("eid"), F.lit(True).alias("is_hop")))
    levels, front = [], stage(front, "traverse")
    while True:
        nxt = front.join(e, (front["node"] == e["src"]) & ~F.array_contains(front["way"], e["dst"]))
        path = F.concat("path", F.array(F.col("step")))
        nxt = nxt.select("req", F.col("dst").alias("node"), path.alias("path"), F.concat("way", F.array("dst")).alias("way"), F.col("eid").alias("edge_id"), F.when(F.col("is_hop"), path).otherwise(F.col("opened")).alias("opened"), "is_hop")
        nxt = stage(nxt, "traverse")
        if nxt.isEmpty():
            break
        levels.append(nxt)
        front = nxt.drop("is_hop")
    if not levels:
        return front.select("req", "path", "node", "edge_id", F.col("req").alias("req_idx")).where("edge_id IS NOT NULL")
    out = reduce(DataFrame.unionByName, levels)
    # A consumer opens an index where it is entered, a request where it starts.
    opened = out.where("is_hop").select(F.col("req").alias("o_req"), F.col("path").alias("o_path")).unionByName(entry.select(F.col("req").alias("o_req"), ints.alias("o_path")))
    numbered = global_row_number(opened, "req_idx", "o_req", "o_path").withColumn("req_idx", (F.col("req_idx") - 1).cast("int"))
    joined = out.where("NOT is_hop").join(numbered, (F.col("req") == F.col("o_req")) & (F.col("opened") == F.col("o_path")))
    return joined.select("req", "path", "node", "edge_id", "req_idx")


def queue_hops(pushes: DataFrame, pops: DataFrame) -> DataFrame:
    """Each push with the first pop of its queue that comes after it: (push, pop, queue).

    Rows are dealt out by ranges of (queue, order), so a queue may span many tasks.  Inside a range a window looks for the next pop; where there is none, it is the first pop of the queue's next range
    that has one, from one row a range.
    """
    p = pushes.select("queue", F.col("id").alias("push"), F.lit(None).cast(pops.schema["id"].dataType).alias("pop"), "ord")
    rows = p.unionByName(pops.select("queue", F.lit(None).cast(pushes.schema["id"].dataType).alias("push"), F.col("id").alias("pop"), "ord"))
    # Of a push and a pop with one number the push comes second, so that the pop is not after it; pops with one number come by their ids.
    order = ("ord", F.col("pop").isNull(), "pop")
    ranged = stage(rows.repartitionByRange(input_tasks(rows.sparkSession), "queue", *order).withColumn("range", F.spark_partition_id()), "queue-ranges")
    inside = Window.partitionBy("queue", "range").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    near = ranged.withColumn("next", F.first("pop", ignorenulls=True).over(inside)).where("push IS NOT NULL")
    firsts = ranged.groupBy("queue", "range").agg(F.min(F.when(F.col("pop").isNotNull(), F.struct("ord", "pop")))["pop"].alias("first"))
    after = Window.partitionBy("queue").orderBy("range").rowsBetween(1, Window.unboundedFollowing)
    later = firsts.select("queue", "range", F.first("first", ignorenulls=True).over(after).alias("later"))
    found = near.join(later, ["queue", "range"]).withColumn("next", F.coalesce("next", "later"))
    return found.where("next IS NOT NULL").select("push", F.col("next").alias("pop"), "queue")


def match_arguments(args: DataFrame, params: DataFrame) -> DataFrame:
    """Call arguments with the callee's parameters at the same position."""
    return args.join(params, ["callee", "pos"]).select("call_id", "callee", "pos", "obj", "param")


def match_results(extracted: DataFrame, results: DataFrame) -> DataFrame:
    """Values (call_id, callee, pos, obj) that a caller takes out of a call with the callee's results (callee, pos, result) at the same position."""
    return extracted.join(results, ["callee", "pos"]).select("call_id", "callee", "pos", "obj", "result")


def call_pairs(args: DataFrame, params: DataFrame, extracted: DataFrame, results: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, time): what stands for each other across calls (call_id, enter, leave): arguments and parameters forward when the callee is entered, parameters and results back when it is left."""
    when = calls.select("call_id", "enter", "leave")
    a = match_arguments(args, params).join(when, "call_id")
    r = match_results(extracted, results).join(when, "call_id")
    down = a.select(F.col("obj").alias("src"), F.col("param").alias("dst"), F.col("enter").alias("time"))
    up = a.select(F.col("param").alias("src"), F.col("obj").alias("dst"), F.col("leave").alias("time"))
    return down.unionByName(up).unionByName(r.select(F.col("result").alias("src"), F.col("obj").alias("dst"), F.col("leave").alias("time")))


def stamp_window(t: Column, stamp: Column, after: bool) -> Column:
    """Taints up to a stamp, or from it on; the stamp itself is in both."""
    return t >= stamp if after else t <= stamp
