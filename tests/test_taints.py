from keelson.operators import taints
from keelson.plans.staging import input_tasks

TAINT = "obj_id string, objpath string, fieldpath string, call_id string, op string, primary boolean, traced boolean"


def test_traces(spark):
    traces = spark.createDataFrame([("o1", "c1", "S.M.t4.Field"), ("o2", "c2", "S.M.t5"), ("o3", "c1", "S.M.t4.Field")], "obj_id string, sv_call_id string, svpath string")
    args = spark.createDataFrame([("c1", "t4", "a1"), ("c2", "t4", "a2")], "call_id string, name string, obj_id string")
    found = {(r.obj_id, r.target, r.at) for r in taints.traces_to_arguments(traces, args).collect()}
    assert found == {("o1", "a1", "_obj.Field"), ("o3", "a1", "_obj.Field")}
    assert {(r.obj_id, r.target) for r in taints.traces_to_traces(traces, traces).collect()} == {("o1", "o3"), ("o3", "o1")}
    assert taints.union_of_traces(traces, traces).count() == 3


def test_pushed_taints_are_secondary_and_new(spark):
    have = spark.createDataFrame([("a1", "_obj.F.x", "db.t.f", "c", "write", True, False)], TAINT)
    new = spark.createDataFrame([("o", "_obj.x", "db.t.f", "c", "write", True, False), ("o", "_obj.y", "db.t.g", "c", "read", True, False)], TAINT)
    targets = spark.createDataFrame([("o", "a1", "_obj.F")], "obj_id string, target string, at string")
    rows = {(r.objpath, r.fieldpath, r.primary) for r in taints.push_taints(have, new, targets).collect()}
    assert rows == {("_obj.F.x", "db.t.f", True), ("_obj.F.y", "db.t.g", False)}


def test_orders(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "ord int, v string"), spark.createDataFrame([(1, "z")], "ord int, v string")
    assert [r.v for r in taints.ordered_union(a, b).orderBy("ord").collect()] == ["x", "y", "z"]
    assert [r.v for r in taints.ordered_union(a, b, prepend=True).orderBy("ord").collect()] == ["z", "x", "y"]
    edges = spark.createDataFrame([("n", "e1", 1), ("n", "e2", 2), ("m", "e3", 3)], "src string, edge_id string, ord int")
    assert [(r.edge_id, r.later_id) for r in taints.later_edges(edges).collect()] == [("e1", "e2")]


def test_combining_ends_on_recursion(spark):
    calls = spark.createDataFrame([("main", "f", 4, "p", "x"), ("f", "g", 7, "q", "p"), ("g", "f", 9, "p", "q")], "caller string, callee string, site int, inner string, outer string")
    seed = spark.createDataFrame([("g", "q", "_obj", "db.t.f", [2])], "fn string, obj string, objpath string, fieldpath string, stamp array<int>")
    found = sorted((r.fn, r.obj, r.stamp) for r in taints.combine_calls(calls, seed).collect())
    assert found == [("f", "p", [7, 2]), ("g", "q", [2]), ("main", "x", [4, 7, 2])]


def test_layers_of_calls_do_not_multiply(spark):
    """Twenty levels with three callees each: 3^20 call paths, one row a function, with the first shortest stamp."""
    calls = spark.createDataFrame([(f"{i}.{a}", f"{i + 1}.{b}", 10 * a + b, "p", "p") for i in range(20) for a in range(3) for b in range(3)], "caller string, callee string, site int, inner string, outer string")
    seed = spark.createDataFrame([("20.1", "p", "_obj", "db.t.f", [7])], "fn string, obj string, objpath string, fieldpath string, stamp array<int>")
    found = {r.fn: r.stamp for r in taints.combine_calls(calls, seed).collect()}
    assert len(found) == 61 and found["0.2"] == [20, *[0] * 18, 1, 7]


def test_taints_spread_inside_callers(spark):
    calls = spark.createDataFrame([("g", "f", 3, "r", "x"), ("h", "g", 5, "z", "y")], "caller string, callee string, site int, inner string, outer string")
    edges = spark.createDataFrame([("g", "USAGE", "x", "w", "", None), ("g", "FIELD", "w", "z", ".A", None), ("g", "USAGE", "x", "b", "", None), ("g", "USAGE", "b", "c", "", None)], "fn string, etype string, src string, dst string, segment string, op string")
    seed = spark.createDataFrame([("f", "r", "_obj", "db.t", [1])], "fn string, obj string, objpath string, fieldpath string, stamp array<int>")
    blocked = spark.createDataFrame([("g", "b")], "fn string, obj string")
    found = {(r.fn, r.obj, r.objpath, r.fieldpath, tuple(r.stamp)) for r in taints.combine_calls(calls, seed, edges, blocked).collect()}
    assert {("g", "x", "_obj", "db.t", (3, 1)), ("g", "w", "_obj", "db.t", (3, 1)), ("g", "z", "_obj", "db.t.A", (3, 1)), ("h", "y", "_obj", "db.t.A", (5, 3, 1))} <= found
    assert not {o for _, o, *_ in found} & {"b", "c"}


def test_taints_follow_the_order_of_the_walk(spark):
    """a calls b, then b calls c; what c holds comes back to b, but the call from a has been left by then: a closure would say that a gets it."""
    schema = "req long, obj_id string, objpath string, fieldpath string, call_id string, op string, primary boolean"
    t = spark.createDataFrame([(1, "a", "_obj", "db.a", "k", "R", True), (1, "c", "_obj", "db.c", "k", "R", True), (1, "b", "_obj", "db.z", "k", "R", False)], schema)
    pairs = spark.createDataFrame([("a", "b", 2), ("b", "a", 5), ("b", "c", 4), ("c", "b", 7)], "src string, dst string, time long")
    hops = spark.createDataFrame([("c", "q", 3), ("b", "q", 3)], "src string, dst string, time long")
    found = {(r.obj_id, r.fieldpath, r.at, r.primary) for r in taints.request_taints(t, pairs, hops).collect()}
    assert found == {("a", "db.a", 0, True), ("b", "db.a", 2, False), ("c", "db.a", 4, False), ("c", "db.c", 0, True), ("b", "db.c", 7, False), ("q", "db.c", 3, False)}


def test_arguments_are_listed_above_the_join(spark):
    """One row a trace and block passes the join, on keys dealt out below call and name; equal traces, equal arguments and null ones stay."""
    traces = spark.createDataFrame([(i % 50, "c1", "S.M.t4") for i in range(60)], "obj_id int, sv_call_id string, svpath string")
    args = spark.createDataFrame([("c1", "t4", i) for i in (*range(40), 1, None)], "call_id string, name string, obj_id int")
    found = taints.traces_to_arguments(traces, args)
    rows = found.collect()
    assert len(rows) == 60 * 42 and sum(r.target is None for r in rows) == 60 and sum((r.obj_id, r.target) == (3, 1) for r in rows) == 4
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join Inner") and "_salt" in plan[plan.index("Join Inner"):].splitlines()[0]


def test_listing_is_dealt_by_number(spark):
    """Rows are listed in a number of tasks, whatever their bytes; no test for nulls works out paths below the traces, and nulls meet nothing."""
    traces = spark.createDataFrame([("o1", "c1", "S.M.t4"), ("o2", None, "S.M.t4"), ("o3", "c1", None), ("o4", "c1", "S.M"), ("o5", "c2", "S.M.t4[*].F")], "obj_id string, sv_call_id string, svpath string").distinct()
    args = spark.createDataFrame([("c1", "t4", 1), (None, "t4", 2), ("c1", None, 3), (None, None, 4), ("c2", "t4", 5)], "call_id string, name string, obj_id int")
    found = taints.traces_to_arguments(traces, args)
    assert sorted((r.obj_id, r.at, r.target) for r in found.collect()) == [("o1", "_obj", 1), ("o5", "_obj.F", 5)]
    assert found.rdd.getNumPartitions() == taints.LISTING_TASKS * input_tasks(spark)
    assert not [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x and "svpath" in x]


def test_blocks_of_arguments_have_one_size(spark, monkeypatch):
    """A name with more arguments has more blocks, not longer ones."""
    monkeypatch.setattr(taints, "ARGUMENT_BLOCK", 10)
    args = spark.range(4001).selectExpr("'c' AS call_id", "if(id < 4000, 't', 'u') AS name", "nullif(id, 7) AS obj_id")
    blocks = [(r.name, [t.target for t in r._targets]) for r in taints.argument_blocks(args).collect()]
    assert 350 < len(blocks) <= 401 and max(len(t) for _, t in blocks) < 40
    assert sorted((n, -1 if i is None else i) for n, t in blocks for i in t) == sorted((*(("t", -1 if i == 7 else i) for i in range(4000)), ("u", 4000)))


def test_partners_meet_once(spark):
    """Equal rows of both sides fold before the join."""
    traces = spark.createDataFrame([("o1", "c1", "S.M.t4")] * 9 + [("o2", "c1", "S.M.t4")], "obj_id string, sv_call_id string, svpath string")
    found = taints.traces_to_traces(traces, traces)
    assert sorted(map(tuple, found.collect())) == [("o1", "o2"), ("o2", "o1")]
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")[1]
    assert below.count("Aggregate") == 2
