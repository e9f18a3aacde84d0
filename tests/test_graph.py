from keelson.operators import checks, graph


def test_closure_ends_on_cycles_and_is_idempotent(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "src string, dst string")
    once = graph.closure(edges)
    pairs = {(r.src, r.dst) for r in once.collect()}
    assert pairs == {(x, y) for x in "abc" for y in "abc"} | {("d", "d")}
    assert {(r.src, r.dst) for r in graph.closure(once).collect()} == pairs


def test_traversal_is_depth_first_and_keeps_skipped_numbers(spark):
    edges = spark.createDataFrame([("A", "B", 1, "e1"), ("B", "C", 2, "e2"), ("A", "D", 3, "e3"), ("C", "A", 4, "e4")], "src string, dst string, ord int, edge_id string")
    entries = spark.createDataFrame([("A", "S.Handle"), ("A", "S.Run")], "node string, entry string")
    found = sorted((r.req, r.path, r.node) for r in graph.traverse(edges, entries).collect())
    assert found == [(0, [1], "B"), (0, [1, 2], "C"), (0, [3], "D")]


def test_propagation_follows_edge_rules(spark):
    edges = spark.createDataFrame(
        [("FIELD", "obj", "field", ".F", None), ("USAGE", "field", "copy", "", None), ("BINOP_X", "copy", "cmp", "", "=="), ("BINOP_X", "copy", "sum", "", "+"), ("ARG_ON_CALL", "copy", "call", "", "Itoa"), ("ARG_ON_CALL", "copy", "other", "", "Print"), ("RETURN_ON", "copy", "ret", "", None)],
        "etype string, src string, dst string, segment string, op string",
    )
    seeds = spark.createDataFrame([("obj", "_obj", "db.t")], "id string, objpath string, fieldpath string")
    found = {(r.id, r.objpath, r.fieldpath) for r in graph.propagate(edges, seeds).collect()}
    assert {("field", "_obj", "db.t.F"), ("copy", "_obj", "db.t.F"), ("sum", "_obj", "db.t.F"), ("call", "_obj", "db.t.F")} <= found
    assert not {i for i, _, _ in found} & {"cmp", "other", "ret"}
    assert ("obj", "_obj.F", "db.t.F") in found


def test_merging_and_ancestors(spark):
    schema = "obj_id string, objpath string, fieldpath string"
    t = spark.createDataFrame([("o", "_obj", "db.t"), ("o", "_obj.A.B", "db.u")], schema)
    found = {(r.place, r.fieldpath) for r in graph.taints_of_ancestors(t).collect()}
    assert found == {("_obj", "db.t"), ("_obj.A.B", "db.t.B"), ("_obj.A.B", "db.u")}
    more = spark.createDataFrame([("o", "_obj", "db.t"), ("p", "_obj", "db.t"), ("p", "_obj", "db.t")], schema)
    assert graph.insert_new(t, more, ("obj_id", "objpath", "fieldpath")).count() == 3


def test_queue_hop_takes_the_first_later_pop(spark):
    q = "queue string, id string, ord int"
    push, pop = spark.createDataFrame([("q", "p1", 1), ("q", "p2", 5)], q), spark.createDataFrame([("q", "c1", 2), ("q", "c2", 3), ("r", "c3", 9)], q)
    assert [(r.push, r.pop) for r in graph.queue_hops(push, pop).collect()] == [("p1", "c1")]


def test_first_edge_and_taint_keys(spark):
    e = spark.createDataFrame([("a", "b", 2, "LOAD"), ("a", "b", 1, "USAGE")], "src string, dst string, ord int, etype string")
    assert [r.etype for r in graph.one_edge_per_pair(e).collect()] == ["USAGE"]
    t = spark.createDataFrame([("o", "p", [2], "f", "c", "read", True, False, True, False), ("o", "p", [1], "f", "c", "write", True, False, False, False)], "obj_id string, objpath string, t array<int>, fieldpath string, call_id string, op string, primary boolean, traced boolean, read_key boolean, read_val boolean")
    assert [r.op for r in graph.distinct_taints(t).collect()] == ["write"]
    assert graph.distinct_taints(t, "except_read").count() == 2


def test_checks(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None), (3, 1)], "k int, p int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in checks.orphans(child, "p", parent, "id").collect()] == [2]
    assert [(r.k, r.n) for r in checks.duplicate_keys(child, "k").collect()] == [(3, 2)]


def test_queue_ranges(spark):
    """One queue with most rows: the next pop may lie ranges away."""
    import random

    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.9 else f"q{rng.randint(0, 3)}", rng.choice(["push", "pop", "push"]), i // 2, f"{i:05d}") for i in range(3000)] + [("hot", "push", 2000 + i, f"z{i:05d}") for i in range(2000)] + [("hot", "pop", 9000, "end")]
    q = "queue string, id string, ord int"
    side = lambda kind: [(a, i, o) for a, k, o, i in rows if k == kind]
    found = {(r.push, r.pop) for r in graph.queue_hops(spark.createDataFrame(side("push"), q), spark.createDataFrame(side("pop"), q)).collect()}
    pops = sorted((o, i, a) for a, i, o in side("pop"))
    want = set()
    for a, i, o in side("push"):
        first = next((p for po, p, pa in pops if pa == a and po > o), None)
        want |= {(i, first)} if first else set()
    assert found == want


def test_pairs_across_calls(spark):
    args = spark.createDataFrame([("c", "f", 0, "x")], "call_id string, callee string, pos int, obj string")
    params = spark.createDataFrame([("f", 0, "p")], "callee string, pos int, param string")
    taken = spark.createDataFrame([("c", "f", 1, "y")], "call_id string, callee string, pos int, obj string")
    results = spark.createDataFrame([("f", 1, "r")], "callee string, pos int, result string")
    calls = spark.createDataFrame([("c", 3, 8)], "call_id string, enter int, leave int")
    assert {tuple(r) for r in graph.call_pairs(args, params, taken, results, calls).collect()} == {("x", "p", 3), ("p", "x", 8), ("r", "y", 8)}


def test_prefix_pairs(spark):
    rows = lambda *x: spark.createDataFrame([(i,) for i in x], "p string")
    pairs = {tuple(r) for r in graph.prefix_pairs(rows("db.t", "db.t.ID", "db", "d", "db.t.x.y"), rows("db.t.IDCard", "db.t.ID", "db.t.x", "db.t.x.y.z", "dc")).collect()}
    names = ("db.t", "db.t.ID", "db", "d", "db.t.x.y")
    assert pairs == {(u, l) for u in names for l in ("db.t.IDCard", "db.t.ID", "db.t.x", "db.t.x.y.z", "dc") if l.startswith(u)}


def test_keyed_numbers(spark):
    from keelson.plans.ranking import keyed_row_number

    rows = [("hot" if i % 10 else f"u{i % 30}", (i * 7919) % 5000, i) for i in range(4000)] + [(None, 1, -1), (None, 0, -2)]
    df = spark.createDataFrame(rows, "u string, t int, id int")
    want: dict = {}
    for u in {r[0] for r in rows}:
        want |= {r[2]: n + 1 for n, r in enumerate(sorted((r for r in rows if r[0] == u), key=lambda r: r[1:]))}
    assert {r.id: r.n for r in keyed_row_number(df, "n", "u", "t", "id").collect()} == want


UPDATE, LOOKUP, ARG = "map string, key string, value string, literal string", "map string, key string, result string, literal string", "call string, name string, pos int, arg string, result string"
EDGE, SEED = "etype string, src string, dst string, segment string, op string", "id string, objpath string, fieldpath string"


def reached(spark, seeds, updates=(), lookups=(), args=(), blocked=None, **options):
    df = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    moves = graph.instruction_moves(df(updates, UPDATE), df(lookups, LOOKUP), df(args, ARG), **options)
    found = graph.propagate(df([], EDGE), df(seeds, SEED), None if blocked is None else df(blocked, "id string"), instructions=moves)
    return {(r.id, r.objpath) for r in found.collect()}


def test_entries_under_literal_keys_are_read_by_the_same_literal_only(spark):
    updates, lookups = [("m", None, "v", "a")], [("m", None, "r", "a"), ("m", None, "s", "b"), ("m", "i", "d", None)]
    assert reached(spark, [("v", "_obj.x", "db.t.f")], updates, lookups) == {("v", "_obj.x"), ("m", "_obj.a.Val.x"), ("r", "_obj.x")}


def test_dynamic_entries_come_back_from_the_map_unless_taints_go_upwards(spark):
    updates, lookups = [("m", "k", "v", None)], [("m", "i", "r", None)]
    there = {("k", "_obj"), ("m", "_obj.MapKey.Key"), ("i", "_obj")}
    assert reached(spark, [("k", "_obj", "db.t.f")], updates, lookups) == there
    assert reached(spark, [("i", "_obj", "db.t.f")], updates, lookups) == there
    assert reached(spark, [("i", "_obj", "db.t.f")], updates, lookups, upwards=True) == there - {("k", "_obj")}
    assert reached(spark, [("m", "_obj", "db.t.f")], updates, lookups) == {("m", "_obj")}


def test_built_in_calls_and_conversions(spark):
    args = [
        ("1", "append", 0, "a", "b"), ("1", "append", 1, "c", "b"), ("2", "Itoa", 0, "b", "d"), ("2", "Itoa", 1, "no", "d"), ("3", "copy", 0, "d", "n"), ("3", "copy", 1, "e", "n"),
        ("4", "Println", 0, "e", "f"), ("5", "delete", 0, "m", "n"), ("5", "delete", 1, "e", "n"), ("6", "append", 0, None, "a"),
    ]
    copies = {(x, "_obj") for x in "abcde"}
    assert reached(spark, [("a", "_obj", "db.t.f")], args=args) == copies | {("m", "_obj.MapKey.Key")}
    assert reached(spark, [("m", "_obj.MapKey.Key", "db.t.f")], args=args) == copies | {("m", "_obj.MapKey.Key")}
    assert reached(spark, [("a", "_obj", "db.t.f")], args=args, blocked=[("b",)]) == {("a", "_obj")}


def test_a_map_stored_in_itself_ends(spark):
    assert reached(spark, [("m", "_obj", "db.t.f")], [("m", None, "v", None)], args=[("1", "append", 0, "m", "v")]) == {("m", "_obj"), ("v", "_obj"), ("m", "_obj.MapKey.Val"), ("v", "_obj.MapKey.Val")}


def test_timed_moves_are_made_once(spark, monkeypatch):
    """Rounds read what was staged of the moves and of what they reached; they do not derive them anew."""
    names = []
    stage = graph.stage
    monkeypatch.setattr(graph, "stage", lambda df, name: names.append(name) or stage(df, name))
    seed = spark.createDataFrame([("a", 0), ("b", 9)], "id string, at long")
    moves = spark.createDataFrame([("a", "b", 2), ("b", "c", 3), ("c", "d", 1), ("b", "e", 10)], "src string, dst string, time long")
    found = graph.earliest_arrivals(seed, moves, "at", "id", "arrivals")
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("b", 2), ("c", 3), ("e", 10)]
    assert names.count("moves") == 1 and names.count("arrivals") == 1 + 2 * 3
