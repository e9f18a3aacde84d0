"""Queries do the whole job: made-up tables with keys, paths and depths that the given tables lack."""

from pyspark.sql import functions as F
from test_references import ops, refs

from keelson import catalog
from keelson.operators import detectors, graph, taints
from keelson.plans.config import AnalysisConfig

def test_orphans_of_any_key(spark, tmp_path):
    spark.createDataFrame([(1, 7), (2, 20), (3, 30), (4, None), (5, 40)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(20,), (40,)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    found = sorted((r.o_orderkey, r.o_custkey) for r in catalog.QUERIES["ri_orphans"](spark, str(tmp_path)).collect())
    assert found == [(1, 7), (3, 30)]


def test_writes_of_upper_paths_conflict(spark):
    known = refs(spark, [("b.c.f13", "a.c.f", False, [])])
    facts = ops(spark, [(1, 1, "D", "a.c.f"), (2, 1, "W", "b.c"), (3, 1, "W", "b.c.f1"), (4, 1, "W", "b.c.f13"), (5, 1, "W", "b.c.f2"), (6, 1, "W", "b.other")])
    assert [tuple(r) for r in detectors.concurrent_writes(facts, known).collect()] == [("a", "b.c.f13", 1, 3, 3)]
    by_segments = detectors.concurrent_writes(facts, known, AnalysisConfig(segment_aware_paths=True)).collect()
    assert [tuple(r) for r in by_segments] == [("a", "b.c.f13", 1, 2, 2)]


def test_writes_of_upper_paths_silence(spark):
    known = refs(spark, [("b.c.f13", "a.c.f", False, [])])
    facts = ops(spark, [(1, 1, "W", "b.c"), (1, 1, "D", "a.c.f"), (2, 1, "W", "b.c.f1"), (2, 1, "D", "a.c.f"), (3, 1, "W", "b.c.f2"), (3, 1, "D", "a.c.f")])
    assert [r.req for r in detectors.missing_cascades(facts, known).collect()] == [3]
    assert sorted(r.req for r in detectors.missing_cascades(facts, known, config=AnalysisConfig(segment_aware_paths=True)).collect()) == [2, 3]


def test_walks_have_no_greatest_depth(spark):
    n = 18
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", 1, f"e{i}") for i in range(n)], "src string, dst string, ord int, edge_id string")
    entries = spark.createDataFrame([("n0", "S.Handle")], "node string, entry string")
    assert {r.node for r in graph.traverse(edges, entries).collect()} == {f"n{i}" for i in range(1, n + 1)}
    calls = spark.createDataFrame([(f"f{i + 1}", f"f{i}", i, "p", "p") for i in range(n)], "caller string, callee string, site int, inner string, outer string")
    seed = spark.createDataFrame([("f0", "p", "_obj", "db.t.f", [2])], "fn string, obj string, objpath string, fieldpath string, stamp array<int>")
    assert {r.fn for r in taints.combine_calls(calls, seed).collect()} == {f"f{i}" for i in range(n + 1)}


def test_long_paths_stay_and_growing_cycles_end(spark):
    schema, start = "etype string, src string, dst string, segment string, op string", "id string, objpath string, fieldpath string"
    n = 18
    pushes = spark.createDataFrame([("MAP_UPDATE", f"v{i}", f"v{i + 1}", f".s{i}", None) for i in range(n)], schema)
    seed = spark.createDataFrame([("v0", "_obj", "db.t.f")], start)
    found = {(r.id, r.objpath) for r in graph.propagate(pushes, seed).collect()}
    assert found == {(f"v{i}", "_obj" + "".join(f".s{j}" for j in reversed(range(i)))) for i in range(n + 1)}
    cycle = spark.createDataFrame([("MAP_UPDATE", "v0", "v1", ".a", None), ("MAP_UPDATE", "v1", "v0", ".b", None)], schema)
    assert {(r.id, r.objpath) for r in graph.propagate(cycle, seed).collect()} == {("v0", "_obj"), ("v1", "_obj.a"), ("v0", "_obj.b.a")}


def test_suppressions_name_entities(spark):
    known = refs(spark, [("b.x.f", "a.c.f", True, []), ("b.y.g", "a.c.f", True, [])])
    facts = ops(spark, [(1, 1, "D", "a.c.f"), (2, 1, "D", "a.d.f")])
    schema = "db string, entity string, trigger_db string, trigger_entity string"
    left = lambda *rows: sorted((r.req, r.fields) for r in detectors.missing_cascades(facts, known, spark.createDataFrame(list(rows), schema)).collect())
    assert left(("b", "x", None, None)) == [(1, "b.y.g"), (2, "b.y.g")]
    assert left(("b", "x", "a", "c")) == [(1, "b.y.g"), (2, "b.x.f, b.y.g")]


def test_rounds_do_not_deal_out_what_was_seen(spark, monkeypatch):
    """Rounds of a propagation read earlier rounds in their buckets: below the join with them nothing is shuffled, and no row is lost or twice there."""
    plans, write = [], graph.stage_bucketed

    def spy(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *args)

    monkeypatch.setattr(graph, "stage_bucketed", spy)
    monkeypatch.setattr(graph, "BUCKETED_ROUNDS", 3)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(8).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"), F.lit("LOAD").alias("etype"), F.lit("").alias("segment"), F.lit("").alias("op"))
        found = graph.propagate(edges, spark.createDataFrame([("0", "_obj", "db.c.f")], "id string, objpath string, fieldpath string")).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r.id for r in found) == [str(i) for i in range(9)]
    rounds = [p for p in plans if "LeftAnti" in p]
    assert len(rounds) == 9
    for p in rounds:
        scan = next(line for line in p.splitlines() if "Bucketed: true" in line)
        above = p[: p.index(scan)].splitlines()[-3:]
        assert not any("Exchange" in line for line in above)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("keelson_")]
