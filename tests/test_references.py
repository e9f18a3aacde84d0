import itertools
import random

import pytest

from keelson.operators import detectors, references
from keelson.plans.config import AnalysisConfig

OPS = "req long, obj long, seq long, event_id long, op string, rk boolean, rv boolean, field string, db string"


def ops(spark, rows):
    """Rows (req, obj, op, field); op Rk or Rv is a read by key or of a value."""
    out = []
    for i, (req, obj, op, field) in enumerate(rows):
        out.append((req, obj, i, i, op[0], op == "Rk", op == "Rv", field, field.split(".")[0]))
    return spark.createDataFrame(out, OPS)


RULES = [
    ("W", "W", ("f2", "f1", True)), ("Rk", "W", ("f2", "f1", False)), ("W", "Rk", ("f1", "f2", False)), ("W", "Rv", None),
    ("Rk", "Rk", ("f2", "f1", False)), ("Rv", "Rk", None), ("D", "W", None), ("W", "D", None), ("U", "W", ("f2", "f1", True)),
]


@pytest.mark.parametrize("a, b, expected", RULES)
def test_rules(spark, a, b, expected):
    f = {"f1": "da.c.x", "f2": "db.c.y"}
    facts = ops(spark, [(1, 1, a, f["f1"]), (1, 1, b, f["f2"])])
    found = [(r.src, r.dst, r.mandatory) for r in references.infer_references(facts).collect()]
    assert found == ([] if expected is None else [(f[expected[0]], f[expected[1]], expected[2])])
    fold = references.fold_references([r.asDict() for r in references.pair_rules(references.operation_pairs(facts)).collect()])
    assert [r[:3] for r in fold.rows()] == found


def test_value_key_rule_is_a_switch(spark):
    facts = ops(spark, [(1, 1, "Rv", "da.c.x"), (1, 1, "Rk", "db.c.y")])
    on = AnalysisConfig(references_from_read_value_key=True)
    assert [(r.src, r.dst) for r in references.infer_references(facts, on).collect()] == [("da.c.x", "db.c.y")]


def test_votes_true_sticks_in_a_request_and_all_requests_have_to_agree(spark):
    rows = [(1, 1, "W", "da.c.x"), (1, 1, "W", "db.c.y"), (1, 2, "Rk", "da.c.x"), (1, 2, "W", "db.c.y")]
    assert references.infer_references(ops(spark, rows)).first().mandatory
    rows += [(2, 1, "Rk", "da.c.x"), (2, 1, "W", "db.c.y")]
    found = references.infer_references(ops(spark, rows)).first()
    assert not found.mandatory
    assert [(r.req, r.vote) for r in references.infer_votes(ops(spark, rows)).orderBy("req").collect()] == [(1, True), (2, False)]


def test_votes_do_not_depend_on_order():
    pair = lambda a, b: {"f1": "da.c.x", "f2": "db.c.y", "op1": a, "op2": b, "rule": "R1" if a == "W" else "R2", "req": 1, "creates": True, "src": "db.c.y", "dst": "da.c.x"}
    for order in itertools.permutations([pair("W", "W"), pair("R", "W"), pair("W", "W")]):
        assert references.fold_references(order).rows() == [("db.c.y", "da.c.x", True, False)]


def test_transitive_reference_replaces_the_direct_one():
    pair = lambda f1, f2: {"f1": f1, "f2": f2, "op1": "W", "op2": "W", "rule": "R1", "req": 1, "creates": True, "src": f2, "dst": f1}
    pairs = [pair("dc.c.z", "db.c.y"), pair("db.c.y", "da.c.x")]
    assert references.fold_references(pairs).rows() == [("da.c.x", "dc.c.z", True, True), ("db.c.y", "dc.c.z", True, False)]
    assert references.fold_references(pairs, AnalysisConfig(transitive_references=False)).rows()[0][:2] == ("da.c.x", "db.c.y")


def test_key_read_pair_needs_a_field_without_references():
    known = {"f1": "dc.c.z", "f2": "db.c.y", "op1": "W", "op2": "W", "rule": "R1", "req": 1, "creates": True, "src": "db.c.y", "dst": "dc.c.z"}
    reads = {"f1": "da.c.x", "f2": "db.c.y", "op1": "R", "op2": "R", "rule": "R4", "req": 1, "creates": True, "src": "db.c.y", "dst": "da.c.x"}
    assert len(references.fold_references([known, reads]).rows()) == 1
    assert len(references.fold_references([reads, known]).rows()) == 2


def votes(spark, rows):
    """The requests of ``refs`` rows as votes."""
    return spark.createDataFrame([(s, d, r, True) for s, d, _, t in rows for r in t], "src string, dst string, req long, vote boolean")


REFS = "src string, dst string, mandatory boolean, n_votes long, true_reqs array<long>"


def refs(spark, rows):
    return spark.createDataFrame([(s, d, m, 1, t) for s, d, m, t in rows], REFS)


def test_small_shop_has_one_missing_cascade_and_none_when_suppressed(spark):
    facts = ops(spark, [(1, 1, "D", "product_db.product.ID")])
    known = refs(spark, [("inventory_db.inventory.ID", "product_db.product.ID", True, [])])
    found = detectors.missing_cascades(facts, known).collect()
    assert [(r.pending_db, r.fields) for r in found] == [("inventory_db", "inventory_db.inventory.ID")]
    ignored = spark.createDataFrame([("inventory_db", None)], "db string, trigger_db string")
    assert detectors.missing_cascades(facts, known, ignored).count() == 0
    triggered = spark.createDataFrame([("inventory_db", "other_db")], "db string, trigger_db string")
    assert detectors.missing_cascades(facts, known, triggered).count() == 1


def test_cascades_settle_silence_and_queues(spark):
    known = refs(spark, [("b.c.f", "a.c.f", True, []), ("a.c.f", "b.c.g", True, []), ("db5.c.f", "a.c.f", True, []), ("e.c.f", "a.c.f", False, [])])
    settled = detectors.missing_cascades(ops(spark, [(1, 1, "D", "a.c.f"), (1, 1, "D", "b.c.g")]), known).collect()
    assert sorted((r.db, r.pending_db) for r in settled) == [("a", "e"), ("b", "a")]
    silent = detectors.missing_cascades(ops(spark, [(1, 9, "D", "b.c.g"), (1, 1, "W", "e.c.f"), (1, 1, "D", "a.c.f"), (1, 2, "D", "b.c.g")]), known).collect()
    assert sorted((r.seq, r.db) for r in silent) == [(0, "b")]


def test_concurrency_counts_pairs_of_different_requests(spark):
    known = refs(spark, [("b.c.f", "a.c.f", False, [])])
    facts = ops(spark, [(1, 1, "D", "a.c.f"), (1, 1, "W", "b.c.f"), (2, 1, "W", "b.c.f"), (3, 1, "W", "b.c.f"), (3, 1, "D", "a.c.f")])
    r = detectors.concurrent_writes(facts, known).first()
    brute = sum(1 for d in (1, 3) for w in (1, 2, 3) if d != w)
    assert (r.n_deletes, r.n_writes, r.n_conflicts) == (2, 3, brute)


def test_coordination(spark):
    facts = ops(spark, [(1, 1, "Rk", "a.c.f1"), (1, 1, "Rk", "b.c.f2"), (2, 1, "Rk", "a.c.f5"), (2, 1, "Rv", "b.c.f10")])
    made = [("b.c.f2", "a.c.f1", True, [7]), ("a.c.f5", "b.c.f10", True, [7])]
    known, voted = refs(spark, made), votes(spark, made)
    assert [(r.f1, r.f2) for r in detectors.key_coordination(facts, known, voted, False).collect()] == [("b.c.f2", "a.c.f1")]
    assert [(r.f1, r.f2) for r in detectors.key_coordination(facts, known, voted, True).collect()] == [("b.c.f10", "a.c.f5")]
    own = [("b.c.f2", "a.c.f1", True, [1])]
    assert detectors.key_coordination(facts, refs(spark, own), votes(spark, own), False).count() == 0


def test_unique_conflicts_need_a_later_write(spark):
    facts = ops(spark, [(1, 1, "W", "a.c.f3"), (1, 1, "W", "b.c.f1"), (1, 2, "W", "a.c.f3"), (1, 1, "U", "b.c.f1")])
    assert [(r.field, r.n_affected) for r in detectors.unique_conflicts(facts).collect()] == [("a.c.f3", 1)]


def test_empty_facts(spark):
    nothing, none = ops(spark, []), refs(spark, [])
    assert references.infer_references(nothing).count() == 0
    assert detectors.missing_cascades(nothing, none).count() == 0
    assert detectors.concurrent_writes(nothing, none).count() == 0


def test_extreme_pairs_stand_for_all_pairs(spark):
    rng = random.Random(2)
    kinds = [(o, f"{d}.c.f{i}") for o in ("W", "U", "Rk", "Rv", "D") for d in "abc" for i in range(2)]
    rows = [(r, rng.randint(1, 3), *rng.choice(kinds)) for r in range(1, 7) for _ in range(60)]
    facts = ops(spark, rows)
    rules = references.pair_rules(references.operation_pairs(facts))
    firsts = references.first_references(rules)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(firsts) == key(references.first_references(references.pair_rules(references.extreme_pairs(facts, True))))
    assert key(references.reference_votes(rules, firsts)) == key(references.infer_votes(facts))


def test_the_ordered_fold_keeps_one_request_a_reference(spark):
    """Pairs reach the fold sorted, in batches; earlier requests leave only whether one refused."""
    pair = lambda req, op1, op2: {"f1": "da.c.x", "f2": "db.c.y", "rule": "R1" if op1 == "W" else "R2", "req": req, "op1": op1, "op2": op2, "src": "db.c.y", "dst": "da.c.x", "creates": True}
    fold = references.fold_references([pair(i, "R" if i == 7 else "W", "W") for i in range(50)])
    assert fold.rows() == [("db.c.y", "da.c.x", False, False)] and len(fold.votes["db.c.y", "da.c.x"]) == 1
    assert references.fold_references([pair(1, "R", "W"), pair(1, "W", "W"), pair(2, "W", "W")]).rows() == [("db.c.y", "da.c.x", True, False)]
    columns = "app string, turn int, req int, seq1 int, seq2 int, f1 string, f2 string, rule string, op1 string, op2 string, src string, dst string, creates boolean"
    rows = [(app, 0, i, 1, 2, *(pair(i, op, "W")[c] for c in ("f1", "f2", "rule", "op1", "op2", "src", "dst", "creates"))) for app, bad in (("a", 3), ("b", None)) for i in reversed(range(20)) for op in ["R" if i == bad else "W"]]
    found = references.folded_references(spark.createDataFrame(rows, columns))
    assert sorted(map(tuple, found.collect())) == [("a", "db.c.y", "da.c.x", False, False), ("b", "db.c.y", "da.c.x", True, False)]


def test_deletes_do_not_meet_fields_one_by_one(spark):
    """A delete gets the list of its database's fields without those that only its own request writes; fields are no rows beside it."""
    known = refs(spark, [("b.x.f", "a.c.f", False, []), ("b.x.g", "a.c.f", False, [])])
    facts = ops(spark, [(1, 1, "D", "a.c.f"), (1, 2, "W", "b.x.f"), (2, 1, "W", "b.x.g"), (3, 1, "D", "a.c.f")])
    found = detectors.dangerous_deletes(facts, known)
    assert sorted((r.req, r.n_writes, r.fields) for r in found.collect()) == [(1, 1, "b.x.g"), (3, 2, "b.x.f, b.x.g")]
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
