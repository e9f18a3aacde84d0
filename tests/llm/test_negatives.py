import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import negatives, queries


def brute(rows, w=negatives.Wanted()):
    """(anchor, positive, rank, negative, positive score, negative score); rows are (id, label, vector)."""
    rows = sorted({(i, k, tuple(v)) for i, k, v in rows if None not in (i, k, v) and None not in v})
    rows = list({r[0]: r for r in reversed(rows)}.values())
    dim = max((len(r[2]) for r in rows), default=0)
    full = {i: (k, [*v, *[0] * (dim - len(v))]) for i, k, v in rows}
    out = set()
    for a, (label, v) in full.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, u, strict=True)), i, k) for i, (k, u) in full.items() if i != a)
        positives = [(-s, i) for s, i, k in scored if k == label][: w.positives]
        for ps, p in positives:
            fits = [(-s, i) for s, i, k in scored if k != label and w.low * ps <= -100 * s <= w.high * ps][: w.negatives]
            out |= {(a, p, r + 1, i, ps, s) for r, (s, i) in enumerate(fits)}
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    found = negatives.mine(df, F.col("vec_id") % 100 == 0, **kw).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def clustered(n, seed, dim=6, spread=4):
    rng = random.Random(seed)
    centres = [[rng.randint(-60, 60) for _ in range(dim)] for _ in range(8)]
    return [(i, rng.randint(0, 3), [x + rng.randint(-spread, spread) for x in rng.choice(centres)]) for i in range(n)]


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(negatives, "GROUP", 3)
    monkeypatch.setattr(negatives, "BLOCK", 200)
    monkeypatch.setattr(negatives, "TILE", 64)
    rows = clustered(1500, 1)
    assert mined(spark, rows) == brute(rows)


def test_shared_vectors_ties_and_odd_rows(spark):
    same = [(i, i % 2, [3, 4]) for i in range(0, 1200, 4)]  # anchors among them share vector and label
    rows = [*same, *[(i, 5, [2, 2]) for i in range(1, 400, 4)], (None, 1, [1, 1]), (7001, None, [1, 1]), (7002, 1, None), (7003, 1, [None, 1]), (7100, 2, []), (7200, 3, [5]), (7201, 3, [4, 0]), (7202, 4, [2, 0]), (7200, 3, [5]), (2, 9, [9, 9]), (2, 8, [1, 0])]
    assert mined(spark, rows) == brute(rows)


def test_negative_scores_and_empty_tables(spark):
    rows = [(0, 1, [10, 0]), (1, 1, [-10, 0]), (2, 1, [0, 5]), (3, 2, [0, 7]), (4, 2, [-5, 0]), (100, 2, [0, -1])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == set() and mined(spark, [(1, 1, [1])]) == set()
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [2**40, 1])])


def test_large_components_stay_exact(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.randint(-(2**26), 2**26) for _ in range(4)]) for i in range(300)]
    assert mined(spark, rows) == brute(rows)


def test_cells_are_left_out(spark):
    """On clustered rows a group is served by a part of the table."""
    rows = clustered(6000, 2, dim=8, spread=2)
    packed = negatives._packed(spark.createDataFrame(rows, "vec_id long, label long, vector array<long>"), 8, "<i2").cache()
    space = negatives._space(packed, 8, 64, "<i2")
    cells = negatives._celled(packed, space)
    anchors = packed.where("vec_id % 100 = 0").withColumn("group", F.lit(0))
    one = anchors.limit(1)
    spans = negatives._intervals(one, space, negatives.Wanted(), False)
    served = cells.join(spans, ["cell", "label"]).where("away >= near AND away <= far")
    assert 6 <= served.count() < 3000
    assert np.isclose(cells.agg(F.min("away")).first()[0], 0)


def test_query_takes_out_odd_rows(spark, tables):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.25]), (2, 2, [0.3, 0.2]), (7, 0, [0.5, -0.1]), (9, 1, [0.2, 0.1]), (3, None, [0.2, 0.1]), (4, 2, None), (5, 2, [nan, 1.0]), (6, 2, [inf, 1.0]), (8, 3, [None, 0.1])]
    out = queries.op11_hard_negatives(spark, tables(embeddings=([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string"))).collect()
    whole = [(i, (k + 1) % 10 if i % 7 == 0 else k, [int(np.floor(256 * np.float32(x).astype(float))) for x in v]) for i, k, v in rows if k is not None and v and None not in v and np.isfinite(v).all()]
    assert {tuple(r) for r in out} == brute(whole) and {(r.anchor_id, r.positive_id, r.negative_id) for r in out} == {(0, 2, 9)}
