import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import jaccard


def brute(docs):
    sets = []
    for _, t in docs:
        w = (t or "").encode().split()
        n = min(5, len(w))
        sets.append({b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    links = [[j for j, b in enumerate(sets) if j != i and a and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    key = lambda i: (docs[i][0] is None, docs[i][0] or 0)
    out = []
    for i in range(len(docs)):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in links[todo.pop()] if j not in seen]
            seen |= set(new)
            todo += new
        out.append((docs[i][0], docs[min(seen, key=key)][0], len(links[i])))
    return sorted(out, key=repr)


def corpus(seed, groups, size, words):
    rng = random.Random(seed)
    docs = []
    for _ in range(groups):
        base = [f"w{rng.randint(0, 400)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = f"n{rng.random()}"
            docs.append((len(docs), " ".join(t)))
    return docs


@pytest.mark.parametrize("groups, size, words", [(12, 6, 120), (2, 90, 60)])
def test_against_brute_force(spark, odd_docs, monkeypatch, groups, size, words):
    monkeypatch.setattr(jaccard, "TILE", 16)
    docs = [(i + 1000, t) for i, t in corpus(groups, groups, size, words)] + odd_docs
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(d).collect()), key=repr)
    assert got == brute(docs)


def test_recall_of_every_fiftieth_document(spark, data):
    """Links of the documents whose id is divisible by 50 to all documents, from an inverted index of exact shingles."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    sets, posting = {}, {}
    for d, t in docs:
        w = (t or "").encode().split()
        n = min(5, len(w))
        sets[d] = {b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for g in sets[d]:
            posting.setdefault(g, []).append(d)
    found = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    links = kept = 0
    for q in (d for d in sets if d % 50 == 0):
        shared = Counter(d for g in sets[q] for d in posting[g] if d != q)
        near = [d for d, k in shared.items() if 10 * k >= 8 * (len(sets[q]) + len(sets[d]) - k)]
        links += len(near)
        kept += sum(found[d][0] == found[q][0] for d in near)
        assert found[q][1] <= len(near)
        kept -= (len(near) - found[q][1]) * (len(near) > 0)
    print(f"{links} links, {kept} kept")
    assert kept >= 0.9 * links


def test_repeated_rows_meet_once(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = [(1, text, "a")] * 300 + [(2, text + " more", "b")] * 40 + [(3, "x", "c")] * 5
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string, class_id string")).collect()}
    assert got == {(1, 1, 339), (2, 1, 339), (3, 3, 4)}


def test_one_of_each_and_empty_tables(spark):
    d = spark.createDataFrame([(2, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (1, "a b c d e f g", "y"), (None, "a b c d e f g", "z"), (5, "other words", "u"), (6, "", "v")], "doc_id long, text string, lead_id string")
    assert sorted((r.doc_id, r.lead_id) for r in jaccard.one_of_each(d).collect()) == [(1, "y"), (5, "u"), (6, "v")]
    assert jaccard.near_duplicates(d.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(40)]
    got = {r.id: r.comp for r in jaccard.components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {i: find(i) for i in parent}


def test_recall_is_enough():
    runs = jaccard.runs_for()
    assert jaccard.recall_of(0.8, runs=runs) >= jaccard.RECALL > jaccard.recall_of(0.8, runs=runs - 1)
    assert jaccard.runs_for(0.7) > runs
    with pytest.raises(ValueError):
        jaccard.runs_for(0.3)


def test_recall_counts_the_sketch():
    """Pairs of sets of similarity 0.8 walked down the levels by the operator's own step: they meet at least as often as ``recall_of`` says."""
    rng, pairs = np.random.default_rng(3), 2000
    sketches = []
    for _ in range(pairs):
        u = rng.integers(0, 2**64, 900, dtype=np.uint64)
        sketches.append([np.sort(np.concatenate([u[:720], u[x : x + 90]]))[: jaccard.SKETCH].view(np.int64) for x in (720, 810)])
    common = [{1} for _ in range(pairs)]
    for depth in range(jaccard.MAX_DEPTH):
        rows = [(2 * i + side, p, sketches[i][side]) for i in range(pairs) for p in common[i] for side in (0, 1)]
        ids, paths, values = zip(*rows, strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(paths, pa.int64()), pa.array(values, pa.list_(pa.int64()))], names=["id", "path", "sketch"])
        out = next(jaccard._children(depth)([batch]))
        sides = [(set(), set()) for _ in range(pairs)]
        for i, p in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True):
            sides[i // 2][i % 2].add(p)
        common = [x & y for x, y in sides]
    met = sum(map(bool, common)) / pairs
    assert met >= jaccard.recall_of(0.8, runs=1) - 0.01


def test_groups_of_many_sizes(spark, monkeypatch):
    """One group whose texts grow step by step, some of them long, in tiles of a few sets and few shingles: all links, no pair twice."""
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 3_000)
    rng = random.Random(8)
    words = [f"w{rng.random()}" for _ in range(2_000)]
    docs, n = [], 30
    while n <= len(words):
        for k in range(5):
            docs.append((len(docs), " ".join(words[:n] + [f"own{len(docs)}"] * (k % 2))))
        n = int(n * 1.12) + 1
    docs += [(1000 + i, docs[7][1]) for i in range(3)]
    rng.shuffle(docs)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(d).collect()), key=repr)
    assert got == brute(docs)
    assert len({c for _, c, _ in got}) == 1


def test_tiles_of_a_plan(spark):
    """Tiles of a class meet their own class and its neighbours, each pair of tiles once for each member."""
    rows = [(1, i, 100) for i in range(1500)] + [(1, 5000 + i, 110) for i in range(600)] + [(1, 9000, 5_000_000)] + [(2, 1, 100), (2, 2, 100)]
    d = spark.createDataFrame(rows, "comp long, id long, size int").withColumn("cls", F.floor(F.log("size") / jaccard.CLASS_WIDTH).cast("int"))
    plans = jaccard._size_plan(d.where("comp = 1"))
    plan = [(x.k, x.first) for x in plans.first().plan]
    assert plan in ([(5, 0), (1, 5)], [(3, 0), (2, 3), (1, 5)])
    out = jaccard._pairs_of_tiles(jaccard._size_tiles(d, plans)).collect()
    assert {(r.a, r.b) for r in out if r.comp == 2} == {(0, 0)}
    assert {(r.a, r.b) for r in out if r.comp == 1} == {(a, b) for b in range(5) for a in range(b + 1)} | {(5, 5)}
    assert len({(r.comp, r.id, r.a, r.b) for r in out}) == len(out)


def test_shared_counts_of_two_sides(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40), dtype=np.uint64)) for _ in range(21)]
    offsets, values = np.concatenate([[0], np.cumsum([len(s) for s in sets])]), np.concatenate(sets)
    want = np.array([[len(np.intersect1d(a, b)) for b in sets] for a in sets])
    for part in (1 << 21, 50):
        monkeypatch.setattr(jaccard, "PART_VALUES", part)
        whole = jaccard.shared_counts(values, offsets)
        assert (whole[~np.eye(21, dtype=bool)] == want[~np.eye(21, dtype=bool)]).all()
        assert (jaccard.shared_counts(values, offsets, 8) == want[:8, 8:]).all()
