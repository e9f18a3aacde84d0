import zlib

import numpy as np

from keelson.llm import queries, toxicity


def test_gradients():
    net = toxicity.Network.fresh(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    data = toxicity.Texts([b"alpha beta gamma delta", b"one two three"])
    index, y = data.index(np.arange(2)), np.array([1.0, 0.0])

    def loss():
        p = 1 / (1 + np.exp(-net.forward(net.inputs(data.features).astype(np.float64), index)))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = net.gradients(data.features, net.inputs(data.features).astype(np.float64), index, y)
    for k, at in [("Wf", (3, 5)), ("Ub", (2, 7)), ("Uf", (2, 27)), ("A", (3, 2)), ("v", (1,)), ("u", (4,)), ("words", (int(data.features.word[1]), 2)), ("grams", (int(data.features.gram[3]), 1))]:
        old, step = net.p[k][at], 1e-3
        net.p[k][at] = old + step
        up = loss()
        net.p[k][at] = old - step
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 1e-4 + 0.02 * abs(g[k][at])


def test_windows_cover_whole_texts():
    sizes = np.array([0, 1, 32, 33, 100, 5000])
    doc, first = toxicity.windows_of(sizes)
    for i, n in enumerate(sizes):
        covered = set().union(*(range(s, s + toxicity.WINDOW) for s in first[doc == i].tolist()), set())
        assert set(range(n)) <= covered and (n > 0) == bool((doc == i).any())


def test_held_out_accuracy_and_odd_rows(spark, tables, odd_docs):
    rng = np.random.default_rng(5)
    plain = [f"{a}{b}" for a in "bcdfg" for b in ("an", "or", "ist", "el")]
    docs, labels = [], []
    for i in range(600):
        words = list(rng.choice(plain, rng.integers(20, 150)))
        if toxic := i % 5 == 0:
            words[rng.integers(len(words))] = rng.choice(["zukkan", "zukkor", "zukkist", "zukkel"])
        docs.append((1000 + i, " ".join(words)))
        labels.append((1000 + i, 1, int(toxic)))
    folder = tables(documents=(docs + odd_docs, "doc_id long, text string"), labels=(labels, "doc_id long, quality int, toxic int"))
    rows = queries.op3_toxicity(spark, folder).collect()
    assert len(rows) == len(docs) + len(odd_docs)
    truth = {d: t for d, _, t in labels}
    for r in rows:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert {r.score for r in rows if r.doc_id in (1, 2, 4)} == {0.0}


def test_without_labels(spark, tables):
    folder = tables(documents=([(1, "a b")], "doc_id long, text string"), labels=([], "doc_id long, quality int, toxic int"))
    assert [r.score for r in queries.op3_toxicity(spark, folder).collect()] == [0.0]


def test_what_the_driver_learns_from_is_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, seed=7: seen.append((texts, labels)))
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = [(i, f"t{i}", "mine") for i in ids] + [(ids[0], "other", "mine")] * 50 + [(ids[1], "x " * toxicity.SAMPLE_CHARS, "mine"), (ids[2], None, "mine"), (None, "n", "mine")]
    labels = [(i, k % 2) for k, i in enumerate(ids)] + [(ids[0], 1), (None, 1)]
    toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, "doc_id long, toxic int"), sample=40)
    (texts, y), = seen
    assert len(texts) <= 80 and max(map(len, texts)) <= toxicity.SAMPLE_CHARS and set(y) == {0, 1}
    again = dict(zip(texts, y, strict=True))
    assert len(again) == len(texts) and all(again[f"t{i}".encode()] == k % 2 for k, i in enumerate(ids) if k > 2 and f"t{i}".encode() in again)


def test_empty_table_and_other_columns(spark, tables):
    labels = ([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert queries.op3_toxicity(spark, tables(documents=([], "doc_id long, text string"), labels=labels)).collect() == []
    clash = tables(documents=([(1, "a b", 0.5, "x")], "doc_id long, text string, score double, toxic string"), labels=labels)
    assert [(r.doc_id, r.predicted) for r in queries.op3_toxicity(spark, clash).collect()] == [(1, 1)]


def test_any_half_window_lies_whole_in_a_window():
    doc, first = toxicity.windows_of(np.array([300]))
    for at in range(300 - toxicity.STRIDE):
        assert any(s <= at and at + toxicity.STRIDE <= s + toxicity.WINDOW for s in first.tolist())


def test_labels_without_usable_documents_do_not_use_up_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, seed=7: seen.append(dict(zip(texts, labels, strict=True))))
    docs = [(i, f"t{i}" if i % 3 else "x " * toxicity.SAMPLE_CHARS) for i in range(600)]
    labels = [(i, i % 2) for i in range(15_000)]
    usable = {f"t{i}".encode(): i % 2 for i in range(600) if i % 3 and zlib.crc32(str(i).encode()) % 4 != 2}
    d, l = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")  # noqa: E741
    toxicity.learn(d, l, sample=200)
    assert seen[0] == usable
    monkeypatch.setattr(toxicity, "SAMPLE_TEXT", 100)
    toxicity.learn(d, l, sample=200)
    assert set(seen[1].items()) < set(usable.items()) and all(sum(len(t) for t, y in seen[1].items() if y == c) <= 100 for c in (0, 1))


def plain_score(net, text):
    """The score of a text word by word, with plain numbers: no batches, no masks, no padding."""
    sig = lambda x: 1 / (1 + np.exp(-x))
    p, words, best = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.fold_words(text.encode()), 0.0
    inputs = []
    for w in words:
        f = toxicity.Features([w])
        inputs.append(np.concatenate([p["words"][f.word[0]], sum(p["grams"][g] for g in f.gram) / len(f.gram)]))
    starts = [0]
    while starts[-1] + toxicity.WINDOW < len(words):
        starts.append(starts[-1] + toxicity.STRIDE)
    for s in starts:
        part = inputs[s : s + toxicity.WINDOW]
        states = {}
        for d, seq in (("f", part), ("b", part[::-1])):
            h, out = np.zeros(toxicity.HIDDEN), []
            for x in seq:
                g, u, n = x @ p[f"W{d}"] + p[f"c{d}"], h @ p[f"U{d}"], toxicity.HIDDEN
                z, r = sig(g[:n] + u[:n]), sig(g[n : 2 * n] + u[n : 2 * n])
                h = (1 - z) * np.tanh(g[2 * n :] + r * u[2 * n :]) + z * h
                out.append(h)
            states[d] = out if d == "f" else out[::-1]
        both = [np.concatenate(x) for x in zip(states["f"], states["b"], strict=True)]
        e = [np.tanh(h @ p["A"] + p["a"]) @ p["v"] for h in both]
        w = np.exp(np.array(e) - max(e))
        pooled = sum(a * h for a, h in zip(w / w.sum(), both, strict=True))
        best = max(best, float(sig(pooled @ p["u"] + p["bias"][0])))
    return best


def test_scores_word_by_word(spark):
    rng = np.random.default_rng(9)
    vocabulary = ["alpha", "beta", "zukkan", "é", "漢字", "longerword" * 3, "x1"]
    texts = [" ".join(rng.choice(vocabulary, n)) for n in (1, 5, 31, 32, 33, 48, 49, 150)]
    net = toxicity.train([t.encode() for t in texts], [i % 2 for i in range(len(texts))])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score_documents(docs, net).collect()}
    assert all(abs(got[i] - plain_score(net, t)) < 1e-4 for i, t in enumerate(texts))
