import hashlib
import random
import re

import numpy as np
import pytest

from keelson.llm import queries, substring


def brute(docs):
    seen, out = set(), []
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        cut = [False] * len(w)
        for i in range(len(w) - 19):
            k = tuple(w[i : i + 20])
            if k in seen:
                cut[i : i + 20] = [True] * 20
            seen.add(k)
        left = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        out.append((d, len(w), sum(cut), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out, key=repr)


def longest_before(text, p):
    best = 0
    for q in range(p):
        n = 0
        while p + n < len(text) and text[q + n] == text[p + n]:
            n += 1
        best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(8))
def test_greedy_factors(seed):
    rng = random.Random(seed)
    phrases = [[rng.choice("abc") for _ in range(rng.randint(1, 14))] for _ in range(12)] + [["a"] * 30]
    ref = substring.Reference([" ".join(p).encode() for p in phrases], np.array([len(p) for p in phrases]))
    text = [x for i, p in enumerate(phrases) for x in (*p, i)]
    longest = ref.longest_earlier()
    assert longest.tolist() == [longest_before(text, p) for p in range(len(text))]
    want = []
    for a, b in zip(ref.start.tolist(), ref.stop.tolist(), strict=True):
        while a < b:
            want.append((a, max(1, longest_before(text, a))))
            a += want[-1][1]
    start, size = ref.factors(longest)
    assert sorted(zip(start.tolist(), size.tolist(), strict=True)) == want
    first = {}
    for p in range(len(text) - 4):
        first.setdefault(tuple(text[p : p + 4]), p)
    assert ref.repeated(4).tolist() == [p for p in range(len(text) - 3) if first.get(tuple(text[p : p + 4]), p) < p]


@pytest.mark.parametrize(("seed", "block_words"), [(0, 1 << 20), (1, 200), (2, 0), (3, 1 << 20)])
def test_against_brute_force(spark, tables, odd_docs, monkeypatch, seed, block_words):
    monkeypatch.setattr(substring.repeat_factors, "__defaults__", (20, block_words))
    monkeypatch.setattr(substring.dedup, "__defaults__", (20, "doc_id", "text", block_words))
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", f"w{rng.randint(0, 200)}"])
    passages = [[word() for _ in range(rng.randint(15, 60))] for _ in range(6)]
    docs = []
    for i in range(80):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randint(0, 40))]
        docs.append((i * 3 + 50, " ".join(words)))
    docs += [(900, "same " * 90), (901, "x y " * 40), (902, docs[3][1]), (903, docs[3][1])]
    docs += [(d, t) for d, t in odd_docs if d != 3 and d is not None] + [(None, docs[5][1])]
    rng.shuffle(docs)
    got = queries.op6_substring_dedup(spark, tables(documents=(docs, "doc_id long, text string"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs)


def test_repeated_rows_are_one_document_and_empty_tables(spark, tables):
    text = " ".join(f"w{i}" for i in range(30))
    rows = queries.op6_substring_dedup(spark, tables(documents=([(1, text), (1, text), (2, text)], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(1, 0), (1, 0), (2, 30)]
    assert queries.op6_substring_dedup(spark, tables(documents=([], "doc_id long, text string"))).collect() == []
    clash = spark.createDataFrame([(1, text, "mine")], "doc_id long, text string, kept_text string")
    found, names = substring.dedup(clash)
    assert found.first()["kept_text"] == "mine" and found.first()[names[2]] == text
