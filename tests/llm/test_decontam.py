import random
import re

import numpy as np
import pytest

from keelson.llm import decontam, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def fold(t):
    return WORD.findall(low(t))


def brute(text, items):
    w, hit, found = fold(text), set(), set()
    for item, t in items:
        b = fold(t)
        n = min(10, len(b))
        windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("seed", range(20))
def test_suffix_array_and_index(seed):
    rng = random.Random(seed)
    text = np.array([rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(1, 300))])
    order = decontam.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    index = decontam.FMIndex(text, 12)
    for n in (1, 2, 5):
        phrases = np.array([[rng.randint(0, 9) for _ in range(n)] for _ in range(20)] + [text[i : i + n].tolist() for i in range(0, len(text) - n + 1, 7)])
        low, high = index.search(phrases)
        for p, a, b in zip(phrases.tolist(), low, high, strict=True):
            at = sorted(index.locate(np.arange(a, b)).tolist()) if b > a else []
            assert at == [i for i in range(len(text) - n + 1) if text[i : i + n].tolist() == p]


def test_against_brute_force(spark, odd_docs):
    rng = random.Random(1)
    vocabulary = [f"W{i}" for i in range(12)]
    say = lambda n: " ".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-"]) for _ in range(n))
    items = [(i, say(rng.choice([1, 3, 9, 10, 14, 40]))) for i in range(15)] + [(90, None), (91, "!!"), (92, "a b c d e f"), (93, "A b,c d e f")]
    docs = [(i, say(rng.randint(0, 60))) for i in range(40)] + [(100 + i, say(5) + t + say(5)) for i, t in items[:15]] + odd_docs
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((brute(t, items) for _, t in docs), key=repr)
    for size in (8 << 20, 60):  # the second takes a pass for nearly every item
        found, names = decontam.find_contamination(d, b, phrase_bytes=size)
        got = [(r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), sorted(set(r["items"]))) for r in found.collect()]
        assert sorted(got, key=repr) == want
    want = sorted(((i, cleaned_brute(t, items)) for i, t in docs), key=repr)
    for size in (8 << 20, 60):
        cleaned = decontam.remove_contamination(d, b, phrase_bytes=size).collect()
        assert sorted(((r["doc_id"], r["text"]) for r in cleaned), key=repr) == want


def cleaned_brute(text, items):
    """Windows of all items, cut together, until none is found."""
    while text and brute(text, items)[1]:
        w, hit = fold(text), set()
        for _, t in items:
            b = fold(t)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        places, out, at, k = [m.span() for m in WORD.finditer(low(text))], "", 0, 0
        while k < len(w):
            if k in hit:
                out += text[at : places[k][0]]
                while k + 1 < len(w) and k + 1 in hit:
                    k += 1
                at = places[k][1]
            k += 1
        text = out + text[at:]
    return text


@pytest.mark.parametrize("size", [8 << 20, 60])
def test_overlapping_windows_of_two_blocks_are_cut_together(spark, size):
    items = spark.createDataFrame([(1, "a b c d e f g h i j " + "pad " * 20), (2, "f g h i j k l m n o")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j k l m n o y"), (2, None), (1, "x y")], "doc_id long, text string")
    cleaned = decontam.remove_contamination(docs, items, phrase_bytes=size).collect()
    assert sorted((r.doc_id, r.text or "") for r in cleaned) == [(1, "x  y"), (1, "x y"), (2, "")]


def test_empty_tables_and_clashing_columns(spark, tables):
    empty_docs, empty_items = ([], "doc_id long, text string"), ([], "item_id long, text string")
    assert queries.op2_benchmark_decontamination(spark, tables(documents=empty_docs, benchmark=([(1, "a b")], "item_id long, text string"))).collect() == []
    rows = queries.op2_benchmark_decontamination(spark, tables(documents=([(1, "a b")], "doc_id long, text string"), benchmark=empty_items)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in rows] == [(2, 0, False)]
    clash = spark.createDataFrame([("a b", 7)], "text string, spans int")
    found, names = decontam.find_contamination(clash, spark.createDataFrame([(1, "b")], "item_id long, text string"))
    assert found.first()[names["spans"]] == [(1, 2)] and found.first()["spans"] == 7


def test_cutting_keeps_the_rest():
    assert decontam.remove_spans("One, two; three four.", [(1, 3)]) == "One,  four."
    assert decontam.remove_spans("x", []) == "x"


def test_an_item_that_repeats_counts_once(spark, tables):
    folder = tables(documents=([(1, "a b c")], "doc_id long, text string"), benchmark=([(7, "b c"), (7, "b c"), (7, "a")], "item_id long, text string"))
    r = queries.op2_benchmark_decontamination(spark, folder).first()
    assert (r.n_hit, r.n_items) == (3, 1)
