import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from keelson.llm import packing, queries


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b: k for k, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[room] += items[i]
            place(i + 1, bins)
            bins[room] -= items[i]
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(150))
def test_reduction_never_costs_a_bin(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 17, 30])
    items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 9))]
    counts = {w: items.count(w) for w in items}
    fixed, left = packing.reduce_dominated(counts, capacity)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sorted(rest + [w for b, n in fixed for _ in range(n) for w in b]) == sorted(items)
    assert all(sum(b) <= capacity for b, _ in fixed)
    assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(items, capacity)
    packed = packing.solve(counts, capacity)
    assert sorted(w for b, n in packed for _ in range(n) for w in b) == sorted(items)


def test_pieces_and_places(spark, tables, odd_docs):
    docs = [(i + 10, "Hello, world. " * (i % 60) + "<|endoftext|> it's 12'5 É.") for i in range(80)] + odd_docs
    rows = queries.op10_best_fit_packing(spark, tables(documents=(docs, "doc_id long, text string"))).collect()
    tokenizer, want = Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json")), []
    for d, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert queries.op10_best_fit_packing(spark, tables(documents=([], "doc_id long, text string"))).collect() == []


def test_other_columns_are_ignored(spark):
    docs = spark.createDataFrame([(7, "a b", 3, "x"), (7, "a b", 3, "x")], "doc_id long, text string, length int, bp string")
    rows = packing.pack(docs).collect()
    assert len(rows) == 2 and len({(r.sequence_id, r.offset) for r in rows}) == 2 and {r.doc_id for r in rows} == {7}


def test_ids_of_odd_texts():
    rng = random.Random(6)
    coder, tokenizer = packing.word_ids(packing.tokenizer_path("word_bpe_49k.json")), Tokenizer.from_file(packing.tokenizer_path("word_bpe_49k.json"))
    parts = ["a", "the", "Word", "it's", "'s", "'", "don't", "É", "ß", "İ", "ı", "ñ", "µ", "ª", "e\u0301", "\u0301", "漢字", "9", "12", "½", "²", "_", "-", "...", "###", "$%", "<|", "|>", "<|endoftext|>", "</w>", " ", "\n", "\u00a0", "\u2028", "\x1c", "\x85", ".", ",", "x.y", "🙂", "Σ", "ς", "ſ", "ŉ", "ǅ", "\u00ad", "\x00", "ĳ", "İstanbul", "ĭ", "į"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 8)))
        want = np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert coder.encode(text.encode()) == want, repr(text)
    for i in range(1, 0x250):
        for text in (chr(i), f"a{chr(i)}b", f"{chr(i)}{chr(i)}"):
            assert coder.encode(text.encode()) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
