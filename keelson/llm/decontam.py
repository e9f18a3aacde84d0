"""Benchmark decontamination with an FM-index per shard of training text.

A shard is a run of documents of one record batch with about ``SHARD_WORDS`` words at most (one document is never split).  Its words become
numbers of the phrase vocabulary; whatever the vocabulary lacks is 0, and runs between zeros that are shorter than
the shortest phrase are left out, as no phrase can lie in them.  Over what remains ``FMIndex`` builds the suffix
array, the Burrows-Wheeler transform in a wavelet matrix (ranks by popcounts), and a sample of suffix positions.  All
phrases are searched backward together, one word per step; the rows that a phrase ends up with are located by
walking to the next sampled position.  Occurrences become word spans, merged per document.

The phrases travel to the executors inside the task closure, in blocks of at most ``PHRASE_BYTES`` of item text.  A larger benchmark
takes a pass over the documents for each block; a pass writes only what it finds, by a digest of the text, and the driver holds one
block at a time.  The finds of all blocks are merged, then joined to the documents once, so results don't depend on the blocks.

Defined results for odd input: null or wordless texts have no words and no hits; null or wordless items have no
windows; items with equal windows are all reported, an item id that repeats once; repeated rows are judged alike, each on its own; long
texts are searched whole; an empty table gives an empty result, an empty benchmark finds nothing; columns
whose names clash with the added ones stay, the added ones get numbers (``added_columns``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import stage, unstage
from .common import arrow_map, fresh_name, quoted, utf8_values

WINDOW = 10
SHARD_WORDS = 1 << 20
PHRASE_BYTES = 8 << 20
SAMPLE = 8
ADDED = ("n_words", "spans", "items")

#: ASCII bytes that are no letter or digit become blanks, A-Z become a-z, bytes of other code points stay.
FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """Words of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z."""
    return text.translate(FOLD).split() if text else []


class WaveletMatrix:
    """Ranks of symbols below ``1 << bits`` in a fixed sequence: one bit vector per bit of the symbol."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.n, self.bits = len(symbols), bits
        self.words, self.counts, self.zeros = [], [], []
        seq = symbols.astype(np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> np.uint32(level)) & np.uint32(1)).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(64 + -len(bit) % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][block] + np.bitwise_count(self.words[level][block] & mask).astype(np.int64)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros_like(at), at.copy()
        for k in range(self.bits):
            bit = (symbols >> (self.bits - 1 - k)) & 1
            one_low, one_high = self._ones(k, low), self._ones(k, high)
            low = np.where(bit, self.zeros[k] + one_low, low - one_low)
            high = np.where(bit, self.zeros[k] + one_high, high - one_high)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """Symbols at the given positions."""
        out = np.zeros(len(at), np.int64)
        for k in range(self.bits):
            bit = ((self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(k, at)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
            out = out * 2 + bit
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order, by prefix doubling that sorts only what is still tied."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ranked = text[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if n else np.zeros(0, bool)
    rank = np.empty(n, np.int64)
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1] if n else 0
    width = 1
    # Slots of `order` whose suffix shares its rank with another one.
    tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]]))) if n else np.zeros(0, np.int64)
    while len(tied):
        at = order[tied]
        after = at + width
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        first = rank[at]
        by = np.lexsort((second, first))
        at, first, second = at[by], first[by], second[by]
        order[tied] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        rank[at] = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        tied = tied[~(new & np.concatenate([new[1:], [True]]))]
        width *= 2
    return order


class FMIndex:
    """Backward search and sampled location over a sequence of numbers below ``alphabet``; the end mark is 0."""

    def __init__(self, text: np.ndarray, alphabet: int) -> None:
        full = np.concatenate([text.astype(np.int64) + 1, [0]])  # the end mark sorts first
        sa = suffix_array(full)
        self.n = len(full)
        self.bwt = WaveletMatrix(full[sa - 1], max(1, int(alphabet + 1).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(full, minlength=alphabet + 1))])
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases of equal length, one phrase per row of the matrix."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[live, step] + 1
            low[live] = self.first[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.bwt.rank(symbol, high[live])
            dead = low[live] >= high[live]
            low[live[dead]] = high[live[dead]] = 0
            live = live[~dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps to a sampled row are counted and added."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.samples[self.sample_rank[at[done]]] + steps[live[done]]
            live, at = live[~done], at[~done]
            symbol = self.bwt.access(at)
            at = self.first[symbol] + self.bwt.rank(symbol, at)
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """Windows of one block of items: their words by number, grouped by length, with the items that own them."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    by_length: dict[int, np.ndarray] = field(default_factory=dict)
    owners: dict[int, list[list[int]]] = field(default_factory=dict)
    item_ids: list = field(default_factory=list)

    @classmethod
    def of(cls, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW) -> Phrases:
        out, found = cls(), {}
        for item_id, text in items:
            words = fold_words(text)
            if not words:
                continue
            own = len(out.item_ids)
            out.item_ids.append(item_id)
            ids = tuple(out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words)
            size = min(window, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(size, {}).setdefault(ids[i : i + size], set()).add(own)
        for size, windows in found.items():
            out.by_length[size] = np.array(list(windows), dtype=np.int64)
            out.owners[size] = [sorted(o) for o in windows.values()]
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, with overlapping or touching spans joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search_shard(words: list[np.ndarray], phrases: Phrases) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """For each document (its words by number): spans of its words that phrases cover, and the items found."""
    found: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in words]
    if not phrases.by_length or not words:
        return found
    flat = np.concatenate([x for w in words for x in (w, np.zeros(1, np.int64))])
    edge = np.flatnonzero(flat == 0)
    start = np.concatenate([[0], edge[:-1] + 1])
    long = edge - start >= min(phrases.by_length)
    if not long.any():
        return found
    # Keep the runs that can hold a phrase, each with the zero that ends it.
    sizes = (edge - start + 1)[long]
    ends = np.cumsum(sizes)
    kept = np.repeat(start[long] - (ends - sizes), sizes) + np.arange(ends[-1])
    index = FMIndex(flat[kept], len(phrases.vocabulary) + 2)
    first_word = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    for size, matrix in phrases.by_length.items():
        low, high = index.search(matrix)
        hit = np.flatnonzero(high > low)
        counts = (high - low)[hit]
        if not len(hit):
            continue
        rows = np.repeat(low[hit] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        at = kept[index.locate(rows)]
        doc = np.searchsorted(first_word, at, side="right") - 1
        for p, d, s in zip(np.repeat(hit, counts).tolist(), doc.tolist(), (at - first_word[doc]).tolist(), strict=True):
            found[d][0].append((s, s + size))
            found[d][1].update(phrases.owners[size][p])
    return [(merge_spans(s), i) for s, i in found]


def added_columns(columns: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in ADDED:
        out[c] = fresh_name(c, [*columns, *out.values()])
    return out


def _phrase_blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    """Items in blocks of at most ``limit`` bytes (or one item), streamed to the driver one block at a time."""
    size, block = 0, []
    for r in benchmark.select(id_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        text = r[1].encode()
        if block and size + len(text) > limit:
            yield block
            size, block = 0, []
        size += len(text)
        block.append((r[0], text))
    if block:
        yield block


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_SPANS_SQL = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _search_batch(texts: list[bytes | None], phrases: Phrases) -> tuple[list[int], list[list[dict]], list[list[str]]]:
    """Number of words, merged spans and ids of found items of each text."""
    sizes, found, shard, held, get = [], [], [], 0, phrases.vocabulary.get
    for text in texts:
        words = fold_words(text)
        sizes.append(len(words))
        shard.append(np.fromiter((get(w, 0) for w in words), dtype=np.int64, count=len(words)))
        held += len(words)
        if held >= SHARD_WORDS:
            found += search_shard(shard, phrases)
            shard, held = [], 0
    found += search_shard(shard, phrases)
    spans = [[{"start": a, "end": b} for a, b in s] for s, _ in found]
    return sizes, spans, [sorted({str(phrases.item_ids[k]) for k in i}) for _, i in found]


def _hits_of(texts: DataFrame, phrases: Phrases, block: int) -> DataFrame:
    """(digest, block, spans, items) of the texts (digest, text) that a block's phrases are found in; a batch reports equal texts once."""

    def run(batches):
        for b in batches:
            distinct = dict(zip(b.column(0).to_pylist(), utf8_values(b.column(1)), strict=True))
            _, spans, items = _search_batch(list(distinct.values()), phrases)
            rows = [(d, s, i) for d, s, i in zip(distinct, spans, items, strict=True) if s]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([block] * len(rows), pa.int32()), pa.array([r[1] for r in rows], _SPANS), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=["digest", "block", "spans", "items"],
            )

    schema = T.StructType([T.StructField("digest", T.StringType()), T.StructField("block", T.IntegerType()), T.StructField("spans", _SPANS_SQL), T.StructField("items", T.ArrayType(T.StringType()))])
    return arrow_map(texts, run, schema)


def find_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with n_words (long), spans (merged word spans that benchmark windows cover) and items (ids, as
    strings, of the items with a window in the text); and the names of these columns."""
    names, where = added_columns(docs.columns), docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], _SPANS_SQL), T.StructField(names["items"], T.ArrayType(T.StringType()))])
    blocks = _phrase_blocks(benchmark, id_col, item_text_col, phrase_bytes)
    first, second = next(blocks, []), next(blocks, None)

    def add(batch: pa.RecordBatch, columns: int, sizes: list[int], spans: list, items: list) -> pa.RecordBatch:
        arrays = [*batch.columns[:columns], pa.array(sizes, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:columns], *names.values()])

    if second is None:
        phrases = Phrases.of(first, window)

        def whole(batches):
            for b in batches:
                yield add(b, b.num_columns, *_search_batch(utf8_values(b.column(where)), phrases))

        return arrow_map(docs, whole, schema), names

    text = F.col(f"`{text_col}`")
    digest = F.md5(text.cast("binary"))
    texts, hits = docs.select(digest.alias("digest"), text.alias("text")).where(text.isNotNull()), []
    for number, items in enumerate(chain([first, second], blocks)):
        hits.append(stage(_hits_of(texts, Phrases.of(items, window), number), "benchmark-hits"))
    merged = reduce(DataFrame.unionByName, hits).groupBy("digest", "block").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))
    found_digest, found_spans, found_items = (fresh_name(x, docs.columns) for x in ("hit_digest", "hit_spans", "hit_items"))
    merged = merged.groupBy(F.col("digest").alias(found_digest)).agg(F.flatten(F.collect_list("spans")).alias(found_spans), F.array_distinct(F.flatten(F.collect_list("items"))).alias(found_items))
    merged = stage(merged, "merged-hits")  # written by itself, so that the join can split a text that repeats over tasks
    unstage(*hits)
    joined = docs.join(merged, digest == F.col(found_digest), "left").select(*(F.col(quoted(c)) for c in (*docs.columns, found_spans, found_items)))

    def finish(batches):
        for b in batches:
            n = b.num_columns - 2
            spans = [[{"start": x, "end": y} for x, y in merge_spans([(s["start"], s["end"]) for s in row or []])] for row in b.column(n).to_pylist()]
            yield add(b, n, [len(fold_words(t)) for t in utf8_values(b.column(where))], spans, [sorted(i or []) for i in b.column(n + 1).to_pylist()])

    return arrow_map(joined, finish, schema), names


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` (word numbers) and what stands between them."""
    if not spans:
        return text
    raw = text.encode()
    folded = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    starts = np.flatnonzero(folded & ~np.concatenate([[False], folded[:-1]]))
    ends = np.flatnonzero(folded & ~np.concatenate([folded[1:], [False]])) + 1
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    out.append(raw[at:])
    return b"".join(out).decode()


def clean_texts(texts: list[bytes | None], phrases: Phrases) -> list[bytes | None]:
    """Texts without the words that phrases cover, searched again until nothing is found (a cut may bring words together)."""
    out, todo = list(texts), [i for i, t in enumerate(texts) if t]
    while todo:
        found, shard, held, at = [], [], 0, []
        for i in todo:
            words = fold_words(out[i])
            shard.append(np.fromiter((phrases.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words)))
            at.append(i)
            held += len(words)
            if held >= SHARD_WORDS:
                found += zip(at, search_shard(shard, phrases), strict=True)
                shard, held, at = [], 0, []
        found += zip(at, search_shard(shard, phrases), strict=True)
        todo = []
        for i, (spans, _) in found:
            if spans:
                out[i] = remove_spans(out[i].decode(), spans).encode()
                todo.append(i)
    return out


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, phrase_bytes: int = PHRASE_BYTES) -> DataFrame:
    """``docs`` with the words that benchmark windows cover cut out of ``text_col``; clean texts stay as they are, null stays null.

    Windows are judged on the whole text by all items, then cut together; cut texts are judged again until nothing is found.  With one block of
    items that takes one pass; with more, a round of passes for the texts that the last round cut.
    """
    where = docs.columns.index(text_col)
    blocks = _phrase_blocks(benchmark, id_col, item_text_col, phrase_bytes)
    first, second = next(blocks, []), next(blocks, None)
    blocks.close()

    def with_texts(batch: pa.RecordBatch, texts: list[bytes | None], columns: int) -> pa.RecordBatch:
        cleaned = pa.array([None if t is None else t.decode() for t in texts], pa.string())
        return pa.RecordBatch.from_arrays([cleaned if i == where else c for i, c in enumerate(batch.columns[:columns])], names=batch.schema.names[:columns])

    if second is None:
        phrases = Phrases.of(first, window)

        def clean(batches):
            for b in batches:
                yield with_texts(b, clean_texts(utf8_values(b.column(where)), phrases), b.num_columns)

        return arrow_map(docs, clean, docs.schema)

    def cut(batches):
        for b in batches:
            n, texts = b.num_columns - 1, utf8_values(b.column(where))
            spans = [[(s["start"], s["end"]) for s in row] for row in b.column(n).to_pylist()]
            yield with_texts(b, [remove_spans(t.decode(), s).encode() for t, s in zip(texts, spans, strict=True)], n)

    todo, done = docs, []
    while True:
        found, names = find_contamination(todo, benchmark, text_col, id_col, item_text_col, window, phrase_bytes)
        judged = stage(found, "judged")
        is_hit = F.size(F.col(f"`{names['spans']}`")) > 0
        done.append(judged.where(~is_hit).select(*(F.col(quoted(c)) for c in docs.columns)))
        hit = judged.where(is_hit).select(*(F.col(quoted(c)) for c in (*docs.columns, names["spans"])))
        if hit.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo = stage(arrow_map(hit, cut, docs.schema), "cut-texts")
