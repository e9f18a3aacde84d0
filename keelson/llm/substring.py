"""Substring dedup by relative Lempel-Ziv parsing of content-addressed reference blocks.

Parsing every document against every block of every other document would cost the square of the corpus.  Here the
reference is cut by content instead: each window of ``WINDOW`` words belongs to the block named by its anchor, the least
hash of its ``ANCHOR``-word grams.  Equal windows have equal anchors, so one block is all that a window has to be looked up in, and
parsing a document against the blocks of its anchors is parsing it against every block.

1. A document is cut into phrases, the longest runs of windows with one anchor.  A phrase is cut by its content alone, so a long
   repeat consists of equal phrases, except at its two ends.
2. Anchors that occur once in the corpus can hold no repeat; their phrases are dropped before anything is shuffled twice.
3. In each block a phrase equal to an earlier one (smaller document id, or same document and earlier start) is a factor
   as a whole; a block keeps one of each.
4. Where a block holds different phrases, they are its reference, in document order, under a suffix array.  Each phrase is factored greedily
   against all before it: the longest match that starts earlier, then on from its end.  Factors of ``WINDOW`` words or more are duplicate
   spans; windows that reach over the end of a factor are looked up by themselves, as they may occur earlier too.
5. A document's factors are joined; every word under one is removed.

A block of more than ``BLOCK_WORDS`` words (a passage that very many documents end differently) would be too much for one task: the single windows of
its distinct phrases are compared by their hashes instead, which splits over tasks and finds the same windows.

Before any shuffle, repeats inside one batch of documents are settled on the spot (of equal phrases only the first travels), so
a passage that every document has costs one row per batch.  Phrases and windows are told apart by two 64-bit hashes, the anchor and
their own; inside a parsed block words are compared themselves.

Defined results for odd input: null or wordless texts have no words; a null doc_id sorts before all others; rows with equal
id and text count as one document and get equal results; rows with equal id and different texts are ordered by a hash of
the text; texts shorter than a window lose nothing, texts of any length are parsed whole; an empty table gives an empty result; ``dedup``
keeps extra columns, under numbered names where they clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import input_tasks, stage, unstage
from .common import arrow_map, fresh_name, one_batch, utf8_values

WINDOW = 20
ANCHOR = 5
#: Words whose hashes a task remembers before it starts anew.
CACHE_WORDS = 400_000
#: Words of a block that one task may parse; and of all blocks that it parses together.
BLOCK_WORDS, PARSE_WORDS = 1 << 20, 1 << 18

_P = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n >= len(self.up):
            size = max(n + 1, 2 * len(self.up), 4096)
            self.up = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _P), dtype=np.uint64)])
            self.down = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _INV), dtype=np.uint64)])
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """Hashes of word runs in one text, all of them from prefix sums."""

    def __init__(self) -> None:
        self.words, self.powers = WordHashes(), Powers()

    def prefix(self, words: list[bytes]) -> np.ndarray:
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        up, _ = self.powers.upto(len(words) + 1)
        return np.concatenate([[np.uint64(0)], np.cumsum(h * up[: len(h)], dtype=np.uint64)])

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [start, end) for each pair."""
        _, down = self.powers.upto(len(prefix))
        return mix((prefix[end] - prefix[start]) * down[start])

    def windows(self, prefix: np.ndarray, size: int) -> np.ndarray:
        n = max(len(prefix) - size, 0)
        start = np.arange(n)
        return self.runs(prefix, start, start + size)


def anchors(grams: np.ndarray, span: int) -> np.ndarray:
    """Least of each ``span`` neighbours."""
    low, have = grams, 1
    while have < span:
        step = min(have, span - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return low


def repeated_starts(windows: np.ndarray) -> np.ndarray:
    """Positions of windows that occur earlier in the same text."""
    order = np.argsort(windows, kind="stable")
    same = np.concatenate([[False], windows[order][1:] == windows[order][:-1]])
    return np.sort(order[same])


def as_runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions as runs: first position and length of each."""
    if not len(starts):
        return starts, starts
    first = np.flatnonzero(np.concatenate([[True], np.diff(starts) != 1]))
    return starts[first], np.diff(np.concatenate([first, [len(starts)]]))


def _first_of_equal(keys: tuple[np.ndarray, ...], doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For entries in (doc, start) order: which have an equal-keyed entry before them."""
    order = np.lexsort((start, doc, *keys))
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def _ordered_texts(batch: pa.RecordBatch) -> list[tuple[int | None, int, bytes]]:
    """Distinct (id, text hash, text) of a batch in document order."""
    found = {(i, h): t for i, h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_values(batch.column(2)), strict=True) if t}
    return [(i, h, found[i, h]) for i, h in sorted(found, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))]


_PHRASE = pa.schema([("settled", pa.bool_()), ("anchor", pa.int64()), ("phrase", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int32()), ("n", pa.int32())])
_PHRASE_SQL = "settled boolean, anchor long, phrase long, doc long, th long, s int, n int"


def _parse(hasher: Hasher, words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, start, number of windows and hash of each phrase; and starts of windows repeated in the text itself."""
    prefix = hasher.prefix(words)
    at = anchors(hasher.windows(prefix, ANCHOR), window - ANCHOR + 1)
    s, n = _phrases(at)
    content = hasher.runs(prefix, s, s + n + window - 1)
    return at[s], s, n, content, repeated_starts(hasher.windows(prefix, window))


def _phrases(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return s, np.diff(np.concatenate([s, [len(at)]]))


def _anchor_counts(window: int):
    def run(batches):
        hasher = Hasher()
        for b in batches:
            found = []
            for _, _, text in _ordered_texts(b):
                words = text.split()
                if len(words) >= window:
                    at = anchors(hasher.windows(hasher.prefix(words), ANCHOR), window - ANCHOR + 1)
                    found.append(at[_phrases(at)[0]])
            keys, counts = np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.minimum(counts, 2).astype(np.int32))], names=["anchor", "c"])

    return run


def _phrase_rows(window: int):
    def run(batches):
        hasher = Hasher()
        for b in batches:
            docs, parts, own = _ordered_texts(b), [], []
            for d, (_, _, text) in enumerate(docs):
                words = text.split()
                if len(words) < window:
                    continue
                at, s, n, content, repeats = _parse(hasher, words, window)
                parts.append((at, content, np.full(len(s), d), s, n))
                rs, rn = as_runs(repeats)
                own.append((np.full(len(rs), d), rs, rn))
            if not parts:
                continue
            at, content, d, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            settled = _first_of_equal((at, content), d, s)
            rd, rs, rn = (np.concatenate(x).astype(np.int64) for x in zip(*own, strict=True))
            ids, hashes = pa.array([x[0] for x in docs], pa.int64()), pa.array([x[1] for x in docs], pa.int64())
            zero, who = np.zeros(len(rd), np.int64), pa.array(np.concatenate([d, rd]))
            yield one_batch(
                _PHRASE, settled=np.concatenate([settled, np.ones(len(rd), bool)]), anchor=np.concatenate([at.view(np.int64), zero]), phrase=np.concatenate([content.view(np.int64), zero]),
                doc=ids.take(who), th=hashes.take(who), s=np.concatenate([s, rs]).astype(np.int32), n=np.concatenate([n, rn]).astype(np.int32),
            )

    return run


_WINDOW = pa.schema([("settled", pa.bool_()), ("anchor", pa.int64()), ("w", pa.int64()), ("doc", pa.int64()), ("th", pa.int64()), ("s", pa.int32())])


def _window_rows(window: int):
    """Single windows of the phrases asked for in column 3 (list of (s, n, anchor))."""

    def run(batches):
        hasher = Hasher()
        for b in batches:
            docs, parts = [], []
            asked = dict(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(3).to_pylist(), strict=True))
            for d, (i, h, text) in enumerate(_ordered_texts(b)):
                docs.append((i, h))
                runs = asked[i, h]
                s, n = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("s", "n"))
                start = np.repeat(s - (np.cumsum(n) - n), n) + np.arange(n.sum())
                prefix = hasher.prefix(text.split())
                parts.append((np.repeat(np.array([r["anchor"] for r in runs], dtype=np.int64), n), hasher.runs(prefix, start, start + window), np.full(len(start), d), start))
            if not parts:
                continue
            at, w, d, s = (np.concatenate(x) for x in zip(*parts, strict=True))
            ids, hashes, who = pa.array([x[0] for x in docs], pa.int64()), pa.array([x[1] for x in docs], pa.int64()), pa.array(d)
            yield one_batch(_WINDOW, settled=_first_of_equal((at, w), d, s), anchor=at, w=w.view(np.int64), doc=ids.take(who), th=hashes.take(who), s=s.astype(np.int32))

    return run


class Reference:
    """Phrases one after the other, each followed by a mark of its own, under a suffix array."""

    def __init__(self, phrases: list[bytes], sizes: np.ndarray) -> None:
        number: dict[bytes, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for w in b" ".join(phrases).split()), np.int64, int(sizes.sum()))
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        self.stop = self.start + sizes
        text = np.empty(int((sizes + 1).sum()), np.int64)
        inside = np.ones(len(text), bool)
        inside[self.stop] = False
        text[inside], text[self.stop] = words, len(number) + np.arange(len(sizes))
        # Ranks of all runs of 1, 2, 4 ... words; marks make the last ones distinct.
        self.ranks = [np.unique(text, return_inverse=True)[1].astype(np.int64)]
        while (last := self.ranks[-1]).max(initial=0) + 1 < len(text):
            width = 1 << (len(self.ranks) - 1)
            second = np.concatenate([last[width:] + 1, np.zeros(min(width, len(last)), np.int64)])
            self.ranks.append(np.unique(last * (len(text) + 1) + second, return_inverse=True)[1].astype(np.int64))
        self.order = np.argsort(self.ranks[-1])

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at ``p`` and ``q`` begin with alike."""
        size = np.zeros(len(p), np.int64)
        top = len(self.order) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = p + size, q + size
            same = (np.maximum(a, b) <= top) & (self.ranks[k][np.minimum(a, top)] == self.ranks[k][np.minimum(b, top)])
            size[same] += 1 << k
        return size

    def longest_earlier(self) -> np.ndarray:
        """For each position the length of its longest match that starts earlier: that with one of the two nearest suffixes in order that do."""
        n, out = len(self.order), np.zeros(len(self.order), np.int64)
        for order in (self.order, self.order[::-1]):
            near = nearest_smaller(order)
            have = near >= 0
            p, q = order[have], order[near[have]]
            out[p] = np.maximum(out[p], self.common(p, q))
        return out[:n]

    def factors(self, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the greedy factors of all phrases; a word that does not occur earlier is a factor of one word."""
        at, stop, starts, sizes = self.start.copy(), self.stop, [], []
        while len(at):
            size = np.maximum(longest[at], 1)
            starts.append(at)
            sizes.append(size)
            at = at + size
            at, stop = at[at < stop], stop[at < stop]
        return np.concatenate(starts), np.concatenate(sizes)

    def repeated(self, window: int) -> np.ndarray:
        """Positions at which windows start that also start earlier."""
        longest = self.longest_earlier()
        start, size = self.factors(longest)
        wide = size >= window
        edge = np.zeros(len(longest) + 1, np.int64)
        np.add.at(edge, start[wide], 1)
        np.add.at(edge, (start + size)[wide] - window + 1, -1)
        inside = np.cumsum(edge[:-1]) > 0
        # Windows that reach over the end of a factor are looked up in the same array.
        return np.flatnonzero(inside | (longest >= window))


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each element the nearest one before it that is smaller, or -1: jumps from one candidate to that candidate's own."""
    near = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(near >= 0)
    todo = todo[values[near[todo]] > values[todo]]
    while len(todo):
        near[todo] = near[near[todo]]
        todo = todo[near[todo] >= 0]
        todo = todo[values[near[todo]] > values[todo]]
    return near


def _phrase_texts(window: int):
    """The phrases asked for in column 3 (list of (s, n, anchor)) as texts."""

    def run(batches):
        for b in batches:
            asked = dict(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(3).to_pylist(), strict=True))
            rows = []
            for i, h, text in _ordered_texts(b):
                words = text.split()
                rows += [(r["anchor"], i, h, r["s"], r["n"], b" ".join(words[r["s"] : r["s"] + r["n"] + window - 1])) for r in asked[i, h]]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor", "doc", "th", "s", "n", "words"])

    return run


def _parse_blocks(window: int):
    """Runs of repeated windows from phrases (anchor, doc, th, s, n, words) sorted by anchor, doc, th and start.

    Whole blocks are parsed together: a match of a window's length can't lie in another block, as that has another anchor.
    """

    def parse(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        n = table.column(4).to_numpy().astype(np.int64)
        ref = Reference(table.column(5).to_pylist(), n + window - 1)
        at, runs = as_runs(ref.repeated(window))
        who = np.searchsorted(ref.start, at, side="right") - 1
        s = table.column(3).to_numpy().astype(np.int64)[who] + at - ref.start[who]
        take = lambda i: table.column(i).combine_chunks().take(pa.array(who))
        return pa.RecordBatch.from_arrays([take(1), take(2), pa.array(s.astype(np.int32)), pa.array(runs.astype(np.int32))], names=["doc", "th", "s", "n"])

    def run(batches):
        held, words, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            anchor, sizes = b.column(0).to_numpy(), b.column(4).to_numpy().astype(np.int64) + window
            new = np.concatenate([[last is not None and anchor[0] != last], anchor[1:] != anchor[:-1]])
            cuts = np.flatnonzero(new)
            if words + int(sizes.sum()) > PARSE_WORDS and len(cuts) and (held or cuts[-1]):
                yield parse([*held, b.slice(0, int(cuts[-1]))])
                b, sizes, held, words = b.slice(int(cuts[-1])), sizes[int(cuts[-1]) :], [], 0
            held.append(b)
            words, last = words + int(sizes.sum()), anchor[-1]
        if held:
            yield parse(held)

    return run


def _located(texts: DataFrame, firsts: DataFrame, anchors_of: DataFrame) -> DataFrame:
    """Texts (doc, th, text) with the distinct phrases, list of (s, n, anchor), that lie in the blocks named in ``anchors_of`` (ma)."""
    ask = firsts.join(anchors_of.select("ma"), F.col("anchor") == F.col("ma"), "left_semi").select("f.doc", "f.th", "f.s", "f.n", "anchor")
    asked = ask.groupBy(F.col("doc").alias("ad"), F.col("th").alias("ah")).agg(F.collect_list(F.struct("s", "n", "anchor")).alias("runs"))
    return texts.join(asked, F.col("doc").eqNullSafe(F.col("ad")) & (F.col("th") == F.col("ah"))).select("doc", "th", "text", "runs")


def repeat_factors(texts: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Runs (doc, th, s, n) of window starts whose window also starts earlier, from rows (doc, th, text)."""
    counts = arrow_map(texts, _anchor_counts(window), "anchor long, c int")
    shared = stage(counts.groupBy("anchor").agg(F.sum("c").alias("c")).where("c > 1").select(F.col("anchor").alias("a")), "anchors")
    phrases = arrow_map(texts, _phrase_rows(window), _PHRASE_SQL)
    # Settled rows need no block; one pass over the texts makes both kinds.
    both = stage(phrases.join(shared, (F.col("anchor") == F.col("a")) & ~F.col("settled"), "left").where("settled OR a IS NOT NULL").drop("a"), "phrases")
    spot = F.struct("doc", "th", "s")
    travelling = both.where("NOT settled")
    firsts = stage(travelling.groupBy("anchor", "phrase").agg(F.min(F.struct("doc", "th", "s", "n")).alias("f"), F.count(F.lit(1)).alias("c")), "phrase-firsts")
    # Whole phrases that occur earlier.
    many = firsts.where("c > 1").select(F.col("anchor").alias("fa"), F.col("phrase").alias("fp"), F.struct("f.doc", "f.th", "f.s").alias("first"))
    whole = travelling.join(many, (F.col("anchor") == F.col("fa")) & (F.col("phrase") == F.col("fp"))).where(~spot.eqNullSafe(F.col("first"))).select("doc", "th", "s", "n")
    found = [both.where("settled").select("doc", "th", "s", "n"), whole]
    # Blocks with different phrases.  Written by itself, so that the joins can split an anchor with many phrases over tasks.
    size = F.sum(F.col("f.n") + window - 1)
    mixed = stage(firsts.groupBy(F.col("anchor").alias("ma")).agg(F.count(F.lit(1)).alias("k"), size.alias("words")).where("k > 1").select("ma", "words"), "mixed-blocks")
    spoken = arrow_map(_located(texts, firsts, mixed.where(F.col("words") <= block_words)), _phrase_texts(window), "anchor long, doc long, th long, s int, n int, words binary")
    blocks = spoken.repartition(input_tasks(texts.sparkSession), "anchor").sortWithinPartitions("anchor", "doc", "th", "s")
    found.append(arrow_map(blocks, _parse_blocks(window), "doc long, th long, s int, n int"))
    temporary = [shared, both, firsts, mixed]
    large = mixed.where(F.col("words") > block_words)
    if not large.isEmpty():
        windows = stage(arrow_map(_located(texts, firsts, large), _window_rows(window), "settled boolean, anchor long, w long, doc long, th long, s int"), "windows")
        loose = windows.where("NOT settled")
        first_windows = loose.groupBy(F.col("anchor").alias("wa"), F.col("w").alias("ww")).agg(F.min(spot).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
        first_windows = stage(first_windows.drop("c"), "window-firsts")
        later = loose.join(first_windows, (F.col("anchor") == F.col("wa")) & (F.col("w") == F.col("ww"))).where(~spot.eqNullSafe(F.col("first")))
        found += [x.select("doc", "th", "s", F.lit(1).alias("n")) for x in (windows.where("settled"), later)]
        temporary += [windows, first_windows]
    out = stage(reduce(DataFrame.unionByName, found), "factors")
    unstage(*temporary)
    return out


def removal_mask(n_words: int, runs: list[dict], window: int = WINDOW) -> np.ndarray:
    """Which words the windows that start in ``runs`` cover."""
    edge = np.zeros(n_words + 1, np.int64)
    for r in runs:
        edge[r["s"]] += 1
        edge[r["s"] + r["n"] + window - 1] -= 1
    return np.cumsum(edge[:-1]) > 0


def _finish(where: int, runs_at: int, names: tuple[str, ...]):
    def run(batches):
        for b in batches:
            sizes, removed, kept = [], [], []
            for text, runs in zip(utf8_values(b.column(where)), b.column(runs_at).to_pylist(), strict=True):
                words = text.split() if text else []
                if runs:
                    mask = removal_mask(len(words), runs)
                    left = [w for w, m in zip(words, mask.tolist(), strict=True) if not m]
                else:
                    left = words
                sizes.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            columns = [c for i, c in enumerate(b.columns) if i != runs_at]
            fields = [n for i, n in enumerate(b.schema.names) if i != runs_at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[*fields, *names])

    return run


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> tuple[DataFrame, tuple[str, str, str]]:
    """``docs`` with the number of words, of removed words, and the kept words joined by blanks; and these columns' names."""
    ident, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`")
    texts = docs.select(ident.alias("doc"), F.xxhash64(text).alias("th"), text.alias("text"))
    factors = repeat_factors(texts, window, block_words)
    taken = list(docs.columns)
    runs, fd, fh = (fresh_name(x, taken) for x in ("runs", "factor_doc", "factor_hash"))
    names = tuple(fresh_name(x, taken) for x in ("n_words", "n_removed", "kept_text"))
    per_doc = factors.groupBy(F.col("doc").alias(fd), F.col("th").alias(fh)).agg(F.collect_list(F.struct("s", "n")).alias(runs))
    joined = docs.join(per_doc, ident.eqNullSafe(F.col(fd)) & (F.xxhash64(text) == F.col(fh)), "left").drop(fd, fh)
    longs = [T.StructField(n, T.LongType()) for n in names[:2]]
    schema = T.StructType([*docs.schema.fields, *longs, T.StructField(names[2], T.StringType())])
    return arrow_map(joined, _finish(docs.columns.index(text_col), len(docs.columns), names), schema), names

