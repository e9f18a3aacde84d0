"""Best-fit packing of tokenised documents into sequences, after a dominance reduction.

Pieces of equal length are interchangeable, so packing needs only how many pieces there are of each length: a
histogram of at most ``capacity`` rows, however many documents there are.  The driver solves this instance and every executor
places its own pieces:

1. Tokenise once; write each piece's length and checksum to the shared folder.
2. Rank the pieces of each length without gathering a length in one task: count per (length, partition), prefix sums
   over these counts, local ranks.
3. ``reduce_dominated`` fixes bins by the Martello-Toth dominance criterion: for each length, longest first, a bin of
   one, two or three pieces is fixed for good when it provably dominates every other bin that could hold such a
   piece.  Bins are fixed for as many equal pieces as there are at once.
4. ``best_fit`` packs the remainder, longest first, each into the open sequence it leaves least room in.
5. The solution is a list of runs: ranks [lo, hi) of a length go to consecutive sequences at one offset.  Each run is the work of
   one step that used up a length or a kind of open sequence, so their number depends on ``capacity``, not on
   the corpus; every piece finds its run by binary search.

Defined results for odd input: a null text is empty; an empty document is the end mark alone (one token); equal rows are separate
documents; null ids are kept; long texts are tokenised whole; other columns are ignored, whatever their names; an empty table gives no pieces.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .common import arrow_map, utf8_values

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers before it starts anew.
CACHE_WORDS = 600_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: A full stop or comma between an ASCII letter and a blank is a token of its own, so it may be cut off.
_STOP = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D])")


#: A lower-case ASCII word with ASCII marks behind it; an apostrophe may begin a piece of its own, so it is none of them.
_MARKED = re.compile(rb"([a-z]+)([!-&(-/:-@\[-`{-~]+)")
_MARKS = re.compile(rb"[!-&(-/:-@\[-`{-~]+")
#: Letters up to here have one lower-case form and no other composition in any version of Unicode.
_LAST_LATIN = "\u012f"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: visible bytes for themselves, the others numbered from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class WordIds(dict):
    """Token ids (little-endian 32-bit) of blank-separated words, remembered.

    The tokenizer cuts at white space before anything else and treats what stands between alone, so the ids of a text are those of
    its words in a row.  Lower-casing A-Z first changes nothing, as the tokenizer lower-cases too.  Words that it leaves in one
    piece (only letters, or only marks) go to its merge table directly; all others take the whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        raw = np.arange(self.tokenizer.get_vocab_size() + 1, dtype="<u4").tobytes()
        self.coded = [raw[i : i + 4] for i in range(0, len(raw), 4)]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self._ids(word)
        return found

    def _ids(self, word: bytes) -> bytes:
        if word.isascii():
            if (word.isalpha() and word.islower()) or _MARKS.fullmatch(word):
                return self._merged(word.decode())
            if m := _MARKED.fullmatch(word):
                return self[m[1]] + self[m[2]]
        elif (text := word.decode()).isalpha() and max(text) <= _LAST_LATIN:
            return self._merged("".join([self.letters[b] for b in text.lower().encode()]))
        coded = self.coded
        return b"".join([coded[i] for i in self.tokenizer.encode(word.decode(), add_special_tokens=False).ids])

    def _merged(self, piece: str) -> bytes:
        coded = self.coded
        return b"".join([coded[t.id] for t in self.model.tokenize(piece)])

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian 32-bit ids of ``text``."""
        if not text:
            return b""
        return b"".join(map(self.__getitem__, _STOP.sub(rb" \1", text if b"<|" in text else text.translate(_LOWER)).split()))


def word_ids(path: str) -> WordIds:
    """The worker's own ``WordIds`` for ``path``; it outlives a task."""
    store = sys.modules.setdefault("_keelson_worker_store", types.ModuleType("_keelson_worker_store"))
    found = store.__dict__.setdefault("word_ids", {})
    if path not in found:
        found[path] = WordIds(path)
    return found[path]


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of the installed tokenizers on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("local", pa.int64())])


def tokenised_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with a place (part, local): the writing task, and how many of its pieces of the same length come before."""

    def run(batches):
        from pyspark import TaskContext

        coder, part, seen = word_ids(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([END_ID], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), utf8_values(b.column(1)), strict=True):
                ids = coder.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, piece, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long")


#: A bin is a tuple of lengths, and how many such bins there are.
Bins = list[tuple[tuple[int, ...], int]]


class Lengths:
    """Multiset of lengths by count, with look-ups by size."""

    def __init__(self, counts: dict[int, int]) -> None:
        self.counts = {w: n for w, n in counts.items() if n > 0}
        self.sizes = sorted(self.counts)

    def take(self, w: int, n: int) -> None:
        self.counts[w] -= n
        if not self.counts[w]:
            del self.counts[w]
            del self.sizes[bisect_left(self.sizes, w)]

    def give(self, w: int, n: int) -> None:
        if w not in self.counts:
            self.sizes.insert(bisect_left(self.sizes, w), w)
        self.counts[w] = self.counts.get(w, 0) + n

    def largest_upto(self, limit: int) -> int | None:
        i = bisect_right(self.sizes, limit)
        return self.sizes[i - 1] if i else None

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for w in self.sizes:
            out += [w] * min(self.counts[w], n - len(out))
            if len(out) == n:
                break
        return out

    def best_pair(self, limit: int) -> tuple[int, int] | None:
        """Two pieces of the greatest sum up to ``limit``, the larger one as large as that sum allows."""
        best, low, high = None, 0, bisect_right(self.sizes, limit) - 1
        while low <= high:
            a, b = self.sizes[high], self.sizes[low]
            if a + b > limit or (low == high and self.counts[a] < 2):
                high -= 1
                continue
            if best is None or a + b > sum(best):
                best = (a, b)
            low += 1
        return best

    def partner(self, k: int, limit: int) -> int | None:
        """The longest piece that fits beside ``k``."""
        b = self.largest_upto(limit - k)
        return b if b != k or self.counts[k] > 1 else self.largest_upto(k - 1)

    def longest_second(self, limit: int) -> int:
        """The longest piece that can be the shorter one of two that fit together."""
        i = bisect_right(self.sizes, limit // 2) - 1
        if i < 0:
            return 0
        w = self.sizes[i]
        if self.counts[w] > 1 or (i + 1 < len(self.sizes) and w + self.sizes[i + 1] <= limit):
            return w
        return self.sizes[i - 1] if i else 0


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[Bins, dict[int, int]]:
    """Fix bins that dominate all others for some length, longest first; returns them and the lengths left over.

    With room r beside a piece j and all other remaining pieces to choose from, a set S of others dominates all alternatives if each can be cut into parts that fit
    into the pieces of S one by one.  So {j} alone wins if nothing fits; {j, k}, k the longest that fits, wins if k fills
    r, if no two pieces fit together, or if k is as long as any two (no three fitting) that do; {j, k, b}, b the longest
    beside k, wins if no three fit and no two that fit together are both longer than b.  When none of these holds, pieces as long as j stay,
    and the next shorter length is tried.
    """
    left, fixed = Lengths(counts), []
    j = left.largest_upto(capacity)
    while j is not None:
        room = capacity - j
        left.take(j, 1)  # the piece itself is not its own partner
        k, few, chosen = left.largest_upto(room), left.smallest(3), None
        if k is None:
            chosen = ()
        elif k == room or len(few) < 2 or sum(few[:2]) > room:
            chosen = (k,)
        elif len(few) < 3 or sum(few) > room:
            pair = left.best_pair(room)
            if k >= sum(pair):
                chosen = (k,)
            elif (b := left.partner(k, room)) is not None and left.longest_second(room) <= b:
                chosen = (k, b)
        left.give(j, 1)
        if chosen is None:
            j = left.largest_upto(j - 1)
            continue
        whole = (j, *chosen)
        times = min(left.counts[w] // whole.count(w) for w in set(whole))
        for w in set(whole):
            left.take(w, times * whole.count(w))
        fixed.append((whole, times))
        j = left.largest_upto(j)
    return fixed, left.counts


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best-fit decreasing on a histogram: equal pieces go to equally filled bins together."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, content: tuple[int, ...], n: int) -> None:
        if room not in open_bins or not open_bins[room]:
            if (i := bisect_left(rooms, room)) == len(rooms) or rooms[i] != room:
                rooms.insert(i, room)
        open_bins[room].append((content, n))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            i = bisect_left(rooms, w)
            if i == len(rooms):
                each = capacity // w
                if full := n // each:
                    put(capacity - each * w, (w,) * each, full)
                if rest := n % each:
                    put(capacity - rest * w, (w,) * rest, 1)
                break
            room = rooms[i]
            content, m = open_bins[room].pop()
            if not open_bins[room]:
                rooms.pop(i)
                del open_bins[room]
            use = min(n, m)
            if m > use:
                put(room, content, m - use)
            put(room - w, (*content, w), use)
            n -= use
    return [b for bins in open_bins.values() for b in bins]


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> Bins:
    """Bins for all pieces of a histogram."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


class Runs:
    """The solution by length: ranks from ``first[i]`` on go to sequences from ``sequence[i]`` on, at ``offset[i]``."""

    def __init__(self, bins: Iterable[tuple[tuple[int, ...], int]]) -> None:
        used: dict[int, int] = defaultdict(int)
        by: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        sequence = 0
        for content, n in bins:
            at = 0
            for w in content:
                by[w].append((used[w], sequence, at))
                used[w] += n
                at += w
            sequence += n
        self.by_length = {w: tuple(np.array(c, dtype=np.int64) for c in zip(*r, strict=True)) for w, r in by.items()}
        self.sequences = sequence

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        sequence, offset = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for w in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == w)
            first, seq, off = self.by_length[w]
            run = np.searchsorted(first, ranks[at], side="right") - 1
            sequence[at], offset[at] = seq[run] + ranks[at] - first[run], off[run]
        return sequence, offset


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with the sequence and the offset each has been given."""
    pieces = stage(tokenised_pieces(docs, tokenizer, capacity), "pieces")
    per_part = stage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = Runs(solve(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select(F.col("length").alias("bl"), F.col("part").alias("bp"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Both sides grow with the input, so neither is broadcast, whatever its size looks like.
    ranked = pieces.join(bases.hint("merge"), (F.col("length") == F.col("bl")) & (F.col("part") == F.col("bp"))).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))

    def run(batches):
        for b in batches:
            sequence, offset = runs.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return arrow_map(ranked, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
