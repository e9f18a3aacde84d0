"""N-gram Jaccard join by chosen paths.

Texts become sets of hashed word 5-grams; texts with equal sets are one class from then on, so copies are never compared.
The join follows the chosen-path scheme: every set takes, by a hash that is the same for all sets, the ``BRANCH`` least
of its tokens and goes into the bucket of each; a bucket that is too large is split again, each of its sets taking tokens by a hash
that depends on the path so far.  Similar sets keep choosing tokens they share.  Runs with other hashes are repeated until
``recall_of``, which counts what the sketch loses, reaches ``RECALL`` at the threshold.

Tokens are drawn from a bottom sketch of ``SKETCH`` hashes per set, itself a sample of the set that is consistent over
all sets.  Buckets of at most ``BUCKET`` sets, and those that don't split any more, are compared by brute force on the
sketches, in tiles of ``TILE`` sets, so that a bucket with a third of all rows is many tasks.  A bucket returns links of a spanning
forest, not pairs: that is enough to bring all members of a group together.

Groups are then compared exactly, in tiles again, by a product of the incidence matrices of the tokens that two tiles
share.  This gives each set's number of links and the links of the final classes.  A pair is in one group only, so nothing is counted
twice; copies are counted by multiplicity.  A group that fits one tile travels as texts.  A larger one is cut by size first: sets whose sizes
differ by more than the threshold allows are no link, so tiles of a size class meet only those of the same class and of its two neighbours.  Tiles
hold at most ``TILE`` sets and on average at most ``TILE_SHINGLES`` shingles, so long texts are few to a tile; their sets are hashed once, before they are dealt out.

Components are found in rounds of star operations, all in DataFrames.

Defined results for odd input: texts without words have no similarity, each is a class of its own without links; texts of fewer
than five words have one shingle, all their words; the class id is the least doc_id of the class (null ids count
as largest, a class of null ids has a null id); rows with equal ids and equal texts are copies of each other; texts of any length count whole; an
empty table gives an empty result.  ``near_duplicates`` returns its own columns only, whatever the input's are called; ``one_of_each`` keeps
the input's columns and adds none.
"""

from __future__ import annotations

from functools import reduce
from itertools import pairwise
from math import comb, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import input_tasks, stage, unstage
from .common import arrow_map, fresh_name, one_batch, quoted, utf8_values
from .substring import Hasher, mix

SHINGLE = 5
THRESHOLD = 0.8
SKETCH = 64
BRANCH = 3
RECALL = 0.999
BUCKET = 64
#: Levels after which a bucket is compared even if it still splits.
MAX_DEPTH = 4
#: A bucket with a child of more than this share of its sets doesn't split: it is compared itself.
STUCK = 0.7
#: Sketches this far below the threshold are no candidates: five standard deviations of 64 draws at 0.8.
SKETCH_MARGIN = 0.25
TILE = 512
#: Shingles that the sets of one tile have together, on average; a longer set is a tile of its own.
TILE_SHINGLES = 1 << 20
#: Sets of a link are in the same size class or in neighbouring ones: classes are a little wider than the threshold asks for, whatever rounding does.
CLASS_WIDTH = log(1 / THRESHOLD) * (1 + 1e-6)


def _path_share(similarity: float, branch: int, depth: int) -> float:
    """Chance that two sets of this similarity share a path of ``depth`` tokens.

    In one bucket the least ``branch`` tokens of both are disjoint only if so many unshared tokens come first.
    """
    own = (1 - similarity) / 2
    # Chance that a shared token is among the least `branch` of both: fewer than `branch` tokens of either side come before it.
    miss = 0.0
    for a in range(3 * branch):
        for b in range(3 * branch):
            if a >= branch or b >= branch:
                miss += comb(a + b, a) * own ** (a + b) * similarity
    return max(0.0, 1 - miss) ** depth


def recall_of(similarity: float, branch: int = BRANCH, depth: int = MAX_DEPTH, runs: int = 1, sketch: int = SKETCH) -> float:
    """Chance that two sets of this similarity meet in one of the runs, if they have to share a path of ``depth`` tokens.

    All runs draw from the same sketches, so the mean is taken over what these hold: a binomial number of ``sketch`` tokens is shared.
    """
    weight = lambda x: comb(sketch, x) * similarity**x * (1 - similarity) ** (sketch - x)
    return sum(weight(x) * (1 - (1 - _path_share(x / sketch, branch, depth)) ** runs) for x in range(1, sketch + 1))


def runs_for(similarity: float = THRESHOLD, recall: float = RECALL, most: int = 16) -> int:
    """Runs that reach this recall."""
    for runs in range(1, most + 1):
        if recall_of(similarity, runs=runs) >= recall:
            return runs
    raise ValueError(f"{most} runs don't reach a recall of {recall}")


def shingle_hashes(hasher: Hasher, text: bytes | None) -> np.ndarray:
    """Distinct sorted hashes of the word 5-grams of ``text`` (of all its words, if fewer)."""
    words = text.split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(hasher.windows(hasher.prefix(words), min(SHINGLE, len(words))))


_SETS = pa.schema([("doc", pa.int64()), ("th", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("size", pa.int32()), ("sketch", pa.list_(pa.int64()))])
_SETS_SQL = "doc long, th long, low long, high long, size int, sketch array<long>"


def _set_rows(batches):
    """One row per document: a 128-bit name of its set (null: no words), the set's size and its bottom sketch."""
    hasher = Hasher()
    for b in batches:
        low, high, sizes, sketches = [], [], [], []
        for text in utf8_values(b.column(2)):
            s = shingle_hashes(hasher, text)
            sizes.append(len(s))
            low.append(int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
            high.append(int(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None)
            sketches.append(s[:SKETCH].view(np.int64))
        yield one_batch(_SETS, doc=b.column(0), th=b.column(1), low=low, high=high, size=sizes, sketch=sketches)


def _children(run_salt: int):
    """(id, path, level) -> the paths of the next level, from the sketch in column 2."""

    def run(batches):
        for b in batches:
            ids, paths = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            values, offsets = b.column(2).flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(b.column(2).value_lengths().to_numpy())])
            size = np.diff(offsets)
            owner = np.repeat(np.arange(len(ids)), size)
            order = mix(values ^ mix(paths[owner] + np.uint64(run_salt)))
            by = np.lexsort((order, owner))
            rank = np.arange(len(by)) - offsets[owner[by]]
            pick = by[rank < BRANCH]
            child = mix(mix(paths[owner[pick]] + np.uint64(run_salt)) + values[pick])
            yield pa.RecordBatch.from_arrays([pa.array(ids[owner[pick]]), b.column(1).take(pa.array(owner[pick])), pa.array(child.view(np.int64))], names=["id", "parent", "path"])

    return run


def _paths(sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Leaf buckets (path, id, n: how many sets the bucket has), and the staged tables they are read from."""
    level = sets.select("id", F.explode(F.array(*(F.lit(r + 1).cast("long") for r in range(runs_for())))).alias("path"), "sketch")
    leaves, open_rows, parents, staged = [], None, None, []
    for depth in range(MAX_DEPTH):
        rows = stage(arrow_map(level, _children(depth), "id long, parent long, path long"), "paths")
        sizes = counted = stage(rows.groupBy("parent", "path").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
        if parents is not None:
            stuck = sizes.groupBy("parent").agg(F.max("n").alias("top")).join(parents, "parent").where(F.col("top") > STUCK * F.col("parent_n"))
            stuck = stuck.select(F.col("parent").alias("path"), F.col("parent_n").alias("n"))
            leaves.append(open_rows.join(stuck, "path").select("path", "id", "n"))
            sizes = sizes.join(stuck.select(F.col("path").alias("parent")), "parent", "left_anti")
        last = F.lit(depth == MAX_DEPTH - 1)
        leaves.append(rows.join(sizes.where((F.col("n") <= BUCKET) | last).select("path", "n"), "path").select("path", "id", "n"))
        large = stage(sizes.where((F.col("n") > BUCKET) & ~last).select("path", "n"), "large-buckets")
        staged += [rows, counted, large]
        if depth == MAX_DEPTH - 1 or large.isEmpty():
            break
        parents = large.select(F.col("path").alias("parent"), F.col("n").alias("parent_n"))
        open_rows = rows.join(large.select("path"), "path", "left_semi").select("id", "path")
        level = open_rows.join(sets.select("id", "sketch"), "id").select("id", "path", "sketch")
    return reduce(DataFrame.unionByName, leaves), staged


def _tiles(members: DataFrame, group: str, count: str, tile: int = TILE) -> DataFrame:
    """Deal the members of each group into pairs of tiles: (group, a, b, side, ...) for each pair its tile is part of.

    Groups of one tile are one pair (0, 0); one of k tiles makes k rows of each member, a share of the work of comparing it with the others.
    """
    k = F.ceil(F.col(count) / tile).cast("int")
    mine = F.when(k == 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(7)), k).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), k - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b")))
    return members.withColumn("tile", mine).withColumn("p", F.explode(pairs)).select("*", "p.a", "p.b").drop("p", count)


def _size_plan(members: DataFrame) -> DataFrame:
    """(comp, plan): the tiles of each group by size class, an array of (cls, k: tiles of the class, first: number of its first tile); the
    classes of all sizes that an int holds are fewer than a hundred."""
    tiles = F.greatest(F.ceil(F.col("n") / TILE), F.least(F.ceil(F.col("shingles") / TILE_SHINGLES), F.col("n"))).cast("int")
    counted = members.groupBy("comp", "cls").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"))
    classes = counted.groupBy("comp").agg(F.sort_array(F.collect_list(F.struct("cls", tiles.alias("k")))).alias("c"))
    before = lambda i: F.aggregate(F.slice("c", F.lit(1), i), F.lit(0), lambda acc, x: acc + x["k"])
    return classes.select("comp", F.transform("c", lambda x, i: F.struct(x["cls"].alias("cls"), x["k"].alias("k"), before(i).alias("first"))).alias("plan"))


def _size_tiles(members: DataFrame, plans: DataFrame) -> DataFrame:
    """``members`` with ``tile`` and ``near``: the tiles (first, k) of its own size class and of the two beside it; null where the group is one tile."""
    near = F.filter("plan", lambda x: F.abs(x["cls"] - F.col("cls")) <= 1)
    own = F.element_at(F.filter("plan", lambda x: x["cls"] == F.col("cls")), 1)
    joined = members.join(plans, "comp", "left").withColumn("own", own)
    tile = F.coalesce(F.col("own.first") + F.pmod(F.xxhash64("id", F.lit(7)), F.col("own.k")).cast("int"), F.lit(0))
    return joined.withColumn("tile", tile).withColumn("near", F.transform(near, lambda x: F.struct(x["first"].alias("first"), x["k"].alias("k")))).drop("plan", "own", "cls")


def _pairs_of_tiles(members: DataFrame) -> DataFrame:
    """A row of each member for every pair (a, b) of tiles that its tile is part of."""
    others = F.flatten(F.transform("near", lambda x: F.sequence(x["first"], x["first"] + x["k"] - 1)))
    pairs = F.transform(F.coalesce(others, F.array(F.lit(0))), lambda o: F.struct(F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b")))
    return members.withColumn("p", F.explode(pairs)).select("*", "p.a", "p.b").drop("p", "near")


def _dealt(pairs: DataFrame, group: str) -> DataFrame:
    """Rows of ``_tiles`` sorted by pair, each pair whole in one task; the pairs of one group go to tasks one after the other, so none gets two before all have one."""
    tasks = input_tasks(pairs.sparkSession)
    number = F.col("b").cast("long") * (F.col("b") + 1) / 2 + F.col("a")
    place = F.pmod(F.pmod(F.xxhash64(group, F.lit(11)), F.lit(tasks)) + number.cast("long"), F.lit(tasks)).cast("int")
    return pairs.repartitionById(tasks, place).sortWithinPartitions(group, "a", "b")


def _by_group(batches, keys: int):
    """Regroup sorted record batches into tables that hold whole groups (equal leading ``keys`` columns)."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(b.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        new[0] = last is not None and first != last
        cuts = np.flatnonzero(new).tolist()
        if cuts:
            if held or cuts[0]:
                yield pa.Table.from_batches([*held, b.slice(0, cuts[0])])
            for x, y in pairwise(cuts):
                yield pa.Table.from_batches([b.slice(x, y - x)])
            held = [b.slice(cuts[-1])]
        else:
            held.append(b)
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    return whole.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(whole.value_lengths().to_numpy())])


#: Values that are counted at once; more are counted in parts by their last bits.
PART_VALUES = 1 << 21


def shared_counts(values: np.ndarray, offsets: np.ndarray, left: int | None = None) -> np.ndarray:
    """How many values each pair of sets has in common, as a dense matrix; with ``left``, of each of the first ``left`` sets and each of the others."""
    sets = len(offsets) - 1
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    if (parts := len(values) // PART_VALUES + 1) == 1:
        return _shared_counts(values, owner, sets, left)
    turn = values % np.uint64(parts)
    return sum(_shared_counts(values[turn == i], owner[turn == i], sets, left) for i in range(parts))


def _shared_counts(values: np.ndarray, owner: np.ndarray, sets: int, left: int | None) -> np.ndarray:
    uniq, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    out = np.zeros((sets, sets) if left is None else (left, sets - left))
    if left is None:
        keep = np.flatnonzero(counts > 1)
    else:  # values on both sides
        ours = np.bincount(column[owner < left], minlength=len(uniq))
        keep = np.flatnonzero((ours > 0) & (ours < counts))
    number = np.full(len(uniq), -1)
    number[keep] = np.arange(len(keep))
    column = number[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for start in range(0, len(keep), 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        m = np.zeros((sets, min(4096, len(keep) - start)), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        out += m @ m.T if left is None else m[:left] @ m[left:].T
    return out


def forest(close: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of a symmetric matrix of booleans."""
    n = len(close)
    seen = np.zeros(n, bool)
    src, dst = [], []
    for root in range(n):
        if seen[root]:
            continue
        seen[root] = True
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(close[at] & ~seen)
            seen[new] = True
            src += [at] * len(new)
            dst += new.tolist()
            front += new.tolist()
    return np.array(src, np.int64), np.array(dst, np.int64)


def _sketch_links(batches):
    """Columns a tile pair's path, a, b, tile, id, sketch: links between sets that the sketches call similar enough."""
    least = THRESHOLD - SKETCH_MARGIN
    for group in _by_group(batches, 3):
        ids = group.column(4).to_numpy()
        ids, at = np.unique(ids, return_index=True)
        if len(ids) < 2:
            continue
        group = group.take(pa.array(at))
        values, offsets = _lists(group.column(5))
        sizes = np.diff(offsets).astype(np.float32)
        both = shared_counts(values, offsets)
        # Of two bottom sketches of at most SKETCH hashes, the least SKETCH of the union hold the sample.
        union = np.minimum(sizes[:, None] + sizes[None, :] - both, SKETCH)
        close = both >= np.maximum(least * union, 1)
        np.fill_diagonal(close, False)
        src, dst = forest(close)
        yield pa.RecordBatch.from_arrays([pa.array(ids[src]), pa.array(ids[dst])], names=["x", "y"])


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for all ids in ``links`` (x, y): the least id that each is connected with.

    Rounds of large-star and small-star operations: the first ties each larger neighbour of a node to the node's least
    neighbour, the second ties a node and its smaller neighbours to the least of them.  Trees get flatter every round, until each node
    has one link, to the least node of its component.  Every round is written to the shared folder.
    """
    both = links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct()
    edges = stage(both, "edges")
    while True:
        # Large star: every larger neighbour of a node is tied to the node's least neighbour (itself included).
        # Both least neighbours are written by themselves, so that the joins can split a node with many links over tasks.
        least = stage(edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m")), "least")
        big = edges.where("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        big = stage(big.distinct(), "large-star")
        # Small star: a node's smaller neighbours and itself are tied to its least neighbour.
        low = stage(big.groupBy("x").agg(F.min("y").alias("m")), "low")
        small = big.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(low.select("x", F.col("m").alias("y"))).distinct()
        new = stage(small, "small-star")
        # Done when every node has one link, to a root.
        many = new.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = new.select("x").join(new.select(F.col("y").alias("x")), "x", "left_semi")
        done = many.isEmpty() and chained.isEmpty()
        unstage(edges, big, least, low)
        if done:
            roots = new.select(F.col("y").alias("id"), F.col("y").alias("comp")).distinct()
            return new.select(F.col("x").alias("id"), F.col("y").alias("comp")).unionByName(roots)
        edges = stage(new.unionByName(new.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
        unstage(new)


_HASHED_SQL = "comp long, id long, copies long, tile int, near array<struct<first:int,k:int>>, text string, shingles array<long>"


def _hash_large(batches):
    """Columns comp, id, copies, tile, near, text: the text of a group of several tiles becomes its sorted shingles, others have none yet."""
    hasher, none = Hasher(), np.zeros(0, np.int64)
    for b in batches:
        large = b.column(4).is_valid()
        shingles = [shingle_hashes(hasher, t).view(np.int64) if x else none for t, x in zip(utf8_values(b.column(5)), large.to_pylist(), strict=True)]
        text = pc.if_else(large, pa.scalar(None, b.column(5).type), b.column(5))
        yield pa.RecordBatch.from_arrays([*b.columns[:5], text, pa.array(shingles, pa.list_(pa.int64()))], names=["comp", "id", "copies", "tile", "near", "text", "shingles"])


def _exact(batches):
    """Columns comp, a, b, tile, id, copies, text, shingles: link counts and forest links of one pair of tiles."""
    hasher = Hasher()
    for group in _by_group(batches, 3):
        a, b = group.column(1)[0].as_py(), group.column(2)[0].as_py()
        _, at = np.unique(group.column(4).to_numpy(), return_index=True)
        at = at[np.argsort(group.column(3).to_numpy()[at], kind="stable")]  # the tile with the lower number first
        group = group.take(pa.array(at))
        ids, copies = group.column(4).to_numpy(), group.column(5).to_numpy()
        ready, ends = _lists(group.column(7))
        texts = utf8_values(group.column(6).combine_chunks())
        sets = [ready[ends[i] : ends[i + 1]] if t is None else shingle_hashes(hasher, t) for i, t in enumerate(texts)]
        sizes = np.array([len(s) for s in sets], np.float64)
        offsets = np.concatenate([[0], np.cumsum(sizes).astype(np.int64)])
        similar = lambda both, x, y: both >= THRESHOLD * (x[:, None] + y[None, :] - both) - 1e-9
        if a == b:
            close = similar(shared_counts(np.concatenate(sets), offsets), sizes, sizes)
            np.fill_diagonal(close, False)
        else:  # links inside a tile are counted where it meets itself
            left = int((group.column(3).to_numpy() == a).sum())
            if not 0 < left < len(ids):
                continue
            close = np.zeros((len(ids), len(ids)), bool)
            close[:left, left:] = similar(shared_counts(np.concatenate(sets), offsets, left), sizes[:left], sizes[left:])
            close |= close.T
        linked = close @ copies.astype(np.float64)
        src, dst = forest(close)
        kind = np.concatenate([np.zeros(len(ids), np.int64), np.ones(len(src), np.int64)])
        x = np.concatenate([ids, ids[src]])
        y = np.concatenate([linked.astype(np.int64), ids[dst]])
        keep = (kind == 1) | (y > 0)
        yield pa.RecordBatch.from_arrays([pa.array(kind[keep]), pa.array(x[keep]), pa.array(y[keep])], names=["kind", "x", "y"])


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their classes, each once; all columns stay."""
    found = near_duplicates(docs, id_col, text_col)
    leads = found.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")))
    lead_id, lead_hash = (fresh_name(x, docs.columns) for x in ("lead_id", "lead_hash"))
    leads = leads.select(F.col("doc_id").alias(lead_id), F.col("text_hash").alias(lead_hash)).distinct()
    ident, hashed = F.col(f"`{id_col}`").cast("long"), F.xxhash64(f"`{text_col}`")
    rows = docs.join(leads, ident.eqNullSafe(F.col(lead_id)) & (hashed == F.col(lead_hash)))
    return rows.dropDuplicates([lead_id, lead_hash]).select(*(F.col(quoted(c)) for c in docs.columns))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash (xxhash64), class_id and class_hash (those of the least row of its
    class), n_links (other documents at ``THRESHOLD`` or above)."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(f"`{text_col}`").alias("th"), F.col(f"`{text_col}`").alias("text"))
    rows = stage(arrow_map(texts, _set_rows, _SETS_SQL), "sets")
    # One set per class of equal sets; its id is a hash of its 128-bit name.
    named = F.xxhash64("low", "high")
    sets = rows.where("low IS NOT NULL").groupBy(named.alias("id"), "low", "high").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc").isNull().alias("no_id"), "doc", "th")).alias("one"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sets = stage(sets, "distinct-sets")
    buckets, staged = _paths(sets)
    leaves = _tiles(buckets, "path", "n").join(sets.select("id", "sketch"), "id").select("path", "a", "b", "tile", "id", "sketch")
    links = stage(arrow_map(_dealt(leaves, "path"), _sketch_links, "x long, y long").distinct(), "links")
    unstage(*staged)
    groups = stage(components(links), "groups")
    # Sizes and leads are written by themselves, so that joins can split a large group over tasks.
    sizes = stage(groups.join(sets.select("id", "size"), "id").groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles")), "group-sizes")
    sized = groups.join(sizes.withColumn("large", (F.col("n") > TILE) | (F.col("shingles") > TILE_SHINGLES)), "comp").drop("n", "shingles")
    # One text stands for each set: that of its least (id, text hash).  Where rows repeat it, one of them is taken before texts are dealt out.
    repeats = rows.groupBy(F.col("doc").alias("rd"), F.col("th").alias("rh")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    wanted = sized.join(sets.select("id", "copies", "size", F.floor(F.log("size") / CLASS_WIDTH).cast("int").alias("cls"), F.col("one.doc").alias("wd"), F.col("one.th").alias("wh")), "id")
    wanted = stage(wanted.join(repeats, F.col("wd").eqNullSafe(F.col("rd")) & (F.col("wh") == F.col("rh")), "left").drop("rd", "rh"), "wanted-texts")
    plans = stage(_size_plan(wanted.where("large")), "tile-plans")
    placed = _size_tiles(wanted, plans).select("comp", "id", "copies", "tile", "near", "wd", "wh", "rows")
    # The list grows with the input, so it is not broadcast, whatever its size looks like.
    text_of = lambda w: texts.join(w.hint("merge"), F.col("doc").eqNullSafe(F.col("wd")) & (F.col("th") == F.col("wh"))).select("comp", "id", "copies", "tile", "near", "text")
    repeated = placed.where("rows IS NOT NULL")
    if wanted.where("rows IS NOT NULL").isEmpty():
        once = text_of(placed)
    else:
        once = text_of(placed.where("rows IS NULL")).unionByName(text_of(repeated).dropDuplicates(["id"]))
    tiles = _pairs_of_tiles(arrow_map(once, _hash_large, _HASHED_SQL)).select("comp", "a", "b", "tile", "id", "copies", "text", "shingles")
    found = stage(arrow_map(_dealt(tiles, "comp"), _exact, "kind long, x long, y long"), "exact")
    counts = found.where("kind = 0").groupBy(F.col("x").alias("id")).agg(F.sum("y").alias("linked"))
    classes = stage(components(found.where("kind = 1").select("x", "y")), "classes")
    per_set = sets.select("id", "copies", "one").join(classes, "id", "left").join(counts, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    named_classes = stage(per_set.groupBy("comp").agg(F.min("one").alias("lead")), "class-leads")
    answer = per_set.join(named_classes, "comp").select("id", "lead", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.withColumn("id", F.when(F.col("low").isNotNull(), named)).join(answer, "id", "left")
    alone = F.col("low").isNull()
    result = out.select(
        F.col("doc").alias("doc_id"), F.col("th").alias("text_hash"), F.when(alone, F.col("doc")).otherwise(F.col("lead.doc")).alias("class_id"),
        F.when(alone, F.col("th")).otherwise(F.col("lead.th")).alias("class_hash"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    unstage(links, groups, sizes, wanted, plans)
    return result
