"""Hard-negative mining by a Voronoi-partitioned distributed nearest-neighbour join.

Inner products become distances: a row gets one more component that brings its norm to the greatest norm M of the table, an anchor gets a zero there, so that
``|x - y|² = |x|² + M² - 2xy`` and the best scores are the nearest rows.  Every row goes to the cell of its nearest pivot and keeps its distance to it.  Anchors that lie close together form groups.  For an
anchor, scores against the pivot sample give a first bound on what it needs; with the triangle inequality, a group needs of a cell only rows
whose distance to the pivot lies in one interval.  Rows are replicated to the groups whose interval they fall into, dealt out in blocks of bounded size, and joined there exactly by
integer inner products; the best of all blocks are the result.  Two such joins run: the first for positives (rows of the anchor's label), the second, with the score ranges that the positives set, for negatives.

Of rows with one vector and one label only those with the least ids can be in a result, so a vector that very many rows share counts ``KEEP`` times, and anchors that share vector and label are
searched for once.  Pivots are a bounded sample (``MAX_PIVOTS`` at most, the square root of the rows before that); bounds, cells and joins see every row, and the result is exact, whatever the sample.

Defined results for odd input: rows without an id, a label or a vector take no part, nor do vectors with null components; vectors of different lengths are filled up with zeros; rows that repeat id, label and vector
count once; of rows that share an id but differ otherwise the one with the least label and vector counts; ties go to smaller ids; other columns are ignored; an empty table, or one without anchors, gives no rows.
Scores must fit 64 bits: a table whose components are too large for that is refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranking import global_row_number
from ..plans.staging import ship_package, stage, unstage
from .common import arrow_map

MAX_PIVOTS = 1024
#: Anchors of a group; rows of a block that one task joins with a group; rows that are multiplied at once.
GROUP, BLOCK, TILE = 512, 1 << 15, 4096
#: Rounding slack of distances, as a share of the greatest norm.
SLACK = 1e-6


@dataclass(frozen=True)
class Wanted:
    """Positives of an anchor, negatives of a pair, and the hundredths of the positive's score between which a negative's lies."""

    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90

    @property
    def keep(self) -> int:
        """Rows of one vector and label that can be in a result (an anchor may be one of them)."""
        return max(self.positives + 1, self.negatives)


@dataclass(frozen=True)
class Space:
    """Shape of the table and its pivots; vectors travel as bytes of ``dtype``."""

    dim: int
    dtype: str
    exact_floats: bool
    norm: float
    pivots: np.ndarray
    labels: np.ndarray

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=self.dtype).reshape(-1, self.dim)

    def products(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exact integer inner products of rows of ``a`` with rows of ``b``."""
        kind = np.float64 if self.exact_floats else np.int64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)

    def to_pivots(self, rows: np.ndarray, are_anchors: bool) -> np.ndarray:
        """Distances to all pivots; anchors have a zero as their further component."""
        squares, top = np.einsum("ij,ij->i", rows, rows, dtype=np.float64), self.norm**2
        flat = rows.astype(np.float64) @ self.pivots.astype(np.float64).T
        if are_anchors:
            return np.sqrt(np.maximum(squares[:, None] + top - 2 * flat, 0))
        further = np.sqrt(np.maximum(top - squares, 0))
        own = np.sqrt(np.maximum(top - np.einsum("ij,ij->i", self.pivots, self.pivots, dtype=np.float64), 0))
        return np.sqrt(np.maximum(2 * top - 2 * (flat + further[:, None] * own[None, :]), 0))

    def distance(self, squares: np.ndarray, scores: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares + self.norm**2 - 2 * scores, 0))


def _rows(vectors: DataFrame) -> DataFrame:
    """One row (vec_id, label, vector) an id."""
    rows = vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), F.col("`label`").cast("long").alias("label"), F.col("`vector`").cast("array<bigint>").alias("vector"))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull()))
    return whole.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("r")).select("vec_id", "r.label", "r.vector")


def _candidates(rows: DataFrame, keep: int) -> DataFrame:
    """Of rows with one vector and label the ``keep`` with the least ids; Spark cuts such a window before it shuffles, too."""
    order = Window.partitionBy("label", "vector").orderBy("vec_id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep).drop("nth")


def _packed(rows: DataFrame, dim: int, dtype: str) -> DataFrame:
    """Rows with their vectors as bytes, filled up with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("vector")
            sizes = np.diff(v.offsets.to_numpy())
            flat, out = v.flatten().to_numpy().astype(dtype), np.zeros((len(v), dim), dtype)
            out[np.arange(dim)[None, :] < sizes[:, None]] = flat
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([r.tobytes() for r in out], pa.binary())], names=["vec_id", "label", "packed"])

    return arrow_map(rows, run, "vec_id long, label long, packed binary")


def _space(packed: DataFrame, dim: int, most: int, dtype: str) -> Space:
    """The table's greatest norm and a bounded sample of pivots: rows with the least hashes of their ids."""
    n = packed.count()
    chosen = packed.orderBy(F.xxhash64("vec_id"), "vec_id").limit(int(min(MAX_PIVOTS, max(16, n**0.5)))).collect()
    pivots = np.frombuffer(b"".join(bytes(r.packed) for r in chosen), dtype=dtype).reshape(-1, dim)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype=dtype).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.einsum("ij,ij->i", m, m, dtype=np.float64).max(initial=0))], pa.float64())], names=["top"])

    top = arrow_map(packed.select("packed"), norms, "top double").agg(F.max("top")).first()[0] or 0.0
    return Space(dim, dtype, dim * most * most < 2**53, max(top, 1e-300) ** 0.5, pivots, np.array([r.label for r in chosen]))


def _celled(packed: DataFrame, space: Space) -> DataFrame:
    """Rows with their cell and their distance to its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = space.to_pivots(space.matrix(b.column("packed")), False)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "away"])

    return arrow_map(packed, run, "vec_id long, label long, packed binary, cell int, away double")


def _grouped(anchors: DataFrame, space: Space) -> DataFrame:
    """Anchors with the number of their group: neighbours in a chain of pivots, and near to far from a pivot, stand together."""
    todo, chain = set(range(1, len(space.pivots))), [0]
    flat = space.to_pivots(space.pivots, False)
    while todo:  # greedy walk over the pivots, a bounded number
        nearest = min(todo, key=lambda j: flat[chain[-1], j])
        chain.append(nearest)
        todo.remove(nearest)
    place = np.empty(len(chain), np.int64)
    place[chain] = np.arange(len(chain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = space.to_pivots(space.matrix(b.column("packed")), True)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(place[cell]), pa.array(d[np.arange(len(cell)), cell])], names=[*b.schema.names, "cell", "away"])

    near = arrow_map(anchors, run, "vec_id long, label long, packed binary, cell long, away double")
    return global_row_number(near, "number", "cell", "away", "vec_id").select("vec_id", "label", "packed", F.floor((F.col("number") - 1) / GROUP).cast("int").alias("group"))


def _kth_best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each row; the least 64-bit number if there are fewer columns."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _in_range(scores: np.ndarray, positive: np.ndarray, w: Wanted) -> np.ndarray:
    """Where a negative's score fits a positive's (a column); compared by division so that nothing overflows."""
    low, high = -((-w.low * positive) // 100), (w.high * positive) // 100
    return (scores >= low) & (scores <= high)


LEAST = np.iinfo(np.int64).min


def _needs(space: Space, w: Wanted, for_negatives: bool, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that each anchor of a batch may need, from its positives and the pivot sample."""
    rows, label = space.matrix(batch.column("packed")), batch.column("label").to_numpy()
    sample = space.products(rows, space.pivots)
    same = label[:, None] == space.labels[None, :]
    if not for_negatives:
        return _kth_best(np.where(same, sample, LEAST), w.positives + 1), np.full(len(rows), np.iinfo(np.int64).max)
    low, high = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), LEAST)
    for i, scores in enumerate(batch.column("scores").to_pylist()):
        for s in scores:
            if s >= 0:  # below zero the range is empty
                fit = _in_range(sample[i], np.int64(s), w) & ~same[i]
                low[i] = min(low[i], max(-((-w.low * s) // 100), _kth_best(np.where(fit, sample[i], LEAST)[None, :], w.negatives)[0]))
                high[i] = max(high[i], (w.high * s) // 100)
    return low, high


def _intervals(anchors: DataFrame, space: Space, w: Wanted, for_negatives: bool) -> DataFrame:
    """(group, cell, near, far): the distances from a cell's pivot between which a group may need rows; for positives also by label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            rows, group, label = space.matrix(b.column("packed")), b.column("group").to_numpy(), b.column("label").to_numpy()
            least, most = _needs(space, w, for_negatives, b)
            squares = np.einsum("ij,ij->i", rows, rows, dtype=np.float64)
            far = np.where(least == LEAST, np.inf, space.distance(squares, least.astype(np.float64)))
            near = space.distance(squares, np.minimum(most.astype(np.float64), space.norm * np.sqrt(squares)))
            slack, d = SLACK * space.norm, space.to_pivots(rows, True)
            low = np.maximum(np.maximum(d - far[:, None], near[:, None] - d), 0) - slack
            high = d + far[:, None] + slack
            cells, of_label = np.arange(d.shape[1]), np.zeros_like(label) if for_negatives else label
            needed = least <= most
            for g, l in np.unique(np.stack([group[needed], of_label[needed]]), axis=1).T:
                of = needed & (group == g) & (of_label == l)
                columns = (pa.array(np.full(len(cells), g), pa.int32()), pa.array(np.full(len(cells), l), pa.int64()), pa.array(cells, pa.int32()), pa.array(low[of].min(axis=0)), pa.array(high[of].max(axis=0)))
                yield pa.RecordBatch.from_arrays(list(columns), names=["group", "label", "cell", "near", "far"])

    found = arrow_map(anchors, run, "group int, label long, cell int, near double, far double")
    return found.groupBy("group", "cell", *([] if for_negatives else ["label"])).agg(F.min("near").alias("near"), F.max("far").alias("far"))


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best: higher scores first, smaller ids among equals."""
    if len(score) > 4 * k:  # everything that may be among them, ties with the last one too
        few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        few = np.arange(len(score))
    return few[np.lexsort((ids[few], -score[few]))[:k]]


def _local_join(space: Space, w: Wanted, for_negatives: bool, _key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The best rows of a block (left) for each anchor of a group (right): (anchor, bound, vec_id, score).

    ``bound`` is the positive's score that a negative belongs to, null for positives.
    """
    out: list[tuple[int, int | None, np.ndarray, np.ndarray]] = []
    if right.num_rows and left.num_rows:
        left, right = left.combine_chunks(), right.combine_chunks()
        anchors, a_id, a_label = space.matrix(right.column("packed")), right.column("vec_id").to_numpy(), right.column("label").to_numpy()
        rows, ids, labels = space.matrix(left.column("packed")), left.column("vec_id").to_numpy(), left.column("label").to_numpy()
        bounds = [sorted({s for s in v if s >= 0}) for v in right.column("scores").to_pylist()] if for_negatives else [[None]] * len(anchors)
        kept: dict[tuple[int, int | None], tuple[np.ndarray, np.ndarray]] = {}
        k = w.negatives if for_negatives else w.positives + 1
        for at in range(0, len(rows), TILE):
            scores = space.products(anchors, rows[at : at + TILE])
            tile_ids, tile_labels = ids[at : at + TILE], labels[at : at + TILE]
            for i in range(len(anchors)):
                same = tile_labels == a_label[i]
                for bound in bounds[i]:
                    fit = np.flatnonzero(same if bound is None else ~same & _in_range(scores[i], np.int64(bound), w))
                    if len(fit):
                        old = kept.get((i, bound), (np.empty(0, np.int64), np.empty(0, np.int64)))
                        s, n = np.concatenate([old[0], scores[i][fit]]), np.concatenate([old[1], tile_ids[fit]])
                        top = _best(s, n, k)
                        kept[i, bound] = s[top], n[top]
        out = [(a_id[i], bound, s, n) for (i, bound), (s, n) in kept.items()]
    sizes = [len(x[2]) for x in out]
    repeat = lambda j, kind: pa.array([x[j] for x, c in zip(out, sizes, strict=True) for _ in range(c)], kind)
    flat = lambda j: pa.array(np.concatenate([x[j] for x in out]) if out else np.empty(0, np.int64), pa.int64())
    return pa.table({"anchor": repeat(0, pa.int64()), "bound": repeat(1, pa.int64()), "vec_id": flat(3), "score": flat(2)})


_FOUND = "anchor long, bound long, vec_id long, score long"


def _joined(anchors: DataFrame, rows: DataFrame, n_rows: int, space: Space, w: Wanted, for_negatives: bool) -> DataFrame:
    """The best rows of all for each anchor (and bound), ranked from 1."""
    spark, blocks = rows.sparkSession, -(-n_rows // BLOCK)
    ship_package(spark)
    spans = _intervals(anchors, space, w, for_negatives)
    # A cell serves a group only with the rows inside the group's interval; blocks keep a group's rows from meeting in one task.
    served = rows.join(spans, ["cell"] if for_negatives else ["cell", "label"]).where((F.col("away") >= F.col("near")) & (F.col("away") <= F.col("far")))
    candidates = served.select("group", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "label", "packed")
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("group", "block", "vec_id", "label", "packed", *(["scores"] if for_negatives else []))
    found = candidates.groupBy("group", "block").cogroup(asked.groupBy("group", "block")).applyInArrow(partial(_local_join, space, w, for_negatives), _FOUND)
    order = Window.partitionBy("anchor", "bound").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= (w.negatives if for_negatives else w.positives + 1))


def mine(vectors: DataFrame, is_anchor: Column, wanted: Wanted = Wanted()) -> DataFrame:
    """Hard negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, vector) for which ``is_anchor`` holds.

    An anchor's positives are its best other rows of the same label.  A pair's negatives are the best rows of other labels with a score between ``low`` and ``high``
    hundredths of the positive's.
    """
    w, spark = wanted, vectors.sparkSession
    rows = stage(_rows(vectors), "vectors")
    shape = rows.agg(F.max(F.size("vector")).alias("dim"), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x)))).alias("most")).first()
    dim, most = max(shape.dim or 0, 1), shape.most or 0
    if dim * most * most >= 2**62 // 100:
        raise ValueError("scores of these vectors do not fit 64 bits")
    dtype = next(t for t, top in (("<i2", 2**15), ("<i4", 2**31), ("<i8", 2**63)) if most < top)
    # All anchors with the one that stands for those of the same vector and label.
    every = rows.where(is_anchor)
    stands = stage(every.join(every.groupBy("label", "vector").agg(F.min("vec_id").alias("anchor")), ["label", "vector"]).select("vec_id", "label", "anchor", "vector"), "anchors")
    if stands.isEmpty():
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    packed = stage(_packed(_candidates(rows, w.keep), dim, dtype), "packed")
    space = _space(packed, dim, most, dtype)
    cells = stage(_celled(packed, space), "cells")
    n = cells.count()
    unstage(rows, packed)
    groups = stage(_grouped(_packed(stands.where("vec_id = anchor").select("vec_id", "label", "vector"), dim, dtype), space), "anchor-groups")
    positives = stage(_joined(groups, cells, n, space, w, False), "positives")
    scores = positives.groupBy(F.col("anchor").alias("vec_id")).agg(F.sort_array(F.collect_set("score")).alias("scores"))
    asking = stage(groups.join(scores, "vec_id"), "anchor-scores")
    negatives = stage(_joined(asking, cells, n, space, w, True), "negatives")
    unstage(cells, groups, asking)
    near = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place"))
    pairs = stands.select(F.col("vec_id").alias("anchor_id"), "anchor").join(near, "anchor").where("positive_id <> anchor_id")
    # One more positive than wanted was kept: the anchor itself may be among them.
    nth = F.row_number().over(Window.partitionBy("anchor_id").orderBy("place"))
    first = pairs.withColumn("nth", nth).where(F.col("nth") <= w.positives).select("anchor", "anchor_id", "positive_id", "positive_score")
    mined = negatives.select("anchor", F.col("bound").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").cast("int").alias("rank"))
    return first.join(mined, ["anchor", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
