"""Hard negatives by threshold joins of anchors with all rows."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.batches import bound_batches
from cinderlog.sources.staging import stage

POSITIVES = 5
NEGATIVES = 10
# Bounds of a negative's score, in hundredths of the positive's.
WINDOW = (30, 90)
# Bytes of anchor vectors that one round of jobs sends to all tasks.
BLOCK_BYTES = 16 << 20
# Rows and anchors whose scores are held at once, and dimensions added at once.
_ROWS, _ANCHORS, _STEP = 2048, 512, 16
# Below this share of pairs in reach, the rest of a score is added pair by pair.
_FEW = 0.05
# Starting thresholds for positives as shares of the largest score that norms allow; then none.
_LEVELS = (0.6, 0.4, 0.25)
# The first threshold leaves a share of a negative window that shrinks with the rows.
_FIRST = 1000

_FOUND = "window long, anchor_id long, positive_id long, positive_score double, id long, score double, last boolean"


class Block(NamedTuple):
    """Anchors of one round; dimensions in the order of the index."""

    ids: np.ndarray
    labels: np.ndarray
    matrix: np.ndarray


class Windows(NamedTuple):
    """Score windows of a block's anchors: rows of the same or of another label within bounds."""

    number: np.ndarray
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    positive_id: np.ndarray
    positive_score: np.ndarray

    def only(self, chosen: np.ndarray) -> Windows:
        return Windows(*(values[chosen] for values in self))


def matrix_of(vectors: pa.Array, order: np.ndarray) -> np.ndarray:
    """A list column as a matrix with columns in ``order``; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    if len(sizes) and (sizes == len(order)).all():
        return values.reshape(len(sizes), len(order))[:, order]
    matrix = np.zeros((len(sizes), len(order)))
    matrix[np.repeat(np.arange(len(sizes)), sizes), _places(sizes)] = values
    return matrix[:, order]


def _places(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def suffix_norms(matrix: np.ndarray) -> np.ndarray:
    """Norms of what is left of each row before every step of dimensions, a little too large."""
    squares = np.cumsum((matrix * matrix)[:, ::-1], axis=1)[:, ::-1]
    left = np.sqrt(squares[:, ::_STEP]) * (1 + 1e-9)
    return np.hstack([left, np.zeros((len(matrix), 1))])


def in_reach(
    rows: np.ndarray, anchors: np.ndarray, anchor_norms: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs ``row, anchor, score`` whose score is at least the anchor's ``least``.

    The index holds lists of row values by dimension.  A row's last dimensions are left out of it from where
    the norms of what is left, of the row and of any anchor, cannot reach a threshold by themselves; with rows
    in the order of their indexed dimensions each list is a prefix.  Partial scores grow list by list;
    pairs that the remaining norms cannot lift to the threshold are dropped, and the others get
    the rest of their scores from the vectors.
    """
    norms = suffix_norms(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.nan_to_num(least[:, None] / anchor_norms, nan=0.0, posinf=np.inf, neginf=-np.inf).min(axis=0)
    indexed = (norms[:, :-1] >= need[None, :-1]).sum(axis=1)
    order = np.argsort(-indexed, kind="stable")
    lists, norms, indexed = np.ascontiguousarray(rows[order].T), norms[order], indexed[order]
    partial = np.zeros((len(rows), len(anchors)))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def settle(some: slice, step: int) -> None:
        """Verify the pairs of rows that leave the index before ``step``."""
        reach = partial[some] + norms[some, step, None] * anchor_norms[None, :, step] >= least
        i, a = np.nonzero(reach)
        i += some.start
        rest = slice(step * _STEP, None)
        for start in range(0, len(i), 1 << 16):
            ii, aa = i[start : start + (1 << 16)], a[start : start + (1 << 16)]
            scores = partial[ii, aa] + np.einsum("ij,ij->i", lists[rest, ii].T, anchors[aa, rest])
            good = scores >= least[aa]
            out.append((order[ii[good]], aa[good], scores[good]))

    steps = norms.shape[1] - 1
    held = len(rows)
    for step in range(steps + 1):
        stay = int(np.searchsorted(-indexed[:held], -step, side="left")) if step < steps else 0
        if stay < held:
            settle(slice(stay, held), step)
            held = stay
        if not held:
            break
        part = slice(step * _STEP, (step + 1) * _STEP)
        partial[:held] += lists[part, :held].T @ anchors[:, part].T
        bound = partial[:held] + norms[:held, step + 1, None] * anchor_norms[None, :, step + 1]
        if np.count_nonzero(bound >= least) < _FEW * bound.size:
            settle(slice(0, held), step + 1)
            break
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0)
    return tuple(np.concatenate(parts) for parts in zip(*out))


class Found:
    """The best rows of each window in one task; full windows raise their thresholds."""

    def __init__(self, block: Block, windows: Windows, start: np.ndarray, same: bool, limit: int):
        self.block, self.windows, self.same, self.limit = block, windows, same, limit
        self.floor = start.copy()
        self.window = np.zeros(0, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int64)
        self.scores = np.zeros(0)
        # Windows of one anchor stand together; the n-th window of every anchor is one layer.
        self.first = np.searchsorted(windows.anchor, np.arange(len(block.ids)))
        self.count = np.bincount(windows.anchor, minlength=len(block.ids))
        self.asked = np.flatnonzero(self.count)
        self.norms = suffix_norms(block.matrix)

    def add(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for start in range(0, len(self.asked), _ANCHORS):
            part = self.asked[start : start + _ANCHORS]
            end = self.first[part[-1]] + self.count[part[-1]]
            least = np.minimum.reduceat(self.floor[:end], self.first[part])
            for low in range(0, len(rows), _ROWS):
                i, a, scores = in_reach(rows[low : low + _ROWS], self.block.matrix[part], self.norms[part], least)
                self._take(ids, labels, i + low, part[a], scores)

    def _take(self, ids, labels, i, anchors, scores) -> None:
        equal = labels[i] == self.block.labels[anchors]
        good = equal & (ids[i] != self.block.ids[anchors]) if self.same else ~equal
        i, anchors, scores = i[good], anchors[good], scores[good]
        new = []
        for layer in range(self.count.max() if len(i) else 0):
            some = np.flatnonzero(self.count[anchors] > layer)
            w = self.first[anchors[some]] + layer
            fits = (scores[some] >= self.floor[w]) & (scores[some] <= self.windows.high[w])
            new.append((w[fits], ids[i[some[fits]]], scores[some[fits]]))
        if not sum(len(w) for w, _, _ in new):
            return
        window, ids, scores = (np.concatenate(x) for x in zip((self.window, self.ids, self.scores), *new))
        order = np.lexsort((ids, -scores, window))
        window, ids, scores = window[order], ids[order], scores[order]
        place = _places(np.bincount(window))
        kept = place < self.limit
        self.window, self.ids, self.scores = window[kept], ids[kept], scores[kept]
        full = place[kept] == self.limit - 1
        self.floor[self.window[full]] = self.scores[full]

    def rows(self, last: np.ndarray) -> pa.RecordBatch:
        w = self.window
        columns = [
            self.windows.number[w],
            self.block.ids[self.windows.anchor[w]],
            self.windows.positive_id[w],
            self.windows.positive_score[w],
            self.ids,
            self.scores,
            last[w],
        ]
        names = [field.split()[0] for field in _FOUND.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names=names)


def _join(
    rows: DataFrame, order: np.ndarray, block: Block, windows: Windows, start: np.ndarray, last: np.ndarray, same: bool, limit: int
) -> DataFrame:
    """One row per window with rows at or above its threshold, and the best of these as a list."""
    shared = rows.sparkSession.sparkContext.broadcast((order, block, windows, start, last))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, block, windows, start, last = shared.value
        found = Found(block, windows, start, same, limit)
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found.add(ids, labels, matrix_of(batch.column(2), order))
        yield found.rows(last)

    best = Window.partitionBy("window").orderBy(F.col("score").desc(), "id")
    top = (
        rows.mapInArrow(search, _FOUND)
        .withColumn("_place", F.row_number().over(best))
        .where(F.col("_place") <= limit)
    )
    return top.groupBy("window", "anchor_id", "positive_id", "positive_score", "last").agg(
        F.sort_array(F.collect_list(F.struct("_place", "id", "score"))).alias("matches")
    )


def _fill(
    rows: DataFrame, order: np.ndarray, block: Block, windows: Windows, levels: Iterator[np.ndarray], same: bool, limit: int
) -> list[DataFrame]:
    """Windows with their best rows; thresholds of the windows that are not full go down by ``levels``.

    Each round's result is staged.  A window is settled when it is full or its threshold is its lower bound.
    """
    settled = []
    for level in levels:
        if not len(windows.number):
            break
        start = np.maximum(level[windows.number], windows.low)
        last = start <= windows.low
        name = "positives" if same else "negatives"
        found = stage(_join(rows, order, block, windows, start, last, same, limit), f"hard-{name}")
        settled.append(found.where((F.size("matches") == limit) | F.col("last")))
        full = found.where(F.size("matches") == limit).select("window").toArrow()["window"].to_numpy()
        windows = windows.only(~(last | np.isin(windows.number, full)))
    return settled


def _facts(rows: DataFrame) -> tuple[int, np.ndarray, float]:
    """Number of rows, energy by dimension, and the largest norm."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, energy, largest = 0, np.zeros(0), 0.0
        for batch in batches:
            vectors = batch.column(0)
            width = int(np.diff(vectors.offsets.to_numpy()).max(initial=0))
            squares = matrix_of(vectors, np.arange(width)) ** 2
            energy = np.pad(energy, (0, max(0, width - len(energy))))
            energy[:width] += squares.sum(axis=0)
            count += len(squares)
            largest = max(largest, float(squares.sum(axis=1).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays(
            [pa.array([count]), pa.array([energy.tolist()], pa.list_(pa.float64())), pa.array([largest])],
            names=["n", "energy", "largest"],
        )

    parts = stage(rows.select("vector").mapInArrow(summed, "n long, energy array<double>, largest double"), "vector-facts")
    n, largest = parts.agg(F.sum("n"), F.max("largest")).first()
    by_dimension = parts.select(F.posexplode("energy").alias("at", "energy")).groupBy("at").agg(F.sum("energy").alias("energy"))
    energy = [row["energy"] for row in by_dimension.sort("at").collect()]
    return n or 0, np.array(energy), float(np.sqrt(largest or 0.0))


_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine_negatives(
    rows: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hard negatives of every anchor and positive, best first.

    ``rows`` has ``vec_id`` (integer), ``label`` (integer) and ``vector`` (array of whole numbers as
    doubles, whose inner products stay below 2^53); ``anchors`` is a condition on these.  A score is
    the inner product with the anchor; higher comes first, ties by smaller id.  An anchor's positives are its first
    other rows of the same label.  For each of them the result has the first rows of another label whose
    score lies within ``window`` hundredths of the positive's: ``anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score``.

    Rows stay where they are.  Anchors go to the tasks in blocks of ``block_bytes``, each block against all
    rows; a task returns the best rows of each window only.  Thresholds start high and go down
    for windows that are not full, to a window's lower bound, so nothing is lost.

    Rows with a null id, label or vector, or a component that is null or not finite, take no part.  Of rows with
    the same id the least by label and vector takes part.  Shorter vectors end in zeros.  An anchor without
    another row of its label, and a positive with a score below zero, have no negatives.  Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    bound_batches()
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    sound = rows.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("long").alias("label"),
        F.col("vector").cast("array<double>").alias("vector"),
    ).where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(~bad)
    one = sound.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("_row"))
    table = stage(one.select("vec_id", "_row.label", "_row.vector"), "vectors")
    count, energy, largest = _facts(table)
    order = np.argsort(-energy, kind="stable")
    asked = stage(table.where(anchors), "anchors")
    blocks = -(-asked.count() * (8 * len(order) + 64) // block_bytes)
    numbered = asked.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks))))
    done = []
    for number in range(blocks):
        held = numbered.where(F.col("_block") == number).sort("vec_id").toArrow()
        ids, labels = (held[name].to_numpy() for name in ("vec_id", "label"))
        block = Block(ids, labels, matrix_of(held["vector"], order))
        first = _positives(table, order, block, largest, positives)
        done += _negatives(table, order, block, first, count, negatives, window)
    if not done:
        return spark.createDataFrame([], _RESULT)
    every = reduce(DataFrame.unionByName, done)
    return every.select("anchor_id", "positive_id", "positive_score", F.inline("matches")).select(
        "anchor_id",
        "positive_id",
        F.col("_place").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("positive_score").cast("long").alias("positive_score"),
        F.col("score").cast("long").alias("negative_score"),
    )


def _positives(table: DataFrame, order: np.ndarray, block: Block, largest: float, limit: int) -> list:
    """Rows ``anchor (its place in the block), positive id, score``."""
    size = len(block.ids)
    some, none = np.full(size, -np.inf), np.zeros(size)
    windows = Windows(np.arange(size), np.arange(size), some, -some, none.astype(np.int64), none)
    bound = np.linalg.norm(block.matrix, axis=1) * largest
    levels = iter([share * bound for share in _LEVELS] + [some])
    found = _fill(table, order, block, windows, levels, True, limit)
    if not found:
        return []
    every = reduce(DataFrame.unionByName, found).select("window", F.inline("matches"))
    return every.sort("window", "_place").select("window", "id", "score").collect()


def _negatives(
    table: DataFrame, order: np.ndarray, block: Block, first: list, count: int, limit: int, window: tuple[int, int]
) -> list[DataFrame]:
    scores = np.array([row["score"] for row in first])
    whole = scores.astype(np.int64)
    low = -(-window[0] * whole // 100).astype(float)
    high = (window[1] * whole // 100).astype(float)
    windows = Windows(
        np.arange(len(first)),
        np.array([row["window"] for row in first], dtype=np.int64),
        low,
        high,
        np.array([row["id"] for row in first], dtype=np.int64),
        scores,
    )

    def levels() -> Iterator[np.ndarray]:
        share = _FIRST / max(1, count)
        while share < 1:
            yield high - share * (high - low)
            share *= 4
        yield low

    return _fill(table, order, block, windows.only(low <= high), levels(), False, limit)
