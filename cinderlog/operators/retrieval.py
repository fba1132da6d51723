"""Exact top-k retrieval by cosine similarity, relevance gate and answer status.

The search looks at every chunk for every query, as exactness demands, but never as a join that
emits pairs.  Chunks are staged in as many pieces as keep the cores busy and stay there; each task
multiplies its batches with a set of query vectors, block by block, and keeps the best ``limit`` chunks per
query.  Only those reach the shuffle.  A set is bounded in bytes, so what a task holds does not grow with the
queries; more queries are more sets, and the chunks are read again for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import strip
from cinderlog.sources.staging import broadcast_if_small, stage

# Largest block of query vectors that is multiplied at once, in bytes of doubles.
BLOCK_BYTES = 16 * 1024 * 1024
# Largest set of query vectors, and of chunks found for them, that a task holds, in bytes of doubles.
SET_BYTES = 32 * 1024 * 1024
# Blocks go to the tasks one by one up to this number, beyond it several together as the set allows.
_SETS = 16
# Products that are worth a task of their own while cores are free.
_TASK_PRODUCTS = 50_000_000
# Largest score matrix that is held at once, in numbers.
_SCORES = 1_000_000


def _margin(width: int) -> float:
    """Within this distance products of single precision are settled by an exact sum.

    A product of two vectors of length 1 is off by less than ``width + 8`` times 2**-24; two may be compared.
    """
    return (width + 8) * 2.0**-22


def _matrix(vectors: pa.Array | pa.ChunkedArray, width: int | None) -> np.ndarray:
    """Rows of an Arrow list array as doubles; all of one length, ``width`` if given."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(vectors.offsets.to_numpy())
    size = width if width is not None else (int(lengths[0]) if rows else 0)
    if rows and (size < 1 or (lengths != size).any() or len(flat) != rows * size):
        raise ValueError("vectors must have the same length, at least 1")
    if not np.isfinite(flat).all():
        raise ValueError("vectors must not hold NaN or infinite numbers")
    return flat.reshape(rows, size)


def _norms(matrix: np.ndarray) -> np.ndarray:
    return np.sqrt((matrix * matrix).sum(axis=1))


def _unit(matrix: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return matrix / np.where(norms == 0, 1.0, norms)[:, None]


class _Best:
    """The best chunks per query of one block seen so far.

    ``floor``, if given, is a score per query that chunks need to be of interest.
    """

    def __init__(self, queries: np.ndarray, limit: int, floor: np.ndarray | None = None) -> None:
        self.queries, self.limit = queries, limit
        self.norms = np.empty(len(queries))
        self.unit = np.empty(queries.shape, np.float32)
        step = max(1, _SCORES // max(1, queries.shape[1]))
        for start in range(0, len(queries), step):
            own = slice(start, start + step)
            self.norms[own] = _norms(queries[own])
            self.unit[own] = _unit(queries[own], self.norms[own])
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor.copy()
        self.held = np.zeros(len(queries), np.int64)
        self.ids = np.zeros((len(queries), 0), np.int64)
        self.scores = np.zeros((len(queries), 0), np.float64)

    def add(self, ids: np.ndarray, chunks: np.ndarray, asked: np.ndarray | None = None) -> None:
        """Take in chunks, for all queries or those with the ``asked`` places."""
        asked = np.arange(len(self.queries)) if asked is None else asked
        norms = _norms(chunks)
        unit = _unit(chunks, norms).astype(np.float32)
        places = max(1, _SCORES // max(1, min(len(ids), 512)))
        for low in range(0, len(asked), places):
            part = asked[low : low + places]
            rows = max(1, _SCORES // len(part))
            for start in range(0, len(ids), rows):
                own = slice(start, start + rows)
                self._add_block(ids[own], chunks[own], norms[own], unit[own], part)

    def _add_block(
        self, ids: np.ndarray, chunks: np.ndarray, norms: np.ndarray, unit: np.ndarray, asked: np.ndarray
    ) -> None:
        rough = unit @ self.unit[asked].T
        margin = _margin(chunks.shape[1])
        floor = self.floor[asked]
        unknown = np.flatnonzero(floor == -np.inf)
        if len(unknown) and len(ids) > self.limit:
            cut = len(ids) - self.limit
            floor[unknown] = np.partition(rough[:, unknown], cut, axis=0)[cut]
        # Rounding to single precision only lowers the bar.
        bar = np.nextafter((floor - margin).astype(np.float32), np.float32(-np.inf))
        row, place = np.divmod(np.flatnonzero(rough >= bar), len(asked))
        step = max(1, _SCORES // max(1, chunks.shape[1]))
        for start in range(0, len(row), step):
            own, query = row[start : start + step], asked[place[start : start + step]]
            products = (chunks[own] * self.queries[query]).sum(axis=1)
            lengths = norms[own] * self.norms[query]
            scores = np.divide(products, lengths, out=np.zeros(len(products)), where=lengths != 0)
            good = ~(scores < self.floor[query])
            if good.any():
                self._keep(query[good], ids[own[good]], scores[good])

    def _keep(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Merge candidates with what their queries, and only those, have kept."""
        touched = np.unique(query)
        held = self.held[touched]
        before = np.repeat(touched, held)
        place = np.arange(len(before)) - np.repeat(np.cumsum(held) - held, held)
        ids = np.concatenate([self.ids[before, place], ids])
        scores = np.concatenate([self.scores[before, place], scores])
        query = np.concatenate([before, query])
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.limit
        query, ids, scores, place = query[kept], ids[kept], scores[kept], place[kept]
        wider = int(place.max()) + 1 - self.ids.shape[1]
        if wider > 0:
            self.ids = np.pad(self.ids, ((0, 0), (0, wider)))
            self.scores = np.pad(self.scores, ((0, 0), (0, wider)))
        self.ids[query, place], self.scores[query, place] = ids, scores
        self.held[touched] = np.unique(query, return_counts=True)[1]
        full = place == self.limit - 1
        raised = query[full]
        self.floor[raised] = np.maximum(self.floor[raised], scores[full])

    def rows(self, query_ids: np.ndarray) -> pa.RecordBatch:
        query = np.repeat(np.arange(len(self.held)), self.held)
        place = np.arange(len(query)) - np.repeat(np.cumsum(self.held) - self.held, self.held)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(query_ids[query], pa.int64()),
                pa.array(self.ids[query, place], pa.int64()),
                pa.array(self.scores[query, place], pa.float64()),
            ],
            names=["query_id", "id", "score"],
        )


_SCORED = "query_id long, id long, score double"
_RANKED = "query_id long, rank int, id long, score double"


def query_blocks(queries: DataFrame, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of staged queries, in about ``blocks`` blocks of about one size."""
    for number in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number)
        block = own.select("query_id", "embedding").toArrow()
        if len(block):
            yield block["query_id"].to_numpy(), _matrix(block["embedding"], None)


def block_count(queries: DataFrame, block_bytes: int) -> int:
    """How many blocks of ``block_bytes`` of doubles staged queries take; 0 without queries."""
    count, size = _doubles(queries)
    if count and not size:
        raise ValueError("vectors must have the same length, at least 1")
    return -(-size // block_bytes)


def _scored(
    chunks: DataFrame, query_ids: np.ndarray, vectors: np.ndarray, limit: int, block_bytes: int
) -> DataFrame:
    """Candidates of one set of queries: the best chunks of every task."""
    shared = chunks.sparkSession.sparkContext.broadcast((query_ids, vectors))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        width = matrix.shape[1]
        rows = max(1, block_bytes // (8 * width))
        starts = range(0, len(ids), rows)
        blocks = [_Best(matrix[start : start + rows], limit) for start in starts]
        step = max(1, _SCORES // width)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                part_ids, part_matrix = part.column(0).to_numpy(), _matrix(part.column(1), width)
                for best in blocks:
                    best.add(part_ids, part_matrix)
        for start, best in zip(starts, blocks):
            yield best.rows(ids[start : start + rows])

    return chunks.select("id", "embedding").mapInArrow(find, _SCORED)


def best_of(candidates: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` candidates of every query: ``(query_id, rank, id, score)``."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return (
        candidates.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "id", "score")
    )


def _doubles(frame: DataFrame) -> tuple[int, int]:
    """Row count and bytes of the vectors as doubles."""
    row = frame.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.size("embedding")).alias("numbers")
    ).first()
    return row["rows"], 8 * (row["numbers"] or 0)


def search(
    queries: DataFrame,
    chunks: DataFrame,
    limit: int = fixed.EVIDENCE_LIMIT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The ``limit`` most similar chunks of every query: ``(query_id, rank, id, score)``.

    Exact; equal scores rank by chunk id.  ``query_id`` and ``id`` are integers.  Vectors of other
    lengths, or with numbers that are not finite, fail the search, as they have no place in a
    ranking.  The vectors of both sides are staged, so an embedder above them runs once.
    """
    asked = stage(queries.select("query_id", "embedding"), "query-vectors")
    blocks = block_count(asked, block_bytes)
    if not blocks:
        return chunks.sparkSession.createDataFrame([], _RANKED)
    kept = stage(chunks.select("id", "embedding"), "chunk-vectors")
    (count, size), number = _doubles(asked), kept.count()
    pieces = min(2 * kept.sparkSession.sparkContext.defaultParallelism, count * number // _TASK_PRODUCTS)
    if pieces > 1:
        # Tables may come in few pieces, or in pieces of which few have rows.
        kept = stage(kept.repartition(pieces), "chunk-vectors")
    held = size + 16 * count * min(limit, number)
    sets = max(min(blocks, _SETS), -(-held // SET_BYTES))
    found = [
        _scored(kept, ids, vectors, limit, block_bytes) for ids, vectors in query_blocks(asked, sets)
    ]
    # Ranked once, as a plan with a ranking for each set would sort them side by side in every task.
    return best_of(reduce(DataFrame.unionAll, found), limit)


def with_chunks(matches: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add source, heading and content of the matched chunks.

    The matches are few per query, so they are staged and, when counted to be small, broadcast;
    the index is then read once more without its vectors and not shuffled.
    """
    staged = broadcast_if_small(stage(matches, "matches"))
    texts = chunks.select("id", "source", "heading", "content")
    return texts.join(staged, "id").select(
        "query_id", "rank", "id", "source", "heading", "content", "score"
    )


def runbook_label(rank: Column) -> Column:
    return F.format_string("R%d", rank)


def retrieve(
    questions: DataFrame,
    chunks: DataFrame,
    limit: int = fixed.EVIDENCE_LIMIT,
) -> DataFrame:
    """Evidence rows for ``(question_id, question, embedding)``; blank questions get none.

    The filter on blank questions runs before the search, so an embedder below it is not
    called for them.
    """
    asked = questions.filter(strip(F.col("question")) != "").select(
        F.col("question_id").alias("query_id"), "embedding"
    )
    return with_chunks(search(asked, chunks, limit), chunks).withColumnRenamed(
        "query_id", "question_id"
    )


def relevance_gate(
    questions: DataFrame, evidence: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD
) -> DataFrame:
    """Add ``best_score``, ``threshold`` and ``accepted``; no evidence counts as score 0."""
    best = evidence.groupBy("question_id").agg(F.max("score").alias("_best"))
    score = F.coalesce("_best", F.lit(0.0))
    asked = strip(F.col("question")) != ""
    return questions.join(best, "question_id", "left").select(
        *questions.columns,
        score.alias("best_score"),
        F.lit(threshold).alias("threshold"),
        (asked & (score >= threshold)).alias("accepted"),
    )


def answer_status(gated: DataFrame, index: DataFrame) -> DataFrame:
    """Route every aligned and gated question: mismatch, empty, rejected or answer.

    The first that applies wins.  ``reply`` is the fixed text of the first three.
    """
    filled = index.limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    status = (
        F.when(~F.col("aligned"), "mismatch")
        .when(~F.col("_filled"), "empty")
        .when(~F.col("accepted"), "rejected")
        .otherwise("answer")
    )
    mismatch = F.format_string(fixed.MISMATCH_ANSWER, "question_domain", "incident_domain")
    return (
        gated.withColumn("_filled", filled)
        .withColumn("status", status)
        .withColumn(
            "reply",
            F.when(F.col("status") == "mismatch", mismatch)
            .when(F.col("status") == "empty", fixed.EMPTY_INDEX_ANSWER)
            .when(F.col("status") == "rejected", fixed.REJECTED_ANSWER),
        )
        .drop("_filled")
    )
