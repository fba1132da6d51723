"""Exact top-k without looking at every chunk.

Chunk vectors are kept in clusters of similar direction, a cluster to a folder, in order of their
angle to the cluster's centre.  By the triangle inequality for angles a chunk at angle ``a`` from a centre
that is at angle ``t`` from the query is at least ``|t - a|`` away from the query.  A first pass reads the
clusters nearest to each query and so gives it a score to beat; a second pass reads
only clusters, and in them only batches, that some query can still find a better chunk in.  The
result is that of ``retrieval.search``.  How much is saved depends on how well the vectors cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog import fixed_values as fixed
from cinderlog.operators.retrieval import (
    _RANKED,
    _SCORED,
    _SCORES,
    BLOCK_BYTES,
    SET_BYTES,
    _Best,
    _doubles,
    _matrix,
    _norms,
    _unit,
    best_of,
    block_count,
    query_blocks,
)
from cinderlog.schemas import CHUNKS
from cinderlog.sources.staging import stage

# Centres come from at most this many vectors; only the saving depends on them, not the result.
SAMPLE = 20_000
MOST_CLUSTERS = 1024
# Vectors without a direction score 0 with every query.
_NO_DIRECTION = -1
# Angles are this precise at worst, close to 0; scores may be this much too large.
_PRECISION = 1e-7
_MARGIN = 1e-9
_ROUNDS = 8
# Angles between queries and centres held at once, in numbers.
_ANGLES = 1_000_000


class Clustered(NamedTuple):
    """Chunk rows with ``cluster`` and ``angle``, and one row per cluster: size, angles and centre."""

    rows: DataFrame
    facts: DataFrame


def centres(vectors: DataFrame, count: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors in the middle of similar directions, from a bounded sample by a hash of the id.

    Lloyd's steps on the sample: each vector joins its most similar centre, which becomes their mean.
    """
    total = vectors.count()
    chance = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") * F.lit(2.0**-53)
    few = vectors.where(chance * F.lit(float(total)) < F.lit(1.1 * sample)) if total > sample else vectors
    chosen = few.select("id", "embedding").sort("id").limit(sample).toArrow()
    matrix = _matrix(chosen["embedding"], None)
    norms = _norms(matrix)
    unit = _unit(matrix, norms)[norms > 0]
    if not len(unit):
        return np.zeros((0, matrix.shape[1]))
    count = min(count, len(unit))
    middle = unit[np.random.default_rng(0).permutation(len(unit))[:count]]
    for _ in range(_ROUNDS):
        nearest = np.concatenate([(part @ middle.T).argmax(axis=1) for part in np.array_split(unit, 1 + len(unit) // 4096)])
        sums = np.zeros_like(middle)
        np.add.at(sums, nearest, unit)
        norms = _norms(sums)
        middle = np.where(norms[:, None] > 0, _unit(sums, norms), middle)
    return middle


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _rows_at_once(width: int | None) -> int:
    """Rows of a batch that are turned into doubles at once: batches follow rows, and vectors may be wide."""
    return max(1, _SCORES // (width or 1))


def with_cluster(chunks: DataFrame, middle: np.ndarray) -> DataFrame:
    """Add ``cluster``, the most similar centre, and ``angle``, the angle to it in radians."""
    shared = chunks.sparkSession.sparkContext.broadcast(middle)
    place = chunks.columns.index("embedding")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        width = middle.shape[1] or None
        step = _rows_at_once(width)
        for batch in batches:
            cluster, angle = np.full(batch.num_rows, _NO_DIRECTION), np.zeros(batch.num_rows)
            for start in range(0, batch.num_rows, step):
                matrix = _matrix(batch.column(place).slice(start, step), width)
                norms = _norms(matrix)
                directed = np.flatnonzero(norms > 0)
                for rows in np.array_split(directed, 1 + len(directed) * len(middle) // _ANGLES):
                    if len(rows):
                        cosines = _unit(matrix[rows], norms[rows]) @ middle.T
                        cluster[start + rows] = cosines.argmax(axis=1)
                        angle[start + rows] = _angles(cosines.max(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cluster, pa.int32()), pa.array(angle, pa.float64())],
                names=[*batch.schema.names, "cluster", "angle"],
            )

    schema = T.StructType([*chunks.schema.fields]).add("cluster", T.IntegerType()).add("angle", T.DoubleType())
    return chunks.mapInArrow(near, schema)


def write_clustered(chunks: DataFrame, path: str, count: int | None = None, sample: int = SAMPLE) -> None:
    """Write chunks (``id``, ``embedding`` and any other columns) as a clustered table.

    ``count`` clusters, by default about the square root of the chunks, at most 1,024.  Each
    cluster is a folder of files in order of the angle; a cluster with far more rows than the others is
    written by several tasks.  Vectors of other lengths, or with numbers that are not finite, fail the write.

    The chunks move once, here.  Sizes, angles and centres of the clusters go beside the table, last, and
    are emptied first: a table without them is unfinished and has no matches.
    """
    spark = chunks.sparkSession
    staged = stage(chunks, "chunks-to-cluster")
    if count is None:
        count = max(1, min(MOST_CLUSTERS, int(staged.count() ** 0.5)))
    middle = centres(staged, count, sample)
    _write_facts(spark.createDataFrame([], _FACTS), path)
    placed = with_cluster(staged, middle).hint("rebalance", F.col("cluster"))
    placed.sortWithinPartitions("cluster", "angle").write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).partitionBy("cluster").parquet(path)
    sizes = spark.read.schema(_stored(chunks.schema)).parquet(path).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("chunks"), F.min("angle").alias("least"), F.max("angle").alias("most")
    )
    named = [(number, centre.tolist()) for number, centre in enumerate(middle)]
    named.append((_NO_DIRECTION, [0.0] * middle.shape[1]))
    known = spark.createDataFrame(named, "cluster int, centre array<double>")
    _write_facts(sizes.join(F.broadcast(known), "cluster"), path)


_FACTS = "cluster int, chunks long, least double, most double, centre array<double>"


def _facts_path(path: str) -> str:
    return f"{path.rstrip('/')}.clusters"


def _write_facts(facts: DataFrame, path: str) -> None:
    facts.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(_facts_path(path))


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields]).add("angle", T.DoubleType()).add("cluster", T.IntegerType())


def read_clustered(spark: SparkSession, path: str, schema: T.StructType = CHUNKS) -> Clustered:
    """The table that ``write_clustered`` made of chunks with ``schema``."""
    rows = spark.read.schema(_stored(schema)).parquet(path)
    return Clustered(rows, spark.read.schema(_FACTS).parquet(_facts_path(path)))


class _Clusters(NamedTuple):
    """Facts of the clusters, which are at most a few thousand, at the driver and in the tasks."""

    number: np.ndarray
    chunks: np.ndarray
    least: np.ndarray
    most: np.ndarray
    centre: np.ndarray

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """The best score any chunk of each cluster can have with each query."""
        away = _angles(unit @ self.centre.T)
        return _best_score(away, self.least, self.most, self.number != _NO_DIRECTION, (unit != 0).any(axis=1)[:, None])


def _best_score(away, least, most, directed, asked):
    """Best score at angles from ``least`` to ``most`` around a centre that is ``away`` from the query."""
    apart = np.maximum(0.0, np.maximum(away - most, least - away))
    return np.where(directed & asked, np.cos(np.maximum(0.0, apart - _PRECISION)), 0.0) + _MARGIN


def search(
    queries: DataFrame,
    clustered: Clustered,
    limit: int = fixed.EVIDENCE_LIMIT,
    block_bytes: int = BLOCK_BYTES,
    read: Accumulator | None = None,
    multiplied: Accumulator | None = None,
) -> DataFrame:
    """The ``limit`` most similar chunks of every query: ``(query_id, rank, id, score)``.

    The same rows as ``retrieval.search`` over the same chunks.  Chunk vectors stay in their files; query
    vectors go to the tasks in blocks, and a block's results are staged.  A block is bounded with the matches that
    a task holds for it.  ``read`` counts chunk vectors that tasks take from the table, ``multiplied`` the products
    of a chunk and a query vector; retried tasks count again.
    """
    spark = clustered.rows.sparkSession
    facts = clustered.facts.sort("cluster").toArrow()
    if not len(facts):
        return spark.createDataFrame([], _RANKED)
    clusters = _Clusters(
        *(facts[name].to_numpy() for name in ("cluster", "chunks", "least", "most")),
        _matrix(facts["centre"], None),
    )
    staged = stage(queries.select("query_id", "embedding"), "query-vectors")
    count, size = _doubles(staged)
    held = size + 16 * count * min(limit, int(clusters.chunks.sum()))
    blocks = max(block_count(staged, block_bytes), -(-held // SET_BYTES))
    found = []
    for ids, vectors in query_blocks(staged, blocks):
        if vectors.shape[1] != clusters.centre.shape[1]:
            raise ValueError("vectors must have the same length, at least 1")
        counts = (read, multiplied)
        first = _nearest(clusters, vectors, limit)
        near = stage(_scored(clustered, clusters, ids, vectors, limit, first, None, counts), "nearest")
        floor = _floors(near, ids, limit)
        rest = _scored(clustered, clusters, ids, vectors, limit, first, floor, counts)
        found.append(stage(best_of(near.unionByName(rest), limit), "clustered-matches"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _RANKED)


def _nearest(clusters: _Clusters, vectors: np.ndarray, limit: int) -> list[np.ndarray]:
    """For every cluster the places of the queries whose first pass reads it.

    A query takes the clusters with the best bounds until they hold ``limit`` chunks.
    """
    unit = _unit(vectors, _norms(vectors))
    queries, taken = [], []
    for part in np.array_split(np.arange(len(unit)), 1 + len(unit) * len(clusters.number) // _ANGLES):
        order = np.argsort(-clusters.bounds(unit[part]), axis=1, kind="stable")
        held = np.cumsum(clusters.chunks[order], axis=1) - clusters.chunks[order]
        row, place = np.nonzero(held < limit)
        queries.append(part[row])
        taken.append(order[row, place])
    query, cluster = np.concatenate(queries), np.concatenate(taken)
    order = np.argsort(cluster, kind="stable")
    return np.split(query[order], np.searchsorted(cluster[order], np.arange(1, len(clusters.number))))


def _floors(nearest: DataFrame, ids: np.ndarray, limit: int) -> np.ndarray:
    """The score of each query's last chunk so far; none for a query that has fewer than ``limit``."""
    last = best_of(nearest, limit).where(F.col("rank") == limit).select("query_id", "score").toArrow()
    floor = np.full(len(ids), -np.inf)
    order = np.argsort(ids)
    floor[order[np.searchsorted(ids, last["query_id"].to_numpy(), sorter=order)]] = last["score"].to_numpy()
    return floor


def _scored(
    clustered: Clustered,
    clusters: _Clusters,
    ids: np.ndarray,
    vectors: np.ndarray,
    limit: int,
    nearest: list[np.ndarray],
    floor: np.ndarray | None,
    counts: tuple[Accumulator | None, Accumulator | None],
) -> DataFrame:
    """Candidates of the first pass, or with ``floor`` of the second one, which leaves out the first one's clusters."""
    spark = clustered.rows.sparkSession
    unit = _unit(vectors, _norms(vectors))
    if floor is None:
        needed = np.array([len(queries) > 0 for queries in nearest])
    else:
        needed = np.zeros(len(clusters.number), dtype=bool)
        for part in np.array_split(np.arange(len(unit)), 1 + len(unit) * len(clusters.number) // _ANGLES):
            needed |= (clusters.bounds(unit[part]) >= floor[part, None]).any(axis=0)
    chosen = [int(number) for number in clusters.number[needed]]
    if not chosen:
        return spark.createDataFrame([], _SCORED)
    shared = spark.sparkContext.broadcast((clusters, ids, vectors, nearest, floor))
    read, multiplied = counts

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clusters, ids, vectors, nearest, floor = shared.value
        width = vectors.shape[1]
        best = _Best(vectors, limit, floor)
        everyone = np.arange(len(ids))
        directed = best.norms > 0
        lengths = np.where(directed, best.norms, 1.0)
        step = _rows_at_once(width)
        parts = (batch.slice(start, step) for batch in batches for start in range(0, batch.num_rows, step))
        for part in parts:
            numbers, angles, chunk_ids = (part.column(k).to_numpy() for k in range(3))
            matrix = _matrix(part.column(3), width)
            if read is not None:
                read.add(len(matrix))
            for number in np.unique(numbers):
                rows = np.flatnonzero(numbers == number)
                place = int(np.searchsorted(clusters.number, number))
                asked = nearest[place]
                if floor is not None:
                    away = _angles(vectors @ clusters.centre[place] / lengths)
                    bound = _best_score(away, angles[rows].min(), angles[rows].max(), number != _NO_DIRECTION, directed)
                    asked = np.setdiff1d(everyone[bound >= best.floor], asked, assume_unique=True)
                if len(asked):
                    best.add(chunk_ids[rows], matrix[rows], asked)
                    if multiplied is not None:
                        multiplied.add(len(rows) * len(asked))
        yield best.rows(ids)

    rows = clustered.rows.where(F.col("cluster").isin(chosen))
    return rows.select("cluster", "angle", "id", "embedding").mapInArrow(find, _SCORED)
