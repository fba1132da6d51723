import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cinderlog.operators import clusters, retrieval
from cinderlog.schemas import CHUNKS

CHUNK = "id long, source string, heading string, content string, embedding array<float>"


def rows_of(frame, vectors):
    return frame(CHUNK, *((n, f"s{n % 7}", f"h{n}", "text", vector) for n, vector in vectors))


def ranked(found):
    return {tuple(row) for row in found.collect()}


def vector_near(draw, centre, spread):
    return [x + draw.gauss(0, spread) for x in centre]


def test_same_rows_from_few_vectors(spark, frame, tmp_path):
    """Forty separate directions: a search takes a small part of the vectors from the table."""
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    vectors = [(n, vector_near(draw, centres[n % 40], 0.05)) for n in range(4000)]
    chunks = rows_of(frame, vectors)
    queries = frame("query_id long, embedding array<float>", *((n, vector_near(draw, centres[n], 0.05)) for n in range(6)))
    path = str(tmp_path / "table")
    clusters.write_clustered(chunks, path)
    table = clusters.read_clustered(spark, path)
    assert table.rows.count() == 4000
    read, multiplied = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    found = clusters.search(queries, table, 5, read=read, multiplied=multiplied)
    assert ranked(found) == ranked(retrieval.search(queries, chunks, 5))
    assert read.value < 4000 * 0.35
    assert multiplied.value < 6 * 4000 * 0.1


@pytest.mark.parametrize("block_bytes", [retrieval.BLOCK_BYTES, 700])
@pytest.mark.parametrize("count", [1, 9, None])
def test_any_vectors(spark, frame, tmp_path, count, block_bytes):
    """Copies, vectors without direction, queries without direction, opposite vectors, more asked than there is."""
    draw = random.Random(8)
    grid = lambda: [float(draw.randint(-2, 2)) for _ in range(6)]
    copy = grid()
    vectors = [(n, copy if n % 3 == 0 else grid()) for n in range(1, 241)] + [(500 + n, [0.0] * 6) for n in range(3)]
    vectors += [(600, [-x for x in copy])]
    chunks = rows_of(frame, vectors)
    queries = frame("query_id long, embedding array<double>", *((n, grid()) for n in range(20)), (99, [0.0] * 6), (100, copy))
    path = str(tmp_path / "table")
    clusters.write_clustered(chunks, path, count)
    table = clusters.read_clustered(spark, path)
    for limit in (4, 1000):
        assert ranked(clusters.search(queries, table, limit, block_bytes)) == ranked(retrieval.search(queries, chunks, limit))
    matched = retrieval.with_chunks(clusters.search(queries, table, 1), table.rows).collect()
    assert all(row.heading == f"h{row.id}" for row in matched) and len(matched) == 22


def test_sample_changes_nothing(spark, frame, tmp_path):
    draw = random.Random(4)
    vectors = [(n, [draw.gauss(0, 1) for _ in range(8)]) for n in range(500)]
    chunks = rows_of(frame, vectors)
    queries = frame("query_id long, embedding array<float>", *((n, v) for n, v in vectors[:20]))
    clusters.write_clustered(chunks, str(tmp_path / "t"), 12, sample=50)
    found = clusters.search(queries, clusters.read_clustered(spark, str(tmp_path / "t")), 3)
    assert ranked(found) == ranked(retrieval.search(queries, chunks, 3))


def test_empty_tables_and_bad_vectors(spark, frame, tmp_path):
    path = str(tmp_path / "t")
    one = frame("query_id long, embedding array<float>", (1, [1.0, 0.0]))
    chunks = rows_of(frame, [(1, [1.0, 0.0]), (2, [0.0, 2.0])])
    clusters.write_clustered(chunks.where("false"), path)
    assert clusters.search(one, clusters.read_clustered(spark, path)).count() == 0
    clusters.write_clustered(chunks, path)
    assert clusters.search(one.where("false"), clusters.read_clustered(spark, path)).count() == 0
    with pytest.raises(Exception, match="same length"):
        clusters.search(one.withColumn("embedding", F.array(F.lit(1.0))), clusters.read_clustered(spark, path)).collect()
    with pytest.raises(Exception, match="NaN"):
        clusters.write_clustered(rows_of(frame, [(1, [1.0, float("nan")])]), path)


def test_no_vector_is_shuffled_by_a_search(spark, frame):
    chunks = rows_of(frame, [(n, [float(n), 1.0]) for n in range(50)])
    queries = frame("query_id long, embedding array<float>", *((n, [1.0, float(n)]) for n in range(50)))
    found = retrieval.search(queries, chunks, 2, block_bytes=200)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") > 2
    for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
        assert "Exchange" not in line or "embedding" not in line
    assert CHUNKS.fieldNames()[-1] == "embedding"
    assert np.isfinite([row.score for row in found.collect()]).all()


def test_a_block_of_queries_takes_bounded_memory():
    """A task holds its queries and their matches a few times at most, and no score matrix of all of them."""
    draw = np.random.default_rng(1)
    queries = draw.normal(size=(clusters.BLOCK_BYTES // (8 * 64), 64))
    tracemalloc.start()
    try:
        best = retrieval._Best(queries, 5)
        for start in (0, 200):
            best.add(np.arange(start, start + 200), draw.normal(size=(200, 64)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert best.rows(np.arange(len(queries))).num_rows == 5 * len(queries)
    assert peak < 100_000_000


def test_a_batch_of_wide_vectors_takes_bounded_memory():
    """A batch follows rows; of wide vectors only a part is turned into doubles at once."""
    draw = np.random.default_rng(2)
    rows, width = 5000, 1024
    chunks = draw.normal(size=(rows, width)).astype(np.float32)
    embedding = pa.FixedSizeListArray.from_arrays(pa.array(chunks.ravel()), width).cast(pa.list_(pa.float32()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(rows)), embedding], names=["id", "embedding"])
    context = SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value))
    table = SimpleNamespace(
        columns=["id", "embedding"],
        schema=CHUNKS,
        sparkSession=SimpleNamespace(sparkContext=context),
        mapInArrow=lambda function, schema: function,
    )
    middle = chunks[:100] / np.linalg.norm(chunks[:100], axis=1)[:, None].astype(np.float64)
    near = clusters.with_cluster(table, middle)
    tracemalloc.start()
    try:
        placed = next(near(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert placed.column("cluster")[:100].to_pylist() == list(range(100))
    assert np.allclose(np.cos(placed.column("angle").to_numpy()[100:]), (chunks[100:] @ middle.T / np.linalg.norm(chunks[100:], axis=1)[:, None]).max(axis=1))
    assert peak < 40_000_000


def test_blocks_are_bounded_with_their_matches(spark, frame, tmp_path, monkeypatch):
    """Many matches for each query: a block holds fewer queries."""
    draw = random.Random(6)
    chunks = rows_of(frame, [(n, [draw.gauss(0, 1) for _ in range(4)]) for n in range(300)])
    queries = frame("query_id long, embedding array<float>", *((n, [draw.gauss(0, 1) for _ in range(4)]) for n in range(40)))
    path = str(tmp_path / "t")
    clusters.write_clustered(chunks, path)
    blocks, made = [], clusters.query_blocks
    monkeypatch.setattr(clusters, "SET_BYTES", 60_000, raising=False)
    monkeypatch.setattr(clusters, "query_blocks", lambda *given: blocks.append(given[1]) or made(*given))
    found = clusters.search(queries, clusters.read_clustered(spark, path), 250)
    assert ranked(found) == ranked(retrieval.search(queries, chunks, 250))
    assert blocks == [3]
