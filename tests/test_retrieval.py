import math
import random

import pytest
from pyspark.sql import functions as F

from cinderlog.functions.vectors import cosine, from_json_text, to_json_text
from cinderlog.operators import embedding, evaluation, retrieval

CHUNK = "id long, source string, heading string, content string, embedding array<float>"


@pytest.fixture
def two(frame):
    return frame(CHUNK, (1, "db.md", "Pool", "a", [1.0, 0.0]), (2, "cpu.md", "CPU", "b", [0.0, 1.0]))


def brute_force(queries, chunks, limit):
    def similarity(left, right):
        lengths = math.sqrt(sum(x * x for x in left)) * math.sqrt(sum(x * x for x in right))
        return 0.0 if lengths == 0 else sum(x * y for x, y in zip(left, right)) / lengths

    result = {}
    for query, vector in queries:
        scored = sorted((-similarity(vector, other), key) for key, other in chunks)
        result[query] = [key for _, key in scored[:limit]]
    return result


def found(rows):
    result = {}
    for row in sorted(rows.collect(), key=lambda row: (row.query_id, row["rank"])):
        result.setdefault(row.query_id, []).append(row.id)
    return result


def test_top_match(frame, two):
    queries = frame("query_id long, embedding array<float>", (7, [0.9, 0.1]))
    row = retrieval.with_chunks(retrieval.search(queries, two, 1), two).first()
    assert (row.source, row["rank"]) == ("db.md", 1)
    assert row.score == pytest.approx(0.993884, abs=1e-6)


@pytest.mark.parametrize("block_bytes", [retrieval.BLOCK_BYTES, 700])
def test_search_equals_brute_force(frame, block_bytes):
    """Also with a third of the chunks being copies of one vector, and with a zero vector.

    Whole numbers keep all sums exact, so the scores agree to the last bit.
    """
    draw = random.Random(5)
    grid = lambda: [float(draw.randint(-2, 2)) for _ in range(6)]
    copy = grid()
    chunks = [(n, copy if n % 3 == 0 else grid()) for n in range(1, 241)] + [(500, [0.0] * 6)]
    queries = [(n, grid()) for n in range(40)] + [(99, [0.0] * 6)]
    chunk_rows = frame("id long, embedding array<float>", *chunks).repartition(5)
    query_rows = frame("query_id long, embedding array<double>", *queries)
    result = retrieval.search(query_rows, chunk_rows, 4, block_bytes)
    assert found(result) == brute_force(queries, chunks, 4)


def test_search_of_nothing(frame, two):
    none = frame("query_id long, embedding array<float>", (1, [1.0, 0.0])).filter("false")
    assert retrieval.search(none, two).count() == 0
    one = frame("query_id long, embedding array<float>", (1, [1.0, 0.0]))
    assert retrieval.search(one, two.filter("false")).count() == 0


def test_unequal_lengths_are_an_error(frame, two):
    queries = frame("query_id long, embedding array<float>", (1, [1.0, 0.0, 0.0]))
    with pytest.raises(Exception, match="same length"):
        retrieval.search(queries, two).collect()


def test_cosine_column(frame):
    rows = frame("a array<double>, b array<double>", ([1.0, 0.0], [0.9, 0.1]), ([0.0], [1.0]))
    assert [round(r[0], 6) for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [
        0.993884, 0.0,
    ]
    with pytest.raises(Exception, match="same length"):
        frame("a array<double>, b array<double>", ([1.0], [1.0, 2.0])).select(
            cosine(F.col("a"), F.col("b"))
        ).collect()


def test_vectors_as_json_text(frame):
    row = frame("t string", ("[1.5, 2]",)).select(from_json_text(F.col("t")).alias("v"))
    assert list(row.first().v) == [1.5, 2.0]
    assert row.select(to_json_text(F.col("v"))).first()[0] == "[1.5,2.0]"


def test_gate_and_status(frame, two):
    questions = frame(
        "question_id long, question string, embedding array<float>, aligned boolean,"
        " question_domain string, incident_domain string",
        (1, "good?", [0.9, 0.1], True, None, None),
        (2, "bad?", [-1.0, -1.0], True, None, None),
        (3, " \n", [1.0, 0.0], True, None, None),
        (4, "other?", [1.0, 0.0], False, "CPU", "database"),
    )
    evidence = retrieval.retrieve(questions, two)
    assert {row.question_id for row in evidence.collect()} == {1, 2, 4}
    gated = retrieval.relevance_gate(questions, evidence, 0.7)
    rows = {r.question_id: r for r in retrieval.answer_status(gated, two).collect()}
    assert [rows[n].status for n in (1, 2, 3, 4)] == ["answer", "rejected", "rejected", "mismatch"]
    assert rows[3].best_score == 0.0
    assert "**CPU**" in rows[4].reply and "**database**" in rows[4].reply
    assert rows[1].reply is None
    empty = retrieval.answer_status(gated, two.filter("false")).collect()
    assert {r.question_id: r.status for r in empty} == {
        1: "empty", 2: "empty", 3: "empty", 4: "mismatch",
    }


CASE = (
    "case_id long, name string, expected_source string, answerable boolean,"
    " embedding array<float>, latency_seconds double"
)


def test_evaluation(frame, two):
    cases = frame(
        CASE,
        (1, "hit", "db.md", True, [0.9, 0.1], 0.25),
        (2, "miss", "db.md", True, [0.1, 0.9], 0.75),
        (3, "no", "REJECT", False, [-1.0, -0.5], 0.5),
    )
    results = evaluation.evaluate_retrieval(cases, two, 0.5)
    rows = {row.case_id: row for row in results.collect()}
    assert [rows[n].passed for n in (1, 2, 3)] == [True, False, True]
    assert rows[3].retrieved_source == "REJECT"
    summary = evaluation.evaluation_summary(results).first()
    assert (summary.passed, summary.cases, summary.mean_latency_seconds) == (2, 3, 0.5)
    assert summary.accuracy_percent == pytest.approx(66.6667, abs=1e-3)
    shown = {row.Case: row for row in evaluation.evaluation_table(results).collect()}
    assert (shown["hit"].Result, shown["no"]["Expected behavior"]) == ("PASS", "Reject")
    nothing = evaluation.evaluate_retrieval(cases, two.filter("false"), 0.5).collect()
    assert {(r.retrieved_source, r.retrieved_heading, r.score) for r in nothing} == {
        ("No result", "-", 0.0)
    }
    assert {r.case_id: r.passed for r in nothing} == {1: False, 2: False, 3: True}


def test_available_cases(spark, frame, two):
    assert evaluation.available_cases(spark, two).count() == 5
    queue = frame(CHUNK, (3, "custom/message_queue_runbook.txt", "H", "c", [0.0, 1.0]),
                  (4, "custom/message_queue_runbook.txt", "I", "c", [0.0, 1.0]))
    assert evaluation.available_cases(spark, two.unionByName(queue)).count() == 6


@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
@pytest.mark.parametrize("block_bytes", [retrieval.BLOCK_BYTES, 8])
def test_numbers_that_are_not_finite_fail_the_search(frame, two, bad, block_bytes):
    queries = frame("query_id long, embedding array<float>", (7, [0.9, 0.1]), (8, [0.1, 0.2]))
    broken = two.unionByName(frame(CHUNK, (3, "x.md", "X", "c", [bad, 1.0])))
    with pytest.raises(Exception, match="NaN or infinite"):
        retrieval.search(queries, broken, 1, block_bytes).collect()
    worse = frame("query_id long, embedding array<float>", (7, [bad, 0.1]), (8, [0.1, 0.2]))
    with pytest.raises(Exception, match="NaN or infinite"):
        retrieval.search(worse, two, 1, block_bytes).collect()


def test_query_texts_are_embedded_once(spark, frame, two):
    calls = spark.sparkContext.accumulator(0)

    def embed(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    texts = frame("query_id long, text string", *((n, "q" * n) for n in range(1, 11)))
    queries = embedding.from_function(embed)(texts)
    assert retrieval.search(queries, two, 1).count() == 10
    assert calls.value == 10


def test_tasks_of_a_search_hold_one_ranking(spark, frame):
    """Sets of queries are not ranked side by side in one task, and their number stays bounded."""
    queries = frame("query_id long, embedding array<float>", *((n, [1.0, float(n)]) for n in range(400)))
    chunks = frame("id long, embedding array<float>", *((n, [float(n), 1.0]) for n in range(50)))
    result = retrieval.search(queries, chunks, 2, block_bytes=16)
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1
    assert plan.count("MapInArrow") <= retrieval._SETS
    assert found(result) == found(retrieval.search(queries, chunks, 2))


def test_chunks_of_one_piece_are_dealt_out(spark, frame, monkeypatch):
    monkeypatch.setattr(retrieval, "_TASK_PRODUCTS", 100)
    draw = random.Random(6)
    chunks = [(n, [float(draw.randint(-3, 3)) for _ in range(4)]) for n in range(100)]
    queries = [(n, [float(draw.randint(-3, 3)) for _ in range(4)]) for n in range(30)]
    asked = frame("query_id long, embedding array<double>", *queries)
    result = retrieval.search(asked, frame("id long, embedding array<float>", *chunks).coalesce(1), 3)
    assert len(result.inputFiles()) == 2 * spark.sparkContext.defaultParallelism
    assert found(result) == brute_force(queries, chunks, 3)


@pytest.mark.parametrize("width", [3, 700])
def test_scores_closer_than_single_precision_rank_exactly(frame, width):
    """Chunks whose scores differ by less than what a product of single precision tells apart."""
    base = [1.0] * width
    chunks = [(n, [1.0 + n * 1e-4 * (k == 0) for k in range(width)]) for n in range(60, 0, -1)]
    rows = frame("id long, embedding array<double>", *chunks)
    asked = frame("query_id long, embedding array<double>", (1, base))
    assert found(retrieval.search(asked, rows, 3)) == brute_force([(1, base)], chunks, 3)
