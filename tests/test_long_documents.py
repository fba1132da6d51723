import random

import numpy as np
import pytest

from cinderlog.operators import chunks, long_documents
from cinderlog.operators.long_documents import Packing
from cinderlog.sources import documents

PIECES = ["# A\n", "## A\n", "#\n", "#B\n", "one", "two words", "x" * 9, "\n", "\n\n", " ", "é" * 7, "\n# A\nq", "\t\n", "word\n", " ", "x" * 50, "\r\n", " "]


def texts(seed, count, pieces):
    draw = random.Random(seed)
    return [(f"{n:03d}", "".join(draw.choices(PIECES, k=draw.randint(0, pieces)))) for n in range(count)]


def ordered(frame):
    return sorted(tuple(row) for row in frame.collect())


@pytest.mark.parametrize("size", [7, 20, 1400])
def test_same_chunks_as_within_rows(spark, frame, size):
    rows = frame("source string, text string", *texts(size, 60, 60), ("none", None), ("big", "\n\n".join("w" * (k % 23) for k in range(3000))))
    lines = long_documents.document_lines(rows)
    assert ordered(long_documents.chunk_lines(lines, size)) == ordered(chunks.chunk_documents(rows, size))


def test_one_document_over_all_ranges(spark, frame):
    """One section, and one paragraph, that fill whole ranges; nothing else is near."""
    draw = random.Random(1)
    packed = "\n\n".join("p" * draw.randint(1, 30) for _ in range(4000))
    single = "\n".join("q" * draw.randint(1, 90) + " " * draw.randint(0, 2) for _ in range(2000))
    rows = frame("source string, text string", ("a", f" \n\n# One\n{packed}\n# Two\n \n{single} \n\n tail"))
    lines = long_documents.document_lines(rows).repartition(7)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ordered(long_documents.chunk_lines(lines, 100))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert got == ordered(chunks.chunk_documents(rows, 100))


def test_runbook_files_by_lines(spark, tmp_path):
    parts = ["# A\n", "one\r\n", "two\x0bthree\n", "\n", "# B\x85", "é \u2028\n", "\r", "x" * 30, " \x1c\n"]
    draw = random.Random(9)
    for number in range(5):
        text = "".join(draw.choices(parts, k=draw.randint(0, 400)))
        (tmp_path / f"{number}.md").write_bytes(text.encode())
    (tmp_path / "other.txt").write_bytes(b"# no runbook")
    whole = chunks.chunk_documents(documents.read_runbooks(spark, str(tmp_path)), 40)
    lines = documents.read_runbook_lines(spark, str(tmp_path))
    assert ordered(long_documents.chunk_lines(lines, 40, ("line_number", "place"))) == ordered(whole)


def test_nothing(frame):
    none = frame("source string, line_number long, line string", ("a", 1, None), ("a", 2, " "), ("b", 1, "# only a heading"))
    assert long_documents.chunk_lines(none).count() == 0
    assert long_documents.chunk_lines(none.where("false")).count() == 0


def plain_packing(size, section, most, state):
    """Paragraph by paragraph: what opens a chunk, and the length left open."""
    opens = []
    for k, length in enumerate(size):
        if k and section[k] != section[k - 1]:
            state = 0
        if length > most:
            opens.append(True)
            state = 0
        elif state and state + 2 + length <= most:
            opens.append(False)
            state += 2 + length
        else:
            opens.append(True)
            state = length
    return opens, state


def test_states_of_a_range():
    draw = np.random.default_rng(4)
    for _ in range(200):
        count, most = int(draw.integers(1, 40)), int(draw.integers(3, 30))
        size = draw.integers(1, most + (2 if draw.random() < 0.3 else 0), count)
        section = np.cumsum(draw.random(count) < draw.choice([0, 0.1, 0.5]))
        packing = Packing(size, section, most)
        states = packing.end_states()
        for state in range(most + 1):
            opens, end = plain_packing(size, section, most, state)
            assert packing.opens(state).tolist() == opens
            assert states[state if len(states) > 1 else 0] == end
