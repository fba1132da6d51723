import io
import random

from cinderlog.operators import events, metrics
from cinderlog.sources import growing_logs, logs


def line(draw, n):
    return draw.choice(
        (f"2026-01-01 10:{n % 60:02d}:00 {draw.choice(('INFO', 'ERROR', 'FATAL'))} svc{draw.randrange(3)} - message é {n}", "junk", "", "   ")
    )


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def equal_to_a_full_run(spark, folder, state):
    """Against reading and counting the whole files."""
    parsed = events.parse_lines(logs.read_log_files(spark, folder))
    found = events.events_of(parsed)
    names = state.ledger.columns[:1]
    assert rows(state.metrics()) == rows(metrics.incident_metrics(found, state.ledger.select(*names)))
    assert rows(state.impact()) == rows(metrics.impact_scores(found, state.ledger.select(*names)))
    assert rows(state.level_counts().select("incident_id", "level", "events", "severity")) == rows(metrics.level_counts(found))
    assert rows(state.service_counts()) == rows(metrics.service_counts(found))
    assert rows(state.rejected) == rows(events.rejected_counts(parsed))


def test_only_new_bytes_are_read(spark, tmp_path):
    draw = random.Random(7)
    folder, kept = tmp_path / "logs", str(tmp_path / "state")
    folder.mkdir()
    texts = {name: [line(draw, n) for n in range(200)] for name in ("a.log", "b.log")}
    for name, lines in texts.items():
        (folder / name).write_text("\n".join(lines) + "\n")
    first = growing_logs.update(spark, str(folder), kept, block_bytes=700)
    assert first.count() == sum(bool(text.strip()) for lines in texts.values() for text in lines)
    equal_to_a_full_run(spark, str(folder), growing_logs.read_state(spark, kept))
    assert growing_logs.update(spark, str(folder), kept).count() == 0
    # Appended lines, one of them not finished, and a new file; only these are read.
    more = [line(draw, n) for n in range(30)]
    with open(folder / "a.log", "a") as file:
        file.write("\n".join(more) + "\nunfinis")
    (folder / "c.log").write_bytes(b"\xef\xbb\xbf2026-01-01 10:00:00 ERROR s - one\r\n2026-01-01 10:00:01 INFO s - two\r\n")
    second = growing_logs.update(spark, str(folder), kept, block_bytes=64)
    texts["a.log"] += more
    got = {(r.source_name, r.line_number): r.raw_line for r in second.collect()}
    want = {("a.log", 201 + n): text for n, text in enumerate(more) if text.strip()}
    want |= {("c.log", 1): "2026-01-01 10:00:00 ERROR s - one", ("c.log", 2): "2026-01-01 10:00:01 INFO s - two"}
    assert got == want
    with open(folder / "a.log", "a") as file:
        file.write("hed\n")
    assert [(r.line_number, r.raw_line) for r in growing_logs.update(spark, str(folder), kept).collect()] == [(231, "unfinished")]
    equal_to_a_full_run(spark, str(folder), growing_logs.read_state(spark, kept))
    # A shorter file is another one; a file that is gone keeps its sums.
    (folder / "b.log").write_text("2026-01-01 10:00:00 ERROR s - only\n")
    assert growing_logs.update(spark, str(folder), kept).count() == 1
    equal_to_a_full_run(spark, str(folder), growing_logs.read_state(spark, kept))
    (folder / "c.log").unlink()
    growing_logs.update(spark, str(folder), kept)
    names = {r.source_name: r.lines for r in growing_logs.read_state(spark, kept).ledger.collect()}
    assert names == {"a.log": 231, "b.log": 1, "c.log": 2}


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    folder, kept = tmp_path / "logs", str(tmp_path / "state")
    folder.mkdir()
    (folder / "a.log").write_text("2026-01-01 10:00:00 ERROR s - one\n")
    growing_logs.update(spark, str(folder), kept)
    before = rows(growing_logs.read_state(spark, kept).metrics())
    with open(folder / "a.log", "a") as file:
        file.write("2026-01-01 10:00:01 ERROR s - two\n")
    whole = growing_logs.metrics.merged_totals
    monkeypatch.setattr(growing_logs.metrics, "merged_totals", lambda totals: whole(totals).select("no_such_column"))
    try:
        growing_logs.update(spark, str(folder), kept)
        raise AssertionError("the run should have failed")
    except growing_logs.AnalysisException:
        pass
    monkeypatch.undo()
    assert rows(growing_logs.read_state(spark, kept).metrics()) == before
    assert growing_logs.update(spark, str(folder), kept).count() == 1
    equal_to_a_full_run(spark, str(folder), growing_logs.read_state(spark, kept))


def test_lines_of_any_range():
    draw = random.Random(5)
    for _ in range(300):
        body = bytes(draw.choices(b"ab\n", k=draw.randint(0, 40)))
        first = draw.choice([0] + [n + 1 for n, byte in enumerate(body) if byte == 10])
        want, at = [], first
        for text in body[first:].split(b"\n")[:-1]:
            want.append((at, text))
            at += len(text) + 1
        step = draw.randint(1, 9)
        got = []
        for begin in range(first, len(body), step):
            got += growing_logs.lines_between(io.BytesIO(body), first, begin, min(begin + step, len(body)), len(body))
        assert got == want
