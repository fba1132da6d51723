import random

import pytest
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import decode_utf8
from cinderlog.plans.analysis import overview
from cinderlog.sources import logs, staging


def test_line_numbers_of_split_files(spark, tmp_path):
    texts = {}
    for name, ending in (("a.log", "\n"), ("b.log", "\r\n"), ("c.log", "\r")):
        texts[name] = [("" if n % 7 == 3 else f"line {n} é " + "x" * (n % 40)) for n in range(300)]
        body = ending.join(texts[name]) + ending
        (tmp_path / name).write_bytes(b"\xef\xbb\xbf" * (name == "a.log") + body.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        rows = logs.read_log_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, lines in texts.items():
        found = {row.line_number: row.raw_line for row in rows if row.source_name == name}
        assert [found[number] for number in sorted(found)] == lines
        assert sorted(found) == list(range(1, len(lines) + 1))


def test_numbers_stay_when_later_jobs_split_otherwise(spark, tmp_path):
    lines = [f"line {n}" for n in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    settings = {
        "spark.sql.files.maxPartitionBytes": ("3000b", "128m"),
        "spark.sql.leafNodeDefaultParallelism": ("8", "3"),
        "spark.sql.files.openCostInBytes": ("10", "4m"),
    }
    try:
        for name, (first, _) in settings.items():
            spark.conf.set(name, first)
        found = logs.read_log_files(spark, str(tmp_path))
        for name, (_, later) in settings.items():
            spark.conf.set(name, later)
        rows = {row.line_number: row.raw_line for row in found.collect()}
        assert found.count() == 4000
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert rows == {number: text for number, text in enumerate(lines, start=1)}


@pytest.mark.parametrize("block", ["7b", "128m"])
def test_uploads_split_at_every_boundary(spark, tmp_path, monkeypatch, block):
    """Blocks of 7 bytes cut characters and pairs of carriage return and line feed."""

    def stage_and_reset(frame, name):
        # Small blocks are for the files alone, not for the staged tables.
        staged = staging.stage(frame, name)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        return staged

    monkeypatch.setattr(logs, "stage", stage_and_reset)
    draw = random.Random(12)
    parts = [b"\n", b"\r\n", b"\r", "\u2028".encode(), "\x85".encode(), b"\x0b", b"\x1d", b"a", "é日\U0001f600".encode(), b"\xe2\x82", b"\xff", b"word", b"\n\n", b" "]
    bodies = {"empty": b"", "mark": b"\xef\xbb\xbf", "marks": b"\xef\xbb\xbf\xef\xbb\xbfa\r\n", "feed": b"\n", "return": b"\r", "both": b"\r\n"}
    for k in range(12):
        bodies[f"r{k}"] = b"\xef\xbb\xbf" * (k % 3 == 0) + b"".join(draw.choices(parts, k=draw.randint(1, 30)))
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    settings = {"spark.sql.files.maxPartitionBytes": block, "spark.sql.files.openCostInBytes": "1"}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = logs.read_uploaded_logs(spark, str(tmp_path)).collect()
    finally:
        for name in settings:
            spark.conf.unset(name)
    whole = spark.read.format("binaryFile").load(str(tmp_path)).select(
        F.element_at(F.split("path", "/"), -1).alias("name"),
        F.split(decode_utf8(F.col("content")), fixed.LINE_BOUNDARY, -1).alias("lines"),
    )
    for name, lines in whole.collect():
        found = sorted((r.line_number, r.raw_line) for r in rows if r.source_name == name)
        assert found == list(enumerate(lines, start=1)), name


def test_staged_tables_go_with_their_block(spark, tmp_path):
    from pathlib import Path

    rows = spark.range(5).withColumn("t", F.lit("x"))
    held = lambda: {p.parent.name.rsplit("-", 1)[0] for p in Path(staging.staging_root(spark)).rglob("_SUCCESS")}
    with staging.scratch(spark, "outer"):
        with staging.scratch(spark, "inner"):
            staging.stage(rows, "gone")
            kept = staging.stage(rows, "kept-inside", lasting=True)
        assert "gone" not in held() and "kept-inside" in held()
        last = staging.stage(kept.where("id > 2"), "kept-outside", lasting=True)
    assert "kept-inside" not in held() and last.count() == 2
    try:
        with staging.scratch(spark, "failing"):
            staging.stage(rows, "evidence-of-failure")
            raise ValueError
    except ValueError:
        pass
    assert "evidence-of-failure" in held()
    # The bytes that were added up while writing are those a job of its own finds.
    assert getattr(staging.stage(rows, "a"), staging._MEASURED) == rows.agg(F.sum(staging._row_bytes(rows))).first()[0]


def test_measured_bytes_follow_what_is_held(spark):
    rows = spark.createDataFrame(
        [("x" * 1000, [1.0] * 500, {"k": "v" * 700}, [{"a": b"z" * 300}])],
        "s string, v array<double>, m map<string,string>, n array<struct<a:binary>>",
    )
    measured = {
        name: next(
            size for size in range(0, 10_000, 8)
            if "ResolvedHint" in staging.broadcast_if_small(rows.select(name), size)
            ._jdf.queryExecution().analyzed().toString()
        )
        for name in rows.columns
    }
    assert measured["s"] >= 1000 and measured["v"] >= 4000
    assert measured["m"] >= 700 and measured["n"] >= 300


def test_bad_bytes_and_uploads(spark, tmp_path):
    path = tmp_path / "u.txt"
    path.write_bytes(b"\xef\xbb\xbfone\xff\x0btwo\r\n\r\nthree\xe2\x80\xa8four\n")
    rows = logs.read_uploaded_logs(spark, str(path)).orderBy("line_number").collect()
    assert [(r.line_number, r.raw_line) for r in rows if r.raw_line] == [
        (1, "one�"), (2, "two"), (4, "three"), (5, "four"),
    ]
    row = logs.read_log_files(spark, str(path)).orderBy("line_number").first()
    assert row.raw_line == "one�\x0btwo"


def test_demo_scenarios(spark, tmp_path):
    (tmp_path / "sample_incident.log").write_text("2026-08-06 14:03:12 ERROR s - m\n")
    (tmp_path / "other.log").write_text("x\n")
    rows = logs.with_scenario(logs.read_log_files(spark, str(tmp_path))).collect()
    assert [r.scenario for r in rows] == ["Database pool exhaustion"]


def test_staging_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert staging.staging_root(spark).startswith(root)
    staged = staging.stage(spark.range(3), "numbers")
    assert staged.count() == 3 and staged.inputFiles()[0].find(root) >= 0


def test_overview(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2026-08-06 14:03:12 ERROR s - from 10.0.0.1\nbroken\n\n2026-08-06 14:03:14 INFO t - x\n"
    )
    shown = overview(logs.read_log_files(spark, str(tmp_path)).drop("source_name"))
    assert shown.metrics.first().events == 2
    assert shown.impact.first().score == 8
    assert shown.rejected.first().line_number == 2
    assert shown.redactions.first().redactions == 1
    assert "[REDACTED_IP]" in shown.events.filter("level = 'ERROR'").first().message
    assert [r.level for r in shown.levels.collect()] == ["INFO", "ERROR"]
