from pyspark.sql import functions as F

from cinderlog.operators import causes, domains, events, metrics
from cinderlog.operators.ordering import assemble, with_position

START = "2026-08-06 14:03:1"


def test_score_and_label(events_of):
    scores = {
        row.incident_id: row
        for row in metrics.impact_scores(
            events_of(
                many=[
                    START + "1 ERROR a - x", START + "2 CRITICAL b - x", START + "3 ERROR c - x",
                ],
                one=[START + "1 WARNING a - x", START + "2 INFO z - x"],
            )
        ).collect()
    }
    assert (scores["many"].score, scores["many"].label) == (46, "High")
    assert (scores["one"].score, scores["one"].label) == (3, "Low")
    assert scores["many"].explanation == (
        "3 serious events across 3 services; severity points 34, propagation points 12."
    )


def test_score_is_capped(events_of):
    row = metrics.impact_scores(events_of(a=[START + "1 FATAL a - x"] * 9)).first()
    assert (row.score, row.severity_points, row.label) == (100, 162, "Severe")


def test_incident_without_events(events_of, lines):
    every = lines(a=["junk"], b=[START + "1 INFO s - m"])
    found = events.events_of(events.parse_lines(every))
    score = {row.incident_id: row for row in metrics.impact_scores(found, every).collect()}
    assert (score["a"].score, score["a"].label) == (0, "None")
    assert score["a"].explanation == "No parsed events."
    assert (score["b"].score, score["b"].label) == (0, "Low")
    count = {row.incident_id: row.events for row in metrics.incident_metrics(found, every).collect()}
    assert count == {"a": 0, "b": 1}


def test_metrics(events_of):
    row = metrics.incident_metrics(
        events_of(
            a=[
                START + "1.900 ERROR a - x", START + "4.100 INFO b - x", START + "2 ERROR a - x",
                START + "3 CRITICAL c - x",
            ]
        )
    ).first()
    assert (row.events, row.errors, row.critical, row.services, row.duration_seconds) == (
        4, 2, 1, 3, 2,
    )


def test_levels_and_services(events_of):
    found = events_of(
        a=[START + "1 ERROR a - x", START + "2 TRACE b - x", START + "3 ERROR a - x"]
    )
    assert [(r.level, r.events) for r in metrics.level_chart(found).collect()] == [
        ("TRACE", 1), ("ERROR", 2),
    ]
    assert [(r.service, r.events) for r in metrics.service_chart(found).collect()] == [
        ("b", 1), ("a", 2),
    ]


def test_failure_chain(events_of):
    chain = metrics.failure_chain(
        events_of(
            a=[START + "5 ERROR a - late", START + "1 INFO a - no", START + "2 WARN b - early"],
            b=[START + "1 ERROR z - only"],
        )
    ).orderBy("incident_id", "step").collect()
    assert [(r.step, r.message, r.marker, r.time) for r in chain] == [
        (1, "early", "->", "14:03:12"), (2, "late", "END", "14:03:15"), (1, "only", "END", "14:03:11"),
    ]


def test_first_seen(events_of):
    found = events_of(
        a=[START + "5 ERROR a - late", START + "1 WARN a - early", START + "0 INFO a - no"]
    )
    assert metrics.first_seen(found).first().message == "early"
    assert metrics.first_serious(found).first().line_number == 2


def test_positions_of_a_group_that_spans_partitions(spark):
    """One group holds most rows; it has to be spread, numbered without gaps and in order."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).select(
            F.when(F.col("id") % 10 < 7, "hot").otherwise(
                F.concat(F.lit("k"), (F.col("id") % 13).cast("string"))
            ).alias("k"),
            ((F.col("id") * 7919) % 2003).alias("o"),
        )
        placed = with_position(rows, ["k"], ["o"], "p", "n").collect()
        groups = {}
        for row in placed:
            groups.setdefault(row.k, []).append((row.p, row.o, row.n))
        assert sum(len(group) for group in groups.values()) == 2000
        for group in groups.values():
            group.sort()
            assert [p for p, _, _ in group] == list(range(1, len(group) + 1))
            assert [o for _, o, _ in group] == sorted(o for _, o, _ in group)
            assert {n for _, _, n in group} == {len(group)}
        whole = with_position(rows, [], ["o"], "p").orderBy("p").collect()
        assert [row.p for row in whole] == list(range(1, 2001))
        assert [row.o for row in whole] == sorted(row.o for row in whole)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_long_text_comes_in_parts(spark):
    rows = spark.range(25).select(
        F.lit("a").alias("k"), "id", F.col("id").cast("string").alias("t")
    )
    parts = assemble(rows, ["k"], ["id"], "t", ", ", part_bytes=30).orderBy("part").collect()
    assert [(row.part, row.parts) for row in parts] == [(n, len(parts)) for n in range(1, len(parts) + 1)]
    assert len(parts) >= 3
    assert "".join(row.t for row in parts) == ", ".join(str(n) for n in range(25))


def test_causes(events_of):
    found = {
        row.incident_id: row
        for row in causes.detect_causes(
            events_of(
                pool=[
                    START + "1 INFO a - Connection POOL exhausted active=50",
                    START + "2 ERROR a - database connection timeout",
                    START + "4 ERROR a - jwt signature bad",
                    START + "3 ERROR a - active=50",
                    START + "5 ERROR a - active=50",
                ],
                tie=[START + "1 ERROR a - worker queue", START + "2 ERROR a - signing key"],
                none=[START + "1 ERROR a - weird"],
            )
        ).collect()
    }
    assert (found["pool"].source, found["pool"].matches) == ("database_connection_pool.md", 4)
    assert found["pool"].citations == "[L1] [L2] [L4]"
    assert found["pool"].confidence == "High"
    assert found["tie"].source == "authentication_failures.md"
    assert (found["tie"].citations, found["tie"].confidence) == ("[L2]", "Medium")
    assert found["none"].source is None
    assert (found["none"].citations, found["none"].confidence) == ("No matching rule", "Low")


def test_alignment(events_of, frame):
    found = events_of(
        auth=[START + "1 ERROR auth-service - JWT signing key not found; token validation failed"],
        queue=[START + "1 ERROR queue-consumer - Consumer stopped; backlog growing"],
        calm=[START + "1 INFO queue - fine"],
    )
    asked = frame(
        "question_id long, incident_id string, question string",
        (1, "auth", "Why is the message queue backlog growing?"),
        (2, "queue", "Why is the message queue backlog growing?"),
        (3, "calm", "Why is the message queue backlog growing?"),
        (4, "auth", "What is  an queue?"),
        (5, "auth", "Anything else?"),
        (6, "auth", "What does queue mean?"),
        (7, "auth", "What is causing the queue?"),
    )
    rows = {row.question_id: row for row in domains.assess_alignment(asked, found).collect()}
    assert [rows[n].aligned for n in range(1, 8)] == [False, True, True, True, True, True, False]
    assert (rows[1].question_domain, rows[1].incident_domain) == ("message queue", "authentication")
    assert rows[4].question_domain is None and not rows[4].needs_logs
    assert rows[3].incident_domain is None


def test_domain_ties_and_overlaps(events_of):
    found = domains.incident_domains(
        events_of(
            tie=[START + "1 ERROR a - jwt", START + "2 ERROR a - sql"],
            overlap=[START + "1 ERROR a - message queue"],
        )
    )
    rows = {row.incident_id: row for row in found.collect()}
    assert rows["tie"].incident_domain == "authentication"
    assert (rows["overlap"].incident_domain, rows["overlap"].domain_hits) == ("message queue", 2)


def test_event_frame_and_timeline(events_of):
    found = events_of(a=[START + "1.250000 ERROR a - x", START + "2 INFO b - y"])
    assert events.event_frame(found).columns == [
        "incident_id", "Time", "Level", "Service", "Message", "Line",
    ]
    rows = events.timeline(found, ["ERROR"]).collect()
    assert [(row.Time, row.Line) for row in rows] == [("2026-08-06 14:03:11.25", 1)]
    row = events.verified_evidence(found).first()
    assert (row.Evidence, row.Time) == ("L1", "2026-08-06 14:03:11")
    window = metrics.event_window(found).first()
    assert (window.started_at, window.ended_at) == (
        "2026-08-06 14:03:11.250000", "2026-08-06 14:03:12",
    )
