import random
import re

from pyspark.sql import functions as F

from cinderlog.operators import audits
from cinderlog.plans import analysis
from cinderlog.sources.event_facts import write_event_facts

ANSWER = "answer_id long, incident_id string, answer string, include_logs boolean, chunk_count long"


def inputs(frame, events_of):
    draw = random.Random(4)
    lines = {
        name: [f"2026-01-01 10:00:{n:02d} {draw.choice(('INFO', 'ERROR', 'WARN'))} svc{n % 3} - returned {draw.choice((200, 404, 503))}" for n in range(40)]
        for name in ("hot", "b", "c")
    }
    parts = ["[L3]", "( L17 )", "[R1]", "(R9)", "returned 503", "code 404 and 418", "[L99]", "text"]
    answers = [
        (n, draw.choice(("hot", "hot", "b", "none")), " ".join(draw.choices(parts, k=4)), n % 4 > 0, n % 3) for n in range(60)
    ]
    evidence = [(n, 1, "db.md", "Pool") for n in range(0, 60, 2)]
    return (
        frame(ANSWER, *answers),
        events_of(**lines),
        frame("answer_id long, rank int, source string, heading string", *evidence),
    )


def rows(result):
    return sorted((tuple(row) for row in result.collect()), key=repr)


def test_same_audits_from_facts(frame, events_of):
    answers, events, evidence = inputs(frame, events_of)
    facts = write_event_facts(events, 8)
    for audit in (audits.audit_citations, audits.audit_claims):
        assert rows(audit(answers, events, facts)) == rows(audit(answers, events))
    assert rows(audits.attach_source_context(answers, events, evidence, facts)) == rows(
        audits.attach_source_context(answers, events, evidence)
    )
    reviewed = analysis.review_answers(answers, events, evidence)
    assert reviewed.count() == 60 and reviewed.where(F.size("unsupported") > 0).count() > 0


def test_events_are_read_in_their_buckets(spark, frame, events_of):
    """No exchange stands above a scan of the facts, though none of them may be broadcast."""
    answers, events, evidence = inputs(frame, events_of)
    facts = write_event_facts(events, 8)
    none = events.where("false")
    old = {name: spark.conf.get(name) for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for checked in (
            audits.attach_source_context(answers, none, evidence, facts),
            audits.audit_citations(answers, none, facts),
            audits.audit_claims(answers, none, facts),
        ):
            plan = checked._jdf.queryExecution().executedPlan().toString()
            nodes = [(m.end(), line) for line in plan.splitlines() if (m := re.match(r"[ :]*[:+]- ", line))]
            scans = [n for n, (_, line) in enumerate(nodes) if "event_facts_" in line]
            assert scans
            for n in scans:
                at, above = nodes[n][0], []
                for depth, line in reversed(nodes[:n]):
                    if depth < at:
                        at = depth
                        above.append(line)
                upto = next(k for k, line in enumerate(above) if "Join" in line)
                assert not any("Exchange" in line for line in above[:upto]), plan
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
