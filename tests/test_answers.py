import hashlib

import pytest
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.operators import audits, evidence, prompts, reports
from cinderlog.plans import analysis
from cinderlog.sources import markdown_files, tables

START = "2026-08-06 14:03:1"
ANSWER = (
    "answer_id long, incident_id string, answer string, include_logs boolean, chunk_count long"
)
MATCH = "incident_id string, rank int, source string, heading string, content string"


@pytest.fixture
def gateway(events_of):
    return events_of(
        a=["x"] * 6
        + [START + "2 ERROR api-gateway - Request returned HTTP 503", START + "3 INFO db - code 204"],
        calm=[START + "2 INFO s - fine"],
    )


def audit(frame, gateway, *answers):
    rows = audits.audit_citations(frame(ANSWER, *answers), gateway)
    noted = audits.citation_notes(rows).orderBy("answer_id").collect()
    return [
        (list(r.cited), list(r.invalid), list(r.missing), r.citations_passed, r.note) for r in noted
    ]


def test_normalized_citations(frame):
    rows = audits.normalize_answers(
        frame(ANSWER, (1, "a", "stopped (L13); follow ( R1 ) (l4) (L x)", True, 1))
    )
    assert rows.first().answer == "stopped [L13]; follow [R1] [l4] (L x)"


def test_citation_audit(frame, gateway):
    found = audit(
        frame,
        gateway,
        (1, "a", "Observed [L7]; follow [R1]. [L7]", True, 1),
        (2, "a", "Observed [L99]; follow [R2].", True, 1),
        (3, "a", "Unsupported source [1].", True, 1),
        (4, "a", "Observed [L7].", True, 1),
        (5, "a", "A definition [R1], not [L7].", False, 1),
        (6, "a", "nothing", True, 0),
        (7, "a", "[L8] [L07] [l7]", True, 0),
    )
    assert found[0] == (["[L7]", "[R1]"], [], [], True, "Citation audit passed: [L7], [R1]")
    assert found[1][1:4] == (["[L99]", "[R2]"], [], False)
    assert found[2][:4] == (["[1]"], ["[1]"], ["[L#]", "[R#]"], False)
    assert found[3][1:4] == ([], ["[R#]"], False)
    assert found[4][1:4] == (["[L7]"], [], False)
    assert found[5][4] == (
        "Citation audit needs review: missing required citation type(s): [L#];"
        " no evidence labels were cited."
    )
    assert found[6][:2] == (["[L8]", "[L07]"], ["[L8]", "[L07]"])


def test_claim_audit(frame, gateway):
    rows = audits.audit_claims(
        frame(
            ANSWER,
            (1, "a", "The gateway returned HTTP 503 [L7].", True, 1),
            (2, "a", "Returned 503, then 500 and 500; 99 6000 204", True, 1),
            (3, "a", "HTTP 503.\n\n**Evidence**\n[L7] returned 503\n[R1] commonly 401 or 403.", True, 1),
            (4, "a", "ok\n## EVIDENCE\n [L1] 402\nEvidence:\n404", True, 1),
            (5, "a", "503", False, 1),
            (6, "a", "Evidence: 404 evidence\r\n405", True, 1),
        ),
        gateway,
    ).orderBy("answer_id").collect()
    assert [list(r.unsupported) for r in rows] == [[], ["500"], [], ["402"], ["503"], ["404"]]
    assert [r.claims_passed for r in rows] == [True, False, True, False, False, False]


def test_source_context(frame, gateway):
    matches = frame(
        "answer_id long, rank int, source string, heading string",
        *((n, 1, "custom/q.txt", "Immediate response") for n in (1, 2, 3)),
        (1, 2, "other", "other"),
    )
    rows = audits.attach_source_context(
        frame(
            ANSWER,
            (1, "a", "Stopped [L13]. Check. \n", True, 1),
            (2, "a", "Nothing cited", True, 1),
            (3, "calm", "Only [R1]", True, 1),
            (4, "a", "No chunks", False, 0),
        ),
        gateway,
        matches,
    )
    runbook = "Runbook context: [R1] custom/q.txt — Immediate response"
    assert {row.answer_id: row.answer for row in rows.collect()} == {
        1: f"Stopped [L13]. Check.\n\n**Source context**\n{runbook}",
        2: f"Nothing cited\n\n**Source context**\n{runbook}  \nActive log context: [L7] api-gateway",
        3: "Only [R1]",
        4: "No chunks",
    }


def test_review_runs_the_steps_in_order(frame, gateway):
    answers = frame(ANSWER, (1, "a", "Stopped (L7), HTTP 503.", True, 1))
    matches = frame(
        "answer_id long, rank int, source string, heading string", (1, 1, "r.md", "Head")
    )
    row = analysis.review_answers(answers, gateway, matches).first()
    assert row.answer.endswith("[R1] r.md — Head")
    assert row.citations_passed and row.claims_passed


def test_incident_query_and_prompt(frame, gateway):
    assert evidence.incident_queries(gateway).collect() == [
        ("a", 1, 1, "api-gateway: Request returned HTTP 503")
    ]
    matches = frame(MATCH, ("a", 2, "b.md", "H2", "two"), ("a", 1, "a.md", "H1", "one"))
    rows = {r.incident_id: r for r in prompts.analysis_prompts(gateway, matches).collect()}
    assert rows["a"].prompt == (
        fixed.ANALYSIS_PROMPT_HEAD
        + "[L7] 2026-08-06 14:03:12 ERROR api-gateway: Request returned HTTP 503"
        + fixed.ANALYSIS_PROMPT_MIDDLE
        + "[R1] Source: a.md, section: H1\none\n\n[R2] Source: b.md, section: H2\ntwo"
        + fixed.ANALYSIS_PROMPT_TAIL
    )
    assert rows["calm"].prompt.startswith(fixed.ANALYSIS_PROMPT_HEAD + "\n\nRUNBOOK EVIDENCE\n\n\n")


def test_long_prompt_comes_in_parts(frame, events_of):
    found = events_of(a=[f"{START}{n % 10} ERROR s - m{n}" for n in range(30)])
    none = frame(MATCH, ("z", 1, "a", "b", "c")).filter("false")
    whole = prompts.analysis_prompts(found, none).first().prompt
    parts = prompts.analysis_prompts(found, none, part_bytes=250).orderBy("part").collect()
    assert [(r.part, r.parts) for r in parts] == [(n, len(parts)) for n in range(1, len(parts) + 1)]
    assert 4 <= len(parts) <= 6
    assert "".join(r.prompt for r in parts) == whole


def test_qa_prompts(frame, gateway):
    questions = frame(
        "question_id long, incident_id string, question string",
        (1, "a", " What should I check? "), (2, "a", "What is a software incident?"),
        (3, "calm", "Why?"),
    )
    matches = frame(
        "question_id long, rank int, source string, heading string, content string",
        (1, 1, "database.md", "Recovery", "Inspect pool usage."),
    )
    rows = {
        r.question_id: r for r in prompts.qa_prompts(questions, gateway, matches, "Bot").collect()
    }
    assert rows[1].system.startswith("You are Bot, an offline")
    for piece in (
        "[L7] 2026-08-06", "[R1] Source: database.md", "\nWhat should I check?\n",
        "at least one [L#]", "at most 120 words",
    ):
        assert piece in rows[1].prompt
    assert "[L7]" not in rows[2].prompt and fixed.QA_DEFINITION_SCOPE in rows[2].prompt
    assert fixed.QA_NO_SERIOUS_EVENTS in rows[3].prompt


CHUNKS = "id long, source string, heading string, content string"


def test_quick_report(frame, events_of):
    found = events_of(
        a=[START + "1 ERROR db - connection pool exhausted", START + "2 WARN api - active=50",
           START + "3 ERROR db - again"],
        b=[START + "1 INFO x - nothing"],
        c=[START + "1 ERROR x - cpu utilization"],
    )
    index = frame(
        CHUNKS,
        (1, "database_connection_pool.md", "Symptoms", "s"),
        (2, "database_connection_pool.md", "Immediate response", "do"),
        (3, "database_connection_pool.md", "Prevention", "later"),
        (6, "high_cpu.md", "Third", "3"), (4, "high_cpu.md", "First", "1"),
        (5, "high_cpu.md", "Second", "2"),
    )
    rows = {
        r.incident_id: r.analysis_markdown
        for r in reports.quick_reports(found, index, "Bot").collect()
    }
    assert rows["a"] == (
        "## Executive summary\nBot detected **Database connection pool exhaustion** as the probable "
        "software incident pattern [L1] [L2].\n\n## Probable root cause\nDatabase connection pool "
        "exhaustion. This conclusion is rule-based and derived directly from matching log evidence: "
        "[L1] [L2].\n\n## Impact and propagation\n- **14:03:11 — db:** connection pool exhausted "
        "[L1]\n- **14:03:12 — api:** active=50 [L2]\n\n## Recommended actions\n- **Immediate "
        "response:** do [R1]\n- **Prevention:** later [R2]\n\n## Confidence\n**High.** The quick "
        "report uses deterministic patterns and does not invoke the language model.\n"
    )
    assert fixed.REPORT_NO_ACTIONS in rows["b"] and "**Low.**" in rows["b"]
    assert "- **First:** 1 [R1]\n- **Second:** 2 [R2]\n" in rows["c"] and "**Medium.**" in rows["c"]


LINE = "2026-08-06 14:03:12 ERROR database - Pool exhausted"


def signed_by_hand(name, lines, block):
    """The signature rule over a plain list of lines in event order."""
    digest = lambda texts: hashlib.sha256("\n".join(texts).encode()).hexdigest()
    for _ in range(2):
        lines = [digest(lines[n : n + block]) for n in range(0, len(lines), block)]
    return digest([name, *lines])


def test_signature(events_of):
    found = events_of(**{"incident.log": [LINE]})
    row = reports.signatures(found, F.col("incident_id")).first()
    assert row.signature == signed_by_hand("incident.log", [LINE], 1000)


def test_signature_of_a_long_incident_covers_every_line(events_of, monkeypatch):
    monkeypatch.setattr(reports, "SIGNATURE_LINES", 3)
    texts = [f"{START}{n % 10} ERROR s - m{n}" for n in range(40)]
    changed = texts[:-1] + [texts[-1] + "!"]
    signed = [
        reports.signatures(events_of(a=each), F.lit("n")).first().signature
        for each in (texts, texts, changed)
    ]
    assert signed[0] == signed[1] != signed[2]
    ordered = sorted(enumerate(texts), key=lambda item: (item[1][:19], item[0]))
    assert signed[0] == signed_by_hand("n", [text for _, text in ordered], 3)


@pytest.mark.parametrize("one_task", [reports.ONE_TASK_BYTES, -1])
def test_reports_share_a_signature_once(spark, events_of, frame, tmp_path, monkeypatch, one_task):
    monkeypatch.setattr(reports, "ONE_TASK_BYTES", one_task)
    path = str(tmp_path / "reports")
    found = events_of(a=[LINE], b=[LINE], c=[LINE + "!"])
    schema = "incident_id string, part int, analysis_markdown string"

    def save(created, *texts):
        rows = reports.report_rows(found, frame(schema, *texts), F.lit(created), F.lit("one.log"))
        return sorted(r.id for r in tables.save_reports(rows, path).collect())

    long = [("a", 1, "old"), ("b", 1, "x1"), ("b", 2, "x2"), ("b", 3, "x3"), ("c", 1, "c")]
    for _ in range(2):
        assert save("2026-01-01T00:00:00+00:00", *long) == [1, 2]
        stored = tables.read_reports(spark, path).orderBy("analysis_markdown").collect()
        assert [(r.part, r.analysis_markdown) for r in stored] == [(1, "c"), (1, "x1"), (2, "x2"), (3, "x3")]
        assert len({r.id for r in stored if r.analysis_markdown != "c"}) == 1
    recent = reports.recent_reports(tables.read_reports(spark, path), 2).collect()
    assert len(recent) == 4
    save("2026-01-02T00:00:00+00:00", ("b", 1, "short"))
    stored = tables.read_reports(spark, path).collect()
    assert sorted(r.analysis_markdown for r in stored) == ["c", "short"]
    newest = reports.recent_reports(tables.read_reports(spark, path), 1).collect()
    assert [r.analysis_markdown for r in newest] == ["short"]


def test_report_table(spark, events_of, frame, tmp_path):
    path = str(tmp_path / "reports")
    found = events_of(a=[LINE], b=[LINE, LINE], empty=["junk"])

    def rows(text, created, source):
        texts = frame(
            "incident_id string, analysis_markdown string", ("a", text), ("b", text), ("empty", text)
        )
        return reports.report_rows(source, texts, F.lit(created), F.col("incident_id"))

    first = tables.save_reports(rows("one", "2026-01-01T00:00:00+00:00", found), path).collect()
    assert sorted(r.id for r in first) == [1, 2]
    only_b = found.filter("incident_id = 'b'")
    tables.save_reports(rows("two", "2026-01-02T00:00:00+00:00", only_b), path)
    more = events_of(c=[LINE])
    texts = frame("incident_id string, analysis_markdown string", ("c", "three"))
    tables.save_reports(
        reports.report_rows(more, texts, reports.utc_now(), F.col("incident_id")), path
    )
    stored = tables.read_reports(spark, path)
    kept = {r.source_name: r for r in stored.collect()}
    assert (kept["a"].id, kept["a"].analysis_markdown, kept["a"].event_count) == (1, "one", 1)
    assert (kept["b"].id, kept["b"].analysis_markdown, kept["b"].event_count) == (2, "two", 2)
    assert (kept["c"].id, kept["c"].created_at[-6:]) == (3, "+00:00")
    assert kept["a"].started_at == "2026-08-06 14:03:12"
    recent = reports.recent_reports(stored, 2).collect()
    assert [r.source_name for r in recent] == ["c", "b"]
    assert "signature" not in recent[0].asDict()

    folder = str(tmp_path / "markdown")
    markdown_files.export_markdown(stored, folder)
    files = spark.read.text(folder, wholetext=True).select("_metadata.file_name", "value").collect()
    assert sorted(map(tuple, files)) == [("1.md", "one\n"), ("2.md", "two\n"), ("3.md", "three\n")]
