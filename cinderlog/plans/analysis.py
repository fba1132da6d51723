"""Whole flows over the operators: overview, indexing, answering, reporting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from cinderlog import fixed_values as fixed
from cinderlog.operators import audits, domains, events, index, metrics, prompts, reports
from cinderlog.operators import retrieval
from cinderlog.sources.event_facts import EventFacts, write_event_facts
from cinderlog.sources.staging import stage


@dataclass(frozen=True)
class Overview:
    """Everything an incident overview shows, each a lazy frame over the same events."""

    events: DataFrame
    rejected: DataFrame
    redactions: DataFrame
    metrics: DataFrame
    impact: DataFrame
    levels: DataFrame
    services: DataFrame


def overview(lines: DataFrame, redact: bool = True) -> Overview:
    """Log lines to parsed, masked events and their aggregates.

    The parsed lines are staged once and then read column by column.
    """
    parsed = stage(events.parse_lines(lines), "parsed-lines")
    masked = stage(events.redact_events(events.events_of(parsed), redact), "events")
    incidents = lines.select("incident_id").distinct()
    return Overview(
        events=masked.drop("redactions"),
        rejected=events.rejected_of(parsed),
        redactions=events.redaction_totals(masked),
        metrics=metrics.incident_metrics(masked, incidents),
        impact=metrics.impact_scores(masked, incidents),
        levels=metrics.level_chart(masked),
        services=metrics.service_chart(masked),
    )


def analysis_prompts(
    incident_events: DataFrame, queries: DataFrame, chunks: DataFrame
) -> DataFrame:
    """Retrieve runbook chunks per incident and build its analysis prompt.

    ``queries`` has ``query_id``, ``incident_id`` and ``embedding``, the embedded incident query.
    """
    matches = retrieval.with_chunks(retrieval.search(queries, chunks), chunks)
    evidence = matches.join(queries.select("query_id", "incident_id"), "query_id")
    return prompts.analysis_prompts(incident_events, evidence)


@dataclass(frozen=True)
class Answering:
    """Routed questions, the evidence found for them and the prompts of the answerable ones."""

    questions: DataFrame
    evidence: DataFrame
    prompts: DataFrame


def prepare_answers(
    questions: DataFrame,
    incident_events: DataFrame,
    chunks: DataFrame,
    threshold: float = fixed.RELEVANCE_THRESHOLD,
    name: str = fixed.ASSISTANT_NAME,
) -> Answering:
    """Alignment, retrieval, gate and prompts for
    ``(question_id, incident_id, question, embedding)``."""
    aligned = stage(domains.assess_alignment(questions, incident_events), "aligned")
    evidence = stage(
        retrieval.retrieve(aligned.filter("aligned"), chunks), "question-evidence"
    )
    gated = retrieval.relevance_gate(aligned, evidence, threshold)
    routed = stage(retrieval.answer_status(gated, chunks).drop("embedding"), "routed")
    asked = routed.filter("status = 'answer'")
    return Answering(
        questions=routed,
        evidence=evidence,
        prompts=prompts.qa_prompts(
            asked,
            incident_events,
            evidence.join(asked.select("question_id"), "question_id", "left_semi"),
            name,
        ),
    )


def review_answers(
    answers: DataFrame, incident_events: DataFrame, evidence: DataFrame, facts: EventFacts | None = None
) -> DataFrame:
    """Normalise citations, attach missing source context, then audit citations and claims.

    ``answers`` has ``answer_id, incident_id, answer, include_logs, chunk_count``; ``evidence``
    has ``answer_id, rank, source, heading``.  The events are read once, for their ``facts``, or not at
    all if these are given.
    """
    facts = facts or write_event_facts(incident_events)
    completed = stage(
        audits.attach_source_context(
            audits.normalize_answers(answers), incident_events, evidence, facts
        ),
        "answers",
    )
    cited = audits.citation_notes(audits.audit_citations(completed, incident_events, facts))
    claims = audits.audit_claims(completed, incident_events, facts)
    return completed.join(cited, "answer_id").join(claims, "answer_id")


def quick_report_rows(
    incident_events: DataFrame,
    chunks: DataFrame,
    created_at: Column,
    source_name: Column,
    name: str = fixed.ASSISTANT_NAME,
) -> DataFrame:
    """Rows for ``save_reports``: the quick report of every incident."""
    analyses = reports.quick_reports(incident_events, chunks, name)
    return reports.report_rows(incident_events, analyses, created_at, source_name)


def index_folder(documents: DataFrame, embed: index.Embedder) -> DataFrame:
    return index.build_index(documents, embed)
