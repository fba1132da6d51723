"""The registered queries: every operator over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.operators import (
    audits,
    causes,
    chunks,
    clusters,
    domains,
    embedding,
    evaluation,
    events,
    evidence,
    index,
    keyword_rules,
    long_documents,
    metrics,
    prompts,
    reports,
    retrieval,
)
from cinderlog.plans.driver_tables import DriverTables, incident_number_sql
from cinderlog.session import configure
from cinderlog.sources.staging import stage, staging_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIOUS_AND_INFO = ("INFO", "ERROR", "CRITICAL")
REPLACED_SOURCE = "label-3"
CREATED_BEFORE = "2024-02-01T00:00:00+00:00"
CREATED_NOW = "2024-03-01T12:00:00+00:00"
# Words and parts of words, and the headings that ``documents`` puts in.
EMBEDDED_TERMS = ("Step", "the", "er", "an", "in", "e")
# Small enough for the largest incident to have many parts at every scale of the given tables.
QUERY_PART_BYTES = 50_000


def query(function: Callable[[DriverTables], DataFrame]) -> Callable[[DriverTables], DataFrame]:
    """Register a function of the derived tables under its own name."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(DriverTables(configure(spark), folder))

    QUERIES[function.__name__] = run
    return function


def _joined(labels: str) -> F.Column:
    return F.array_join(labels, ",").alias(labels)


def _bigints(frame: DataFrame, *names: str) -> DataFrame:
    return frame.withColumns({name: F.col(name).cast("bigint") for name in names})


# --- parsing and redaction -------------------------------------------------------------------


@query
def parse_events(t: DriverTables) -> DataFrame:
    return t.events().select(
        "incident_id", "line_number", "ts", "level", "service", "message", "raw_line"
    )


@query
def rejected_lines(t: DriverTables) -> DataFrame:
    return events.rejected_of(t.parsed())


@query
def rejected_counts(t: DriverTables) -> DataFrame:
    return events.rejected_counts(t.parsed())


@query
def redact_events(t: DriverTables) -> DataFrame:
    masked = events.redact_events(t.events())
    return _bigints(
        masked.select("incident_id", "line_number", "message", "raw_line", "redactions"),
        "redactions",
    )


@query
def redaction_totals(t: DriverTables) -> DataFrame:
    return events.redaction_totals(events.redact_events(t.events()))


@query
def redact_documents(t: DriverTables) -> DataFrame:
    return events.redact_columns(t.texts(), ["text"], "redactions").select(
        "doc_id", F.md5("text").alias("text_md5"), F.col("redactions").cast("bigint")
    )


@query
def redact_pages(t: DriverTables) -> DataFrame:
    pages = t.spread(t.table("pages").select("page_id", "html"))
    return events.redact_columns(pages, ["html"], "redactions").select(
        "page_id", F.md5("html").alias("html_md5"), F.col("redactions").cast("bigint")
    )


# --- overview --------------------------------------------------------------------------------


@query
def event_order(t: DriverTables) -> DataFrame:
    return events.in_event_order(t.events()).select("incident_id", "line_number", "ts")


@query
def incident_metrics(t: DriverTables) -> DataFrame:
    return metrics.incident_metrics(t.events())


@query
def impact_score(t: DriverTables) -> DataFrame:
    return _bigints(
        metrics.impact_scores(t.events()),
        "score", "serious", "affected_services", "severity_points", "spread_points",
    )


@query
def level_counts(t: DriverTables) -> DataFrame:
    return _bigints(metrics.level_chart(t.events()), "severity")


@query
def levels_present(t: DriverTables) -> DataFrame:
    return _bigints(metrics.levels_present(t.events()), "severity")


@query
def service_counts(t: DriverTables) -> DataFrame:
    return metrics.service_chart(t.events())


@query
def event_frame(t: DriverTables) -> DataFrame:
    return events.event_frame(t.events())


@query
def timeline(t: DriverTables) -> DataFrame:
    return events.timeline(t.events(), SERIOUS_AND_INFO)


@query
def verified_evidence(t: DriverTables) -> DataFrame:
    return events.verified_evidence(t.events())


@query
def failure_chain(t: DriverTables) -> DataFrame:
    return _bigints(metrics.failure_chain(t.staged_events()), "step")


@query
def first_seen_by_service(t: DriverTables) -> DataFrame:
    return metrics.first_seen(t.events())


@query
def first_serious_event(t: DriverTables) -> DataFrame:
    return metrics.first_serious(t.events())


@query
def event_window(t: DriverTables) -> DataFrame:
    return metrics.event_window(t.events())


# --- causes and domains ----------------------------------------------------------------------


@query
def cause_matches(t: DriverTables) -> DataFrame:
    return _bigints(
        causes.rule_matches(t.events()).select("incident_id", "line_number", "rule"), "rule"
    )


@query
def detect_cause(t: DriverTables) -> DataFrame:
    return causes.detect_causes(t.staged_events())


@query
def detect_domain(t: DriverTables) -> DataFrame:
    return domains.incident_domains(t.events())


def _user_rules(t: DriverTables) -> DataFrame:
    """The fixed cause rules and one more for every user."""
    number, name = F.col("user_id") + len(fixed.CAUSE_RULES), F.col("user_id").cast("string")
    users = t.table("events").select("user_id").distinct()
    own = users.select(
        number.cast("long").alias("rule"),
        F.concat(F.lit("Failed sign-ins of user "), name).alias("cause"),
        F.lit("authentication_failures.md").alias("source"),
        F.concat(F.lit("user-"), name, F.lit("@mail")).alias("keyword"),
    )
    return stage(keyword_rules.cause_rules(t.spark).unionByName(own), "cause-rules")


@query
def cause_matches_by_table(t: DriverTables) -> DataFrame:
    found = keyword_rules.rule_matches(t.events(), _user_rules(t))
    return found.select("incident_id", "line_number", "rule")


@query
def detect_cause_by_table(t: DriverTables) -> DataFrame:
    return keyword_rules.detect_causes(t.staged_events(), _user_rules(t))


@query
def detect_domain_by_table(t: DriverTables) -> DataFrame:
    return keyword_rules.incident_domains(t.staged_events(), keyword_rules.domain_rules(t.spark))


@query
def question_scope(t: DriverTables) -> DataFrame:
    return domains.question_domains(t.questions()).select(
        "question_id", "needs_logs", "question_domain"
    )


@query
def alignment(t: DriverTables) -> DataFrame:
    return domains.assess_alignment(t.questions(), t.events()).select(
        "question_id", "needs_logs", "question_domain", "incident_domain", "aligned"
    )


# --- documents and index ---------------------------------------------------------------------


@query
def split_sections(t: DriverTables) -> DataFrame:
    return _bigints(
        chunks.split_sections(t.documents()).select(
            "source", "section", "heading", F.md5("content").alias("content_md5")
        ),
        "section",
    )


@query
def chunk_documents(t: DriverTables) -> DataFrame:
    return _bigints(
        chunks.chunk_documents(t.documents()).select(
            "source",
            "position",
            "heading",
            F.length("content").cast("bigint").alias("characters"),
            F.md5("content").alias("content_md5"),
        ),
        "position",
    )


@query
def chunk_document_lines(t: DriverTables) -> DataFrame:
    """The same chunks from documents that come line by line."""
    lines = long_documents.document_lines(t.documents())
    return _bigints(
        long_documents.chunk_lines(lines).select(
            "source",
            "position",
            "heading",
            F.length("content").cast("bigint").alias("characters"),
            F.md5("content").alias("content_md5"),
        ),
        "position",
    )


@query
def build_index(t: DriverTables) -> DataFrame:
    built = index.build_index(t.documents(), embedding.hashed_words())
    return built.select("id", "source", "heading", F.size("embedding").alias("dimensions"))


@query
def build_index_values(t: DriverTables) -> DataFrame:
    """The index with all numbers of its vectors, by an embedder that SQL can restate."""
    built = index.build_index(t.documents(), embedding.term_counts(EMBEDDED_TERMS))
    numbers = F.transform("embedding", lambda value: value.cast("bigint").cast("string"))
    return built.select(
        "id", "source", "heading", F.array_join(numbers, ",").alias("embedding")
    )


@query
def reused_vectors(t: DriverTables) -> DataFrame:
    """All chunks, the texts of every second one with a vector known before: -1 in each dimension."""
    listed = stage(chunks.chunk_documents(t.documents()), "listed-chunks")
    marked = F.transform(F.array(*map(F.lit, EMBEDDED_TERMS)), lambda _: F.lit(-1.0).cast("float"))
    known = listed.where(F.col("position") % 2 == 0).withColumn("embedding", marked)
    found = index.embed_unseen(listed, known, embedding.term_counts(EMBEDDED_TERMS))
    numbers = F.transform("embedding", lambda value: value.cast("bigint").cast("string"))
    shown = found.select("source", "position", "heading", F.array_join(numbers, ",").alias("embedding"))
    return _bigints(shown, "position")


@query
def chunk_count(t: DriverTables) -> DataFrame:
    return index.chunk_count(t.index())


@query
def chunk_sources(t: DriverTables) -> DataFrame:
    return index.list_sources(t.index())


@query
def source_chunks(t: DriverTables) -> DataFrame:
    return index.source_chunks(t.vectors(), REPLACED_SOURCE)


@query
def duplicate_keys(t: DriverTables) -> DataFrame:
    return index.duplicate_keys(t.index())


@query
def replace_source(t: DriverTables) -> DataFrame:
    current = t.vectors().drop("embedding")
    fresh = current.filter(F.col("source") == REPLACED_SOURCE).select(
        (F.col("id") + 1_000_000).alias("id"),
        "source",
        F.concat(F.lit("New "), F.lower("heading")).alias("heading"),
        "content",
    )
    return index.replace_sources(current, fresh)


@query
def delete_source(t: DriverTables) -> DataFrame:
    return index.without_sources(t.vectors().drop("embedding"), [REPLACED_SOURCE])


@query
def removed_chunks(t: DriverTables) -> DataFrame:
    return index.removed_counts(t.vectors(), [REPLACED_SOURCE])


# --- retrieval and evaluation ----------------------------------------------------------------


@query
def top_k(t: DriverTables) -> DataFrame:
    found = retrieval.search(t.query_vectors(), t.vectors())
    return _bigints(
        found.select("query_id", "rank", "id", F.round("score", 6).alias("score")), "rank"
    )


@query
def top_k_in_blocks(t: DriverTables) -> DataFrame:
    """The same search with query vectors of more than one block."""
    found = retrieval.search(t.query_vectors(), t.vectors(), block_bytes=100_000)
    return _bigints(
        found.select("query_id", "rank", "id", F.round("score", 6).alias("score")), "rank"
    )


@query
def top_k_clustered(t: DriverTables) -> DataFrame:
    """The same search over a clustered table, where clusters that cannot matter are skipped."""
    path = f"{staging_root(t.spark)}/clustered-{uuid.uuid4().hex}"
    clusters.write_clustered(t.vectors(), path)
    found = clusters.search(t.query_vectors(), clusters.read_clustered(t.spark, path))
    return _bigints(
        found.select("query_id", "rank", "id", F.round("score", 6).alias("score")), "rank"
    )


@query
def matched_chunks(t: DriverTables) -> DataFrame:
    found = retrieval.with_chunks(retrieval.search(t.query_vectors(), t.vectors()), t.vectors())
    return found.select(
        "query_id",
        retrieval.runbook_label(F.col("rank")).alias("label"),
        "source",
        "heading",
        "content",
    )


def _gated(t: DriverTables) -> DataFrame:
    questions = t.question_vectors()
    found = retrieval.retrieve(questions, t.vectors())
    return retrieval.relevance_gate(questions, found)


@query
def relevance_gate(t: DriverTables) -> DataFrame:
    return _gated(t).select(
        "question_id", F.round("best_score", 6).alias("best_score"), "threshold", "accepted"
    )


@query
def answer_status(t: DriverTables) -> DataFrame:
    gated = _gated(t).select("question_id", "accepted")
    aligned = domains.assess_alignment(t.questions(), t.events()).join(gated, "question_id")
    return retrieval.answer_status(aligned, t.vectors()).select("question_id", "status", "reply")


@query
def evaluate_retrieval(t: DriverTables) -> DataFrame:
    return evaluation.evaluate_retrieval(t.cases(), t.vectors()).withColumn(
        "score", F.round("score", 6)
    )


@query
def evaluation_summary(t: DriverTables) -> DataFrame:
    results = evaluation.evaluate_retrieval(t.cases(), t.vectors())
    return evaluation.evaluation_summary(results).select(
        "passed",
        "cases",
        F.round("accuracy_percent", 6).alias("accuracy_percent"),
        "mean_latency_seconds",
    )


@query
def evaluation_table(t: DriverTables) -> DataFrame:
    results = evaluation.evaluate_retrieval(t.cases(), t.vectors())
    # Rounded in two steps on either side of the comparison.
    rounded = results.withColumn("score", F.round("score", 6))
    return evaluation.evaluation_table(rounded)


@query
def optional_cases(t: DriverTables) -> DataFrame:
    """Cases kept only where their expected source is indexed."""
    indexed = t.index().select(F.regexp_replace("source", "^custom/src", "label-").alias("source"))
    cases = t.cases().select("name", "expected_source")
    return evaluation.indexed_cases(cases, indexed).select("name", "expected_source")


# --- evidence and prompts --------------------------------------------------------------------


@query
def incident_query(t: DriverTables) -> DataFrame:
    return _bigints(evidence.incident_queries(t.staged_events(), QUERY_PART_BYTES), "part", "parts")


@query
def log_evidence(t: DriverTables) -> DataFrame:
    return _bigints(evidence.log_evidence(t.staged_events(), QUERY_PART_BYTES), "part", "parts")


@query
def runbook_evidence(t: DriverTables) -> DataFrame:
    found = retrieval.with_chunks(retrieval.search(t.query_vectors(), t.vectors()), t.vectors())
    return evidence.runbook_evidence(found, "query_id")


def _incident_evidence(t: DriverTables) -> DataFrame:
    """Matches of query n as the evidence of incident n; the next one is the hot incident's."""
    # One row, so this is a filter with a bound from the events.
    count = F.broadcast(t.sql(incident_number_sql(), "events"))
    asked = t.query_vectors().join(count, F.col("query_id") <= F.col("incidents"))
    found = retrieval.search(asked, t.vectors())
    name = F.when(F.col("query_id") == F.col("incidents"), "incident-hot").otherwise(
        F.concat(F.lit("incident-"), F.col("query_id").cast("string"))
    )
    return (
        retrieval.with_chunks(found, t.vectors())
        .join(count, F.col("query_id") <= F.col("incidents"))
        .withColumn("incident_id", name)
        .drop("incidents")
    )


@query
def analysis_prompt(t: DriverTables) -> DataFrame:
    built = prompts.analysis_prompts(t.staged_events(), _incident_evidence(t), QUERY_PART_BYTES)
    return _bigints(built, "part", "parts").select(
        "incident_id", "part", "parts", "system", "prompt"
    )


@query
def qa_prompt(t: DriverTables) -> DataFrame:
    """The frames; their evidence is the result of ``log_evidence``."""
    found = retrieval.retrieve(t.question_vectors(), t.vectors())
    return prompts.qa_frames(t.questions(), found).drop("incident_id")


# --- answers ---------------------------------------------------------------------------------


@query
def normalize_citations(t: DriverTables) -> DataFrame:
    return audits.normalize_answers(t.answers()).select("answer_id", "answer")


@query
def attach_context(t: DriverTables) -> DataFrame:
    answers = t.answers()
    asked = answers.select("answer_id", F.floor(F.col("answer_id") / 100).alias("query_id"))
    # Only what is asked is searched, and only the best match is named.
    vectors = t.query_vectors().join(asked.select("query_id"), "query_id", "left_semi")
    best = retrieval.with_chunks(retrieval.search(vectors, t.vectors(), 1), t.vectors())
    return audits.attach_source_context(answers, t.events(), best.join(asked, "query_id")).select(
        "answer_id", "answer"
    )


@query
def citation_audit(t: DriverTables) -> DataFrame:
    audited = audits.audit_citations(audits.normalize_answers(t.answers()), t.events())
    return audits.citation_notes(audited).select(
        "answer_id",
        _joined("cited"),
        _joined("invalid"),
        _joined("missing"),
        "citations_passed",
        "note",
    )


@query
def incident_statuses(t: DriverTables) -> DataFrame:
    return audits.incident_statuses(t.events())


@query
def claim_audit(t: DriverTables) -> DataFrame:
    return audits.audit_claims(t.answers(), t.events()).select(
        "answer_id", _joined("unsupported"), "claims_passed"
    )


# --- reports ---------------------------------------------------------------------------------


@query
def action_texts(t: DriverTables) -> DataFrame:
    return reports.action_texts(t.index()).select("source", F.md5("actions").alias("actions_md5"))


@query
def quick_report(t: DriverTables) -> DataFrame:
    return _bigints(
        reports.quick_reports(t.staged_events(), t.index(), part_bytes=QUERY_PART_BYTES),
        "part",
        "parts",
    )


def _masked(t: DriverTables) -> DataFrame:
    return events.redact_events(t.events())


def _source_name() -> F.Column:
    return F.concat("incident_id", F.lit(".log"))


@query
def report_signature(t: DriverTables) -> DataFrame:
    return reports.signatures(stage(_masked(t), "masked"), _source_name())


def _report_tables(t: DriverTables) -> tuple[DataFrame, DataFrame]:
    """A report table with the incidents of many criticals, and rows of all incidents."""
    masked = stage(_masked(t), "masked")
    texts = causes.detect_causes(masked).select(
        "incident_id", F.col("cause").alias("analysis_markdown")
    )
    rows = stage(
        reports.report_rows(masked, texts, F.lit(CREATED_NOW), _source_name()), "report-rows"
    )
    counts = metrics.incident_metrics(masked).filter("critical * 4 > errors")
    known = rows.join(
        counts.select(F.concat("incident_id", F.lit(".log")).alias("source_name")),
        "source_name",
        "left_semi",
    )
    old = known.select(
        "incident_id",
        "signature",
        "part",
        "source_name",
        F.lit(CREATED_BEFORE).alias("created_at"),
        "event_count",
        "started_at",
        "ended_at",
        F.lit("earlier text").alias("analysis_markdown"),
    )
    empty = t.spark.createDataFrame([], reports.REPORTS)
    return stage(reports.upsert_reports(empty, old), "reports"), rows


@query
def upsert_reports(t: DriverTables) -> DataFrame:
    table, rows = _report_tables(t)
    return reports.upsert_reports(table, rows)


@query
def upsert_repeated_reports(t: DriverTables) -> DataFrame:
    """A batch that repeats the signatures of a tenth of the names, saved twice."""
    table, rows = _report_tables(t)
    again = rows.filter(F.col("source_name").endswith("1.log")).withColumns(
        {
            "incident_id": F.concat("incident_id", F.lit("-copy")),
            "analysis_markdown": F.concat(F.lit("copy of "), "analysis_markdown"),
        }
    )
    batch = stage(rows.unionByName(again), "report-rows")
    once = stage(reports.upsert_reports(table, batch), "reports")
    return reports.upsert_reports(once, batch)


@query
def recent_reports(t: DriverTables) -> DataFrame:
    table, rows = _report_tables(t)
    return reports.recent_reports(stage(reports.upsert_reports(table, rows), "reports"), 10)
