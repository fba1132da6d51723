"""Checks of generated answers against the evidence they were given.

``answers`` has ``answer_id, incident_id, answer, include_logs, chunk_count``: whether the
question needed log context, and how many runbook chunks its prompt listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.stages import pinned
from cinderlog.functions.text import (
    cited_labels,
    http_statuses,
    normalize_citations,
    strip_end,
    unify_line_ends,
)
from cinderlog.operators.events import serious
from cinderlog.operators.metrics import first_serious
from cinderlog.operators.ordering import UNMATCHED
from cinderlog.sources.event_facts import EventFacts
from cinderlog.sources.staging import broadcast_if_small, stage


def normalize_answers(answers: DataFrame) -> DataFrame:
    return answers.withColumn("answer", normalize_citations(F.col("answer")))


def attach_source_context(
    answers: DataFrame, events: DataFrame, evidence: DataFrame, facts: EventFacts | None = None
) -> DataFrame:
    """Append a source line for each label type that the answer leaves out.

    ``evidence`` holds the matched chunks with ``answer_id`` and ``rank``; the best one and the
    incident's first serious event are named.  With ``facts`` of the events these are not read.
    """
    top = evidence.filter(F.col("rank") == 1).select(
        "answer_id", F.format_string(fixed.RUNBOOK_CONTEXT, "source", "heading").alias("_runbook")
    )
    first = (first_serious(events) if facts is None else facts.first).select(
        "incident_id", F.format_string(fixed.LOG_CONTEXT, "line_number", "service").alias("_log")
    )
    cites_runbook = F.rlike("answer", F.lit(r"(?U)\[R\d+\]"))
    cites_log = F.rlike("answer", F.lit(r"(?U)\[L\d+\]"))
    added = F.concat_ws(
        fixed.SOURCE_CONTEXT_JOIN,
        F.when(~cites_runbook, F.col("_runbook")),
        F.when(F.col("include_logs") & ~cites_log, F.col("_log")),
    )
    joined = answers.join(top, "answer_id", "left").join(first, "incident_id", "left")
    return (
        joined.withColumn("_added", added)
        .withColumn(
            "answer",
            F.when(F.col("_added") == "", F.col("answer")).otherwise(
                F.concat(
                    strip_end(F.col("answer")), F.lit(fixed.SOURCE_CONTEXT_HEAD), "_added"
                )
            ),
        )
        .select(*answers.columns)
    )


def _label_number(label: Column, kind: str) -> Column:
    """Number of a ``[L#]`` or ``[R#]`` label; null unless it is written canonically."""
    number = F.substr(label, F.lit(3), F.length(label) - 3).try_cast("bigint")
    return F.when(label == F.concat(F.lit(f"[{kind}"), number.cast("string"), F.lit("]")), number)


def audit_citations(
    answers: DataFrame, events: DataFrame, facts: EventFacts | None = None
) -> DataFrame:
    """``cited``, ``invalid`` and ``missing`` label arrays, and ``citations_passed``.

    Cited lines meet the events by an equi-join on (incident, line number); the allowed labels
    of an incident are never gathered.  With ``facts`` of the events these are not read.
    """
    labels = stage(
        answers.select(
            "answer_id",
            "incident_id",
            "include_logs",
            "chunk_count",
            F.posexplode_outer(cited_labels(F.col("answer"))).alias("_pos", "_label"),
        ).withColumns(
            {
                "_line": F.when(F.col("include_logs"), _label_number(F.col("_label"), "L")),
                "_chunk": _label_number(F.col("_label"), "R"),
            }
        ),
        "labels",
    )
    lines = _cited_lines(labels, events) if facts is None else facts.lines
    found = lines.select(
        "incident_id", F.col("line_number").alias("_line"), F.lit(True).alias("_found")
    )
    # Labels without a line get negative numbers, which match nothing and spread over all tasks.
    spread = -F.shiftrightunsigned(F.xxhash64("answer_id", "_pos"), 1) - 1
    keyed = labels.withColumn("_line", F.coalesce("_line", spread))
    checked = keyed.join(found, ["incident_id", "_line"], "left").withColumn(
        "_valid",
        F.coalesce("_found", F.lit(False))
        | F.coalesce(F.col("_chunk").between(F.lit(1), F.col("chunk_count")), F.lit(False)),
    )

    def gather(condition: Column) -> Column:
        kept = F.collect_list(F.when(condition, F.struct("_pos", "_label")))
        return F.transform(F.array_sort(kept), lambda item: item["_label"])

    def lacks(kind: str) -> Column:
        return ~F.exists("cited", lambda label: F.startswith(label, F.lit(f"[{kind}")))

    grouped = checked.groupBy("answer_id").agg(
        F.first("include_logs").alias("_logs"),
        F.first("chunk_count").alias("_chunks"),
        gather(F.col("_label").isNotNull()).alias("cited"),
        gather(F.col("_label").isNotNull() & ~F.col("_valid")).alias("invalid"),
    )
    audited = grouped.withColumn(
        "missing",
        F.array_compact(
            F.array(
                F.when(F.col("_logs") & lacks("L"), F.lit("[L#]")),
                F.when((F.col("_chunks") > 0) & lacks("R"), F.lit("[R#]")),
            )
        ),
    )
    return audited.select(
        "answer_id",
        "cited",
        "invalid",
        "missing",
        (
            (F.size("cited") > 0) & (F.size("invalid") == 0) & (F.size("missing") == 0)
        ).alias("citations_passed"),
    )


def _cited_lines(labels: DataFrame, events: DataFrame) -> DataFrame:
    """The serious lines among those that labels name, found without a shuffle of the events."""
    wanted = stage(
        labels.filter(F.col("_line").isNotNull())
        .select("incident_id", F.col("_line").alias("line_number"))
        .distinct(),
        "cited-lines",
    )
    return (
        serious(events)
        .select("incident_id", "line_number")
        .join(broadcast_if_small(wanted), ["incident_id", "line_number"], "left_semi")
        .distinct()
    )


def citation_notes(audited: DataFrame) -> DataFrame:
    """Add ``note``, the sentence that reports a citation audit."""

    def listed(prefix: str, labels: str) -> Column:
        return F.when(
            F.size(labels) > 0, F.concat(F.lit(prefix), F.array_join(labels, ", "))
        )

    problems = F.concat_ws(
        "; ",
        listed(fixed.CITATION_INVALID, "invalid"),
        listed(fixed.CITATION_MISSING, "missing"),
        F.when(F.size("cited") == 0, fixed.CITATION_NONE),
    )
    return audited.withColumn(
        "note",
        F.when(
            F.col("citations_passed"),
            F.concat(F.lit(fixed.CITATION_PASSED), F.array_join("cited", ", ")),
        ).otherwise(F.concat(F.lit(fixed.CITATION_REVIEW), problems, F.lit("."))),
    )


def incident_statuses(events: DataFrame) -> DataFrame:
    """Distinct ``(incident_id, status)`` over the messages of all levels; at most 500 each."""
    return events.select(
        "incident_id", F.explode(http_statuses(F.col("message"))).alias("status")
    ).distinct()


def claim_texts(answers: DataFrame) -> DataFrame:
    """Replace ``answer`` by the part whose numbers count as claims about the incident.

    From the first evidence heading on, only lines that start with a log label remain.
    """
    staged = answers.withColumn(
        "_lines", F.split(unify_line_ends(F.col("answer")), "\n", -1)
    ).withColumn(
        "_heading",
        F.array_position(
            F.transform("_lines", lambda line: F.rlike(line, F.lit(fixed.EVIDENCE_HEADING))),
            True,
        ).cast("int"),
    )
    before = F.slice("_lines", F.lit(1), F.col("_heading") - 1)
    after = F.filter(
        F.slice("_lines", F.col("_heading"), F.size("_lines")),
        lambda line: F.rlike(line, F.lit(fixed.LOG_LABELLED_LINE)),
    )
    claims = F.when(F.col("_heading") == 0, F.col("answer")).otherwise(
        F.array_join(F.concat(before, after), "\n")
    )
    return pinned(staged, {"answer": claims}).select(*answers.columns)


def audit_claims(
    answers: DataFrame, events: DataFrame, facts: EventFacts | None = None
) -> DataFrame:
    """``unsupported`` HTTP statuses, in order, and ``claims_passed``.

    A definition question has no log evidence, so there any status is unsupported.  With ``facts`` of the
    events these are not read.
    """
    flat = claim_texts(
        answers.select("answer_id", "incident_id", "include_logs", "answer")
    ).select(
        "answer_id",
        "incident_id",
        "include_logs",
        F.explode_outer(http_statuses(F.col("answer"))).alias("status"),
    )
    claimed = flat.select(
        "answer_id",
        "status",
        F.when(F.col("include_logs") & F.col("status").isNotNull(), F.col("incident_id"))
        .otherwise(F.concat(F.lit(UNMATCHED), F.col("answer_id").cast("string")))
        .alias("incident_id"),
    )
    statuses = incident_statuses(events) if facts is None else facts.statuses
    supported = statuses.withColumn("_supported", F.lit(True))
    return (
        claimed.join(supported, ["incident_id", "status"], "left")
        .groupBy("answer_id")
        .agg(
            F.array_sort(
                F.collect_list(F.when(F.col("_supported").isNull(), F.col("status")))
            ).alias("unsupported")
        )
        .withColumn("claims_passed", F.size("unsupported") == 0)
    )
