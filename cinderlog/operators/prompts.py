"""Prompt tables: ``part`` of ``parts``, to be joined in order without a separator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import needs_log_context, strip
from cinderlog.operators.evidence import log_evidence, runbook_evidence
from cinderlog.operators.ordering import PART_BYTES, UNMATCHED, wrap


def analysis_prompts(
    events: DataFrame, evidence: DataFrame, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One analysis prompt per incident.

    ``evidence`` holds the matched chunks with ``incident_id`` and ``rank``.
    """
    runbooks = runbook_evidence(evidence, "incident_id")
    incidents = events.select("incident_id").distinct().join(runbooks, "incident_id", "left")
    tail = F.concat(
        F.lit(fixed.ANALYSIS_PROMPT_MIDDLE),
        F.coalesce("runbook_evidence", F.lit("")),
        F.lit(fixed.ANALYSIS_PROMPT_TAIL),
    )
    logs = log_evidence(events, part_bytes).withColumnRenamed("evidence", "prompt")
    return wrap(
        incidents, logs, ["incident_id"], "prompt", F.lit(fixed.ANALYSIS_PROMPT_HEAD), tail
    ).select(
        "incident_id",
        "part",
        "parts",
        F.lit(fixed.ANALYSIS_SYSTEM_PROMPT).alias("system"),
        "prompt",
    )


def qa_frames(
    questions: DataFrame, evidence: DataFrame, name: str = fixed.ASSISTANT_NAME
) -> DataFrame:
    """What stands around the log evidence in the prompt of each question.

    ``(question_id, incident_id, system, head, evidence_of, without_evidence, tail)`` for questions
    ``(question_id, incident_id, question)``.  The prompt is the head, the parts of the evidence of
    incident ``evidence_of`` (see ``evidence.log_evidence``) or else ``without_evidence``, and the tail.
    Evidence is kept once per incident and met when a prompt is sent, so that these rows grow with
    the questions alone.

    A definition question gets no log evidence and other instructions.  ``evidence`` holds the
    matched chunks with ``question_id`` and ``rank``.
    """
    asked = (
        questions.select("question_id", "incident_id", "question")
        .withColumn("_needs", needs_log_context(F.col("question")))
        .join(runbook_evidence(evidence, "question_id"), "question_id", "left")
    )
    needs = F.col("_needs")
    head = F.concat(
        F.lit(fixed.QA_PROMPT_QUESTION),
        strip(F.col("question")),
        F.lit(fixed.QA_PROMPT_SCOPE),
        F.when(needs, fixed.QA_INCIDENT_SCOPE).otherwise(fixed.QA_DEFINITION_SCOPE),
        F.lit(fixed.QA_PROMPT_LOGS),
    )
    tail = F.concat(
        F.lit(fixed.QA_PROMPT_RUNBOOKS),
        F.coalesce("runbook_evidence", F.lit("")),
        F.lit(fixed.QA_PROMPT_TAIL),
    )
    return asked.select(
        "question_id",
        "incident_id",
        F.lit(fixed.QA_SYSTEM_PROMPT % name).alias("system"),
        head.alias("head"),
        F.when(needs, F.col("incident_id")).alias("evidence_of"),
        F.when(needs, fixed.QA_NO_SERIOUS_EVENTS)
        .otherwise(fixed.QA_NO_LOGS)
        .alias("without_evidence"),
        tail.alias("tail"),
    )


def qa_prompts(
    questions: DataFrame,
    events: DataFrame,
    evidence: DataFrame,
    name: str = fixed.ASSISTANT_NAME,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Whole prompts of the questions that are sent together, in parts.

    Every question repeats its incident's evidence; for many questions keep ``qa_frames`` and
    the evidence apart until they are sent.
    """
    # Frames that need no evidence get keys of their own, which match nothing and spread over
    # all tasks.
    asked = qa_frames(questions, evidence, name).withColumn(
        "_log_key",
        F.coalesce("evidence_of", F.concat(F.lit(UNMATCHED), F.col("question_id").cast("string"))),
    )
    logs = log_evidence(events, part_bytes).select(
        F.col("incident_id").alias("_log_key"), "part", "parts", F.col("evidence").alias("prompt")
    )
    return wrap(
        asked, logs, ["_log_key"], "prompt", F.col("head"), F.col("tail"), F.col("without_evidence")
    ).select("question_id", "incident_id", "part", "parts", "system", "prompt")
