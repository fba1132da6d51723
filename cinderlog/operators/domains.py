"""Domain detection and question/incident alignment."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.stages import pinned
from cinderlog.functions.text import count_occurrences, needs_log_context
from cinderlog.operators.events import serious


def domain_hits(lowered: Column) -> list[Column]:
    """Keyword occurrences in lower-case text, one column per domain."""
    return [
        reduce(add, (count_occurrences(lowered, keyword) for keyword in keywords))
        for keywords in fixed.DOMAIN_KEYWORDS.values()
    ]


def strongest(hits: list[Column]) -> Column:
    """Domain with most hits, the earlier one on a tie; null when nothing was found."""
    most = F.greatest(*hits)
    names = list(fixed.DOMAIN_KEYWORDS)
    chosen = F.when(hits[0] == most, F.lit(names[0]))
    for hit, name in zip(hits[1:], names[1:]):
        chosen = chosen.when(hit == most, F.lit(name))
    return F.when(most > 0, chosen)


_HITS = [f"_hits_{number}" for number in range(len(fixed.DOMAIN_KEYWORDS))]


def incident_domains(events: DataFrame) -> DataFrame:
    """Domain of every incident's serious events.

    No keyword spans two events, so counts per event add up to the count over the joined text,
    which is never built.
    """
    texts = serious(events).select(
        "incident_id", F.lower(F.concat_ws(" ", "service", "message")).alias("_text")
    )
    sums = (
        texts.select(
            "incident_id",
            *(hit.alias(name) for hit, name in zip(domain_hits(F.col("_text")), _HITS)),
        )
        .groupBy("incident_id")
        .agg(*(F.sum(name).alias(name) for name in _HITS))
    )
    total = reduce(add, (F.col(name) for name in _HITS))
    return sums.select(
        "incident_id",
        strongest([F.col(name) for name in _HITS]).alias("incident_domain"),
        total.alias("domain_hits"),
    )


def question_domains(questions: DataFrame) -> DataFrame:
    """Add ``needs_logs`` and ``question_domain``; a definition question has no domain."""
    staged = questions.withColumn("_text", F.lower("question"))
    staged = staged.withColumns(dict(zip(_HITS, domain_hits(F.col("_text")))))
    staged = staged.withColumn("_needs", needs_log_context(F.col("question")))
    domain = strongest([F.col(name) for name in _HITS])
    return pinned(
        staged,
        {
            "needs_logs": F.col("_needs"),
            "question_domain": F.when(F.col("_needs"), domain),
        },
    ).select(*questions.columns, "needs_logs", "question_domain")


def assess_alignment(questions: DataFrame, events: DataFrame) -> DataFrame:
    """Add ``needs_logs``, both domains and ``aligned`` to questions with an ``incident_id``."""
    joined = question_domains(questions).join(
        incident_domains(events).select("incident_id", F.col("incident_domain").alias("_domain")),
        "incident_id",
        "left",
    )
    return joined.select(
        *questions.columns,
        "needs_logs",
        "question_domain",
        F.when(F.col("needs_logs"), F.col("_domain")).alias("incident_domain"),
        (
            ~F.col("needs_logs")
            | F.col("question_domain").isNull()
            | F.col("_domain").isNull()
            | F.coalesce(F.col("question_domain") == F.col("_domain"), F.lit(False))
        ).alias("aligned"),
    )
