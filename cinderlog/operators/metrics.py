"""Incident metrics, impact score, distributions and the failure chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions import times
from cinderlog.operators.events import EVENT_ORDER, is_serious, level_rank, serious
from cinderlog.operators.ordering import with_position


def service_totals(events: DataFrame) -> DataFrame:
    """One row per incident and service: the common base of all incident aggregates.

    Distinct services become a plain row count one level up, which spares the row expansion of
    several ``count(distinct)`` and lets a busy incident combine on the map side.
    """
    weight = F.lit(0)
    for level, points in fixed.LEVEL_WEIGHTS.items():
        if points:
            weight = F.when(F.col("level") == level, F.lit(points)).otherwise(weight)
    return events.groupBy("incident_id", "service").agg(
        F.count("level").alias("events"),
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") == "CRITICAL").alias("critical"),
        F.count_if(is_serious()).alias("serious"),
        F.sum(weight).alias("severity_points"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
    )


def _keep_all(result: DataFrame, incidents: DataFrame | None) -> DataFrame:
    if incidents is None:
        return result
    return incidents.select("incident_id").distinct().join(result, "incident_id", "left")


def incident_metrics(events: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Events, errors, criticals, services and whole seconds from first to last event.

    With ``incidents`` given, incidents without any event are kept with zero counts.
    """
    return metrics_of_totals(service_totals(events), incidents)


def metrics_of_totals(totals: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """``incident_metrics`` from the ``service_totals`` of the events."""
    totals = totals.groupBy("incident_id").agg(
        F.sum("events").alias("events"),
        F.sum("errors").alias("errors"),
        F.sum("critical").alias("critical"),
        F.count("service").alias("services"),
        F.timestamp_diff("SECOND", F.min("started_at"), F.max("ended_at")).alias(
            "duration_seconds"
        ),
    )
    counts = ("events", "errors", "critical", "services", "duration_seconds")
    return _keep_all(totals, incidents).select(
        "incident_id", *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in counts)
    )


def impact_label(score: Column) -> Column:
    label = F.lit(fixed.IMPACT_LABELS[-1][1])
    for lowest, name in reversed(fixed.IMPACT_LABELS[:-1]):
        label = F.when(score >= lowest, F.lit(name)).otherwise(label)
    return label


def impact_scores(events: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """Explainable 0-100 score: severity points plus spread over services."""
    return scores_of_totals(service_totals(events), incidents)


def scores_of_totals(totals: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """``impact_scores`` from the ``service_totals`` of the events."""
    totals = totals.groupBy("incident_id").agg(
        F.sum("serious").alias("serious"),
        F.count_if(F.col("serious") > 0).alias("affected_services"),
        F.sum("severity_points").alias("severity_points"),
    )
    spread = F.greatest(F.col("affected_services") - 1, F.lit(0)) * fixed.SPREAD_WEIGHT
    scored = totals.withColumn("spread_points", spread).withColumn(
        "score",
        F.least(F.col("severity_points") + F.col("spread_points"), F.lit(fixed.SCORE_CEILING)),
    )
    numbers = ("serious", "affected_services", "severity_points", "spread_points")
    explained = scored.select(
        "incident_id",
        "score",
        impact_label(F.col("score")).alias("label"),
        F.format_string(fixed.IMPACT_EXPLANATION, *numbers).alias("explanation"),
        *numbers,
    )
    return _keep_all(explained, incidents).select(
        "incident_id",
        F.coalesce("score", F.lit(0)).alias("score"),
        F.coalesce("label", F.lit(fixed.NO_EVENTS_LABEL)).alias("label"),
        F.coalesce("explanation", F.lit(fixed.NO_EVENTS_EXPLANATION)).alias("explanation"),
        *(F.coalesce(F.col(name), F.lit(0)).alias(name) for name in numbers),
    )


def merged_totals(totals: DataFrame) -> DataFrame:
    """``service_totals`` of all events from those of parts of them."""
    sums = ("events", "errors", "critical", "serious", "severity_points")
    return totals.groupBy("incident_id", "service").agg(
        *(F.sum(name).alias(name) for name in sums),
        F.min("started_at").alias("started_at"),
        F.max("ended_at").alias("ended_at"),
    )


def level_counts(events: DataFrame) -> DataFrame:
    """Events per level; ``severity`` is the level's position in severity order."""
    return (
        events.groupBy("incident_id", "level")
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("severity", level_rank(F.col("level")))
    )


def level_chart(events: DataFrame) -> DataFrame:
    return level_counts(events).orderBy("incident_id", "severity")


def service_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("incident_id", "service").agg(F.count(F.lit(1)).alias("events"))


def service_chart(events: DataFrame) -> DataFrame:
    return service_counts(events).orderBy("incident_id", "events", "service")


def levels_present(events: DataFrame) -> DataFrame:
    """The choices of the severity filter."""
    return level_counts(events).select("incident_id", "level", "severity")


def failure_chain(events: DataFrame) -> DataFrame:
    """Serious events in event order, with step number and an ``END`` mark on the last."""
    steps = with_position(
        serious(events).select("incident_id", "ts", "line_number", "service", "level", "message"),
        ["incident_id"],
        EVENT_ORDER,
        "step",
        "steps",
    )
    return steps.select(
        "incident_id",
        "step",
        times.clock_text(F.col("ts")).alias("time"),
        "service",
        "level",
        "message",
        "line_number",
        F.when(F.col("step") == F.col("steps"), "END").otherwise("->").alias("marker"),
    )


def first_seen(events: DataFrame) -> DataFrame:
    """First serious event of every service of an incident; pre-aggregated on the map side."""
    first = F.min(F.struct("ts", "line_number", "message"))
    return (
        serious(events)
        .groupBy("incident_id", "service")
        .agg(first.alias("first"))
        .select("incident_id", "service", "first.*")
    )


def first_serious(events: DataFrame) -> DataFrame:
    """First serious event of every incident."""
    first = F.min(F.struct("ts", "line_number", "service"))
    return (
        serious(events)
        .groupBy("incident_id")
        .agg(first.alias("first"))
        .select("incident_id", "first.line_number", "first.service")
    )


def event_window(events: DataFrame) -> DataFrame:
    """Event count with first and last time of every incident."""
    return events.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        times.iso_text(F.min("ts")).alias("started_at"),
        times.iso_text(F.max("ts")).alias("ended_at"),
    )
