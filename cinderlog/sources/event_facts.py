"""What answers are checked against, laid out once for all checks of an incident's answers.

Three tables of narrow rows, each in hash buckets of its key and sorted by it.  A join with the answers' labels,
statuses or incidents shuffles these, which are few, to the buckets; the event side is read in place.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.text import http_statuses
from cinderlog.operators.events import is_serious
from cinderlog.sources.staging import stage, staging_root

BUCKETS = 64
_NAMES = ("lines", "statuses", "first")


class EventFacts(NamedTuple):
    """Serious lines ``incident_id, line_number``; ``incident_id, status``; first serious line and its service."""

    lines: DataFrame
    statuses: DataFrame
    first: DataFrame


def write_event_facts(events: DataFrame, buckets: int = BUCKETS, path: str | None = None) -> EventFacts:
    """Write the facts of events and return them as tables of the session's catalog.

    ``path`` is a folder that all executors share, by default a new one in the staging folder.  The events are
    read once.  As many buckets as the shuffles of the checks have partitions, or more, let a join keep
    the buckets.
    """
    spark = events.sparkSession
    name = f"event_facts_{uuid.uuid4().hex}"
    path = path or f"{staging_root(spark)}/{name}"
    narrow = stage(
        events.select(
            "incident_id",
            "ts",
            "line_number",
            "service",
            is_serious().alias("_serious"),
            F.array_join(http_statuses(F.col("message")), ",").alias("_statuses"),
        ),
        "event-facts",
    )
    grave = narrow.where("_serious")
    lines = grave.select("incident_id", "line_number").distinct()
    each = narrow.where("_statuses <> ''").select("incident_id", F.explode(F.split("_statuses", ",")).alias("status"))
    first = grave.groupBy("incident_id").agg(F.min(F.struct("ts", "line_number", "service")).alias("_first")).select(
        "incident_id", "_first.line_number", "_first.service"
    )
    tables = (
        (lines, ("incident_id", "line_number")),
        (each.distinct(), ("incident_id", "status")),
        (first, ("incident_id",)),
    )
    return EventFacts(
        *(_write(rows, keys, buckets, f"{name}_{kind}", f"{path}/{kind}") for kind, (rows, keys) in zip(_NAMES, tables))
    )


def _write(rows: DataFrame, keys: Sequence[str], buckets: int, name: str, path: str) -> DataFrame:
    (
        rows.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(name)
    )
    return rows.sparkSession.table(name)
