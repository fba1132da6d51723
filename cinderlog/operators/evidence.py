"""Evidence texts: the incident query, log evidence and runbook evidence.

Texts over an incident's events come in parts (see ``ordering.assemble``): one part for any
incident of usual size, more for a huge one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions import times
from cinderlog.operators.events import EVENT_ORDER, serious
from cinderlog.operators.ordering import PART_BYTES, assemble


def incident_queries(events: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Search text of every incident: ``service: message`` lines of its serious events."""
    lines = serious(events).withColumn("query", F.concat_ws(": ", "service", "message"))
    return assemble(lines, ["incident_id"], EVENT_ORDER, "query", "\n", part_bytes)


def evidence_line() -> Column:
    return F.concat(
        F.format_string("[L%d] ", "line_number"),
        times.iso_text(F.col("ts")),
        F.lit(" "),
        F.col("level"),
        F.lit(" "),
        F.col("service"),
        F.lit(": "),
        F.col("message"),
    )


def log_evidence(events: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``[L#] time level service: message`` lines of every incident's serious events."""
    lines = serious(events).withColumn("evidence", evidence_line())
    return assemble(lines, ["incident_id"], EVENT_ORDER, "evidence", "\n", part_bytes)


def runbook_evidence(evidence: DataFrame, key: str) -> DataFrame:
    """``[R#] Source …`` blocks of the few matched chunks per ``key``, best first."""
    block = F.format_string(
        "[R%d] Source: %s, section: %s\n%s", "rank", "source", "heading", "content"
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"))))
    return evidence.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda item: item["block"]), "\n\n").alias(
            "runbook_evidence"
        ),
        F.count(F.lit(1)).alias("chunks"),
    )
