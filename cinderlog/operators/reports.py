"""Quick reports, incident signatures and the report table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions import times
from cinderlog.operators.causes import detect_causes
from cinderlog.operators.events import EVENT_ORDER
from cinderlog.operators.metrics import event_window, first_seen
from cinderlog.operators.ordering import (
    ORDERED,
    PART_BYTES,
    assemble,
    is_sorted,
    with_position,
    wrap,
)
from cinderlog.schemas import REPORTS
from cinderlog.sources.staging import broadcast_if_small, measured_bytes, stage

# Lines, and digests of them, that one digest of a signature covers.
SIGNATURE_LINES = 1_000
# Report rows of a batch whose new signatures are numbered by one task.
ONE_TASK_BYTES = 8 * 1024 * 1024
FALLBACK_CHUNKS = 2


def action_chunks(index: DataFrame) -> DataFrame:
    """The chunks of every source that a report lists as actions, ranked from 1.

    Action sections where a source has any, else its first two chunks.  Action headings are
    unique in a source up to letter case, so only a few rows per source reach a window.
    """
    is_action = F.lower("heading").isin(*fixed.ACTION_HEADINGS)
    by_id = Window.partitionBy("source").orderBy("id")
    actions = index.filter(is_action).select("source", "id", "heading", "content")
    first = (
        index.select("source", "id", "heading", "content")
        .withColumn("_first", F.row_number().over(by_id))
        .filter(F.col("_first") <= FALLBACK_CHUNKS)
        .drop("_first")
        .join(actions.select("source").distinct(), "source", "left_anti")
    )
    return actions.unionByName(first).withColumn("rank", F.row_number().over(by_id))


def action_texts(index: DataFrame) -> DataFrame:
    """``(source, actions)``: one Markdown list per source, built once for all incidents."""
    line = F.format_string("- **%s:** %s [R%d]", "heading", "content", "rank")
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return (
        action_chunks(index)
        .groupBy("source")
        .agg(F.array_join(F.transform(ordered, lambda item: item["line"]), "\n").alias("actions"))
    )


def quick_reports(
    events: DataFrame,
    index: DataFrame,
    name: str = fixed.ASSISTANT_NAME,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Markdown report of every incident: ``(incident_id, part, parts, analysis_markdown)``."""
    sources = [rule[1] for rule in fixed.CAUSE_RULES]
    actions = action_texts(index.filter(F.col("source").isin(*sources)))
    # At most one row per rule.  A shuffle join would bring all incidents of one cause together.
    texts = broadcast_if_small(stage(actions, "actions"))
    incidents = detect_causes(events).join(texts, "source", "left")
    line = F.concat(
        F.format_string("- **%s — %s:** ", times.clock_text(F.col("ts")), "service"),
        "message",
        F.format_string(" [L%d]", "line_number"),
    )
    propagation = assemble(
        first_seen(events).withColumn("analysis_markdown", line),
        ["incident_id"],
        EVENT_ORDER,
        "analysis_markdown",
        "\n",
        part_bytes,
    )
    head = F.format_string(fixed.REPORT_HEAD, F.lit(name), "cause", "citations", "cause", "citations")
    tail = F.concat(
        F.lit(fixed.REPORT_ACTIONS),
        F.coalesce("actions", F.lit(fixed.REPORT_NO_ACTIONS)),
        F.format_string(fixed.REPORT_TAIL, "confidence"),
    )
    return wrap(incidents, propagation, ["incident_id"], "analysis_markdown", head, tail).select(
        "incident_id", "part", "parts", "analysis_markdown"
    )


def signatures(events: DataFrame, source_name: Column) -> DataFrame:
    """``(incident_id, source_name, signature)`` over the name and all raw lines in event order.

    Every ``SIGNATURE_LINES`` lines give a SHA-256 digest of the lines, every ``SIGNATURE_LINES`` of these
    digests one of theirs, and the signature is the SHA-256 over the name and the latter.  The
    rule is the same for an incident of any size, and no task has to hold one whole.

    Events that ``ordering.sort_once`` has put in order, all of them, are not sorted again; ``source_name`` then
    is one for each incident.
    """
    named = events.withColumn("source_name", source_name)
    keys = ["incident_id", "source_name"]
    dense = is_sorted(events)
    narrow = named.select(*keys, *EVENT_ORDER, "raw_line", *(ORDERED if dense else ()))
    rows = with_position(narrow, keys, EVENT_ORDER, "_place", dense=dense)
    digests = rows.select(
        *keys, (F.col("_place") - 1).alias("_place"), F.col("raw_line").alias("_text")
    )
    for _ in range(2):
        block = F.floor(F.col("_place") / F.lit(SIGNATURE_LINES)).alias("_block")
        digests = (
            digests.groupBy(*keys, block)
            .agg(F.sha2(_in_line(), 256).alias("_text"))
            .withColumnRenamed("_block", "_place")
        )
    payload = F.concat_ws("\n", "source_name", "_payload")
    return (
        digests.groupBy(*keys)
        .agg(_in_line().alias("_payload"))
        .select(*keys, F.sha2(payload, 256).alias("signature"))
    )


def _in_line() -> Column:
    """The texts of a block joined by line feeds, in order of place."""
    ordered = F.array_sort(F.collect_list(F.struct("_place", "_text")))
    return F.array_join(F.transform(ordered, lambda item: item["_text"]), "\n")


def report_rows(
    events: DataFrame, analyses: DataFrame, created_at: Column, source_name: Column
) -> DataFrame:
    """Report rows without id of incidents with events, one for each part of an analysis.

    ``analyses`` has ``incident_id`` and ``analysis_markdown``, and ``part`` if a text may have
    several; incidents without events have no row here and so cannot be saved.
    """
    part = F.col("part").cast("int") if "part" in analyses.columns else F.lit(1)
    texts = analyses.select("incident_id", part.alias("part"), "analysis_markdown")
    return (
        signatures(events, source_name)
        .join(event_window(events), "incident_id")
        .join(texts, "incident_id")
        .select(
            "incident_id",
            "signature",
            "part",
            "source_name",
            created_at.alias("created_at"),
            "event_count",
            "started_at",
            "ended_at",
            "analysis_markdown",
        )
    )


def utc_now() -> Column:
    """Current UTC time as ISO text in whole seconds."""
    now = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.localtimestamp()
    )
    return F.concat(F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def latest_per_signature(rows: DataFrame) -> DataFrame:
    """The rows of one incident for each signature: the last by time, then by incident id.

    Incidents of one name and with the same lines share a signature, such as a file that came from two
    hosts.  Rows that repeat a part as well are reduced to the greatest text.
    """
    chosen = rows.groupBy("signature").agg(
        F.max(F.struct("created_at", "incident_id")).alias("_last")
    )
    own = F.struct("created_at", "incident_id").eqNullSafe(F.col("_last"))
    facts = [name for name in REPORTS.fieldNames() if name not in ("id", "analysis_markdown")]
    return (
        rows.join(chosen, "signature")
        .where(own)
        .groupBy(*facts)
        .agg(F.max("analysis_markdown").alias("analysis_markdown"))
    )


def upsert_reports(reports: DataFrame, rows: DataFrame, highest: int | None = None) -> DataFrame:
    """Merge report rows by signature.  Both frames are read more than once.

    A report is all rows of a signature, one for each part of its text, under one id.  A known
    signature keeps its id, counts and window and takes the new time and text, with as many parts as the new
    text has; a new one gets the next free id after ``highest`` (the table's own if not given), in
    order of name and signature.  A batch of ``ONE_TASK_BYTES`` at most is numbered by one task, a larger one by
    ranges, with the same ids.  Of several rows for one signature and part one counts, see
    ``latest_per_signature``.
    """
    latest = stage(latest_per_signature(rows), "latest-reports")
    known = reports.where("part = 1").select(
        "signature",
        "id",
        *(F.col(name).alias(f"_{name}") for name in ("event_count", "started_at", "ended_at")),
    )
    heads = latest.where("part = 1").select("signature", "source_name")
    fresh = heads.join(known, "signature", "left_anti")
    if highest is None:
        highest = reports.agg(F.max("id")).first()[0] or 0
    in_order = ["source_name", "signature"]
    size = measured_bytes(latest)
    if size is not None and size <= ONE_TASK_BYTES:
        numbered = fresh.withColumn("_number", F.row_number().over(Window.orderBy(*in_order)))
    else:
        numbered = with_position(fresh, [], in_order, "_number")
    numbered = numbered.select("signature", (F.col("_number") + F.lit(highest)).alias("id"))
    ids = known.select("signature", "id").unionByName(numbered)
    kept = reports.join(heads, "signature", "left_anti")
    facts = known.drop("id")
    written = (
        latest.join(ids, "signature")
        .join(facts, "signature", "left")
        .withColumns(
            {
                name: F.coalesce(f"_{name}", name)
                for name in ("event_count", "started_at", "ended_at")
            }
        )
    )
    columns = REPORTS.fieldNames()
    return kept.select(*columns).unionByName(written.select(*columns))


def recent_reports(reports: DataFrame, limit: int = 10) -> DataFrame:
    """The latest ``limit`` reports with all their parts, newest first."""
    newest = F.col("created_at").desc(), F.col("id").desc()
    heads = reports.where("part = 1").select("created_at", "id").orderBy(*newest).limit(limit)
    # A bounded list of ids.
    chosen = F.broadcast(heads.select("id"))
    return reports.join(chosen, "id", "left_semi").drop("signature").orderBy(*newest, "part")
