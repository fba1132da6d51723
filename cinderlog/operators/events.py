"""Log lines to events: parsing, rejects, redaction, filters and projections."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions import parsing, text, times
from cinderlog.functions.stages import pinned

EVENT_ORDER = ("ts", "line_number")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse ``(incident_id, line_number, raw_line)`` rows; narrow, no shuffle.

    Blank lines vanish.  Every other line comes out once with ``status`` ``event`` or
    ``rejected``; the event fields of a rejected line are null.  Further input columns are
    carried along.
    """
    line = F.col("raw_line")
    fields = tuple(fixed.JSON_FIELDS)
    steps = lines.filter(text.strip_start(line) != "")
    steps = steps.withColumn("_braced", parsing.looks_like_json(line))
    steps = steps.withColumns(
        {
            "_pair": F.when(F.col("_braced"), parsing.json_pair(line)),
            "_marked": F.when(~F.col("_braced"), parsing.marked_groups(line)),
        }
    )
    steps = steps.withColumns(
        {
            "_json": parsing.json_object(line, F.col("_pair")),
            "_parts": parsing.plain_parts(line, F.col("_marked")),
        }
    )
    steps = steps.withColumns(
        {f"_{name}": parsing.json_field(F.col("_json"), name) for name in fields}
    )
    steps = steps.withColumns({f"_{name}": parsing.json_text(F.col(f"_{name}")) for name in fields})
    steps = steps.withColumn("_timestamp", times.without_zone(F.col("_timestamp")))
    is_json = F.col("_json").isNotNull()

    def either(name: str, group: int) -> Column:
        return F.when(is_json, F.col(f"_{name}")).otherwise(F.get(F.col("_parts"), F.lit(group)))

    steps = steps.withColumns(
        {
            "_ts": F.when(is_json, times.parse_iso_time(F.col("_timestamp"))).otherwise(
                times.parse_log_time(F.get(F.col("_parts"), F.lit(1)))
            ),
            "_level": parsing.normalize_level(either("level", 2)),
            "_service": either("service", 3),
            "_message": either("message", 4),
        }
    )
    # Only a JSON line can have a blank service, and only there a blank message is refused.
    worded = (text.strip_start(F.col("_service")) != "") & (
        text.strip_start(F.col("_message")) != ""
    )
    complete = (
        F.col("_ts").isNotNull()
        & F.col("_level").isNotNull()
        & F.col("_message").isNotNull()
        & (~is_json | worded)
    )
    steps = steps.withColumn("_complete", F.coalesce(complete, F.lit(False)))

    def if_complete(name: str) -> Column:
        return F.when(F.col("_complete"), F.col(name))

    return pinned(
        steps.select(*lines.columns, "_complete", "_ts", "_level", "_service", "_message"),
        {
            "status": F.when(F.col("_complete"), "event").otherwise("rejected"),
            "ts": if_complete("_ts"),
            "level": if_complete("_level"),
            "service": if_complete("_service"),
            "message": if_complete("_message"),
        },
    ).drop("_complete", "_ts", "_level", "_service", "_message")


def events_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") == "event").drop("status")


def rejected_of(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("status") == "rejected").select(
        "incident_id", "line_number", "raw_line"
    )


def in_event_order(events: DataFrame) -> DataFrame:
    return events.orderBy("incident_id", *EVENT_ORDER)


def require_no_rejects(parsed: DataFrame) -> DataFrame:
    """The events, failing the job at the first rejected line."""
    checked = parsed.withColumn(
        "status",
        F.when(
            F.col("status") == "rejected",
            F.raise_error(
                F.concat(
                    F.lit("rejected log line "),
                    F.col("line_number").cast("string"),
                    F.lit(" in "),
                    F.col("incident_id"),
                )
            ),
        ).otherwise(F.col("status")),
    )
    return events_of(checked)


def rejected_counts(parsed: DataFrame) -> DataFrame:
    return parsed.groupBy("incident_id").agg(
        F.count_if(F.col("status") == "rejected").alias("rejected")
    )


def redact_columns(frame: DataFrame, columns: Iterable[str], counts: str) -> DataFrame:
    """Mask e-mail addresses, IPv4-shaped numbers, bearer tokens, tokens and secrets.

    Every pattern works on the output of the one before.  ``counts`` becomes the largest
    number of replacements made in one of the columns.

    A pattern only runs on texts that hold the literals it cannot match without, and its matches
    are only counted where the text changed or already held a mask.
    """
    names = list(columns)
    staged = frame.withColumns(
        {
            **{f"_{name}_0": F.col(name) for name in names},
            **{f"_{name}_lower": F.lower(name) for name in names},
        }
    )
    staged = staged.withColumns(
        {
            f"_{name}_may_{step}": _may_match(F.col(f"_{name}_lower"), needed)
            for name in names
            for step, needed in enumerate(fixed.REDACTION_LITERALS, start=1)
        }
    )
    for step, (pattern, replacement) in enumerate(fixed.REDACTIONS, start=1):
        staged = staged.withColumns(
            {
                f"_{name}_{step}": F.when(
                    F.col(f"_{name}_may_{step}"),
                    F.regexp_replace(f"_{name}_{step - 1}", pattern, replacement),
                ).otherwise(F.col(f"_{name}_{step - 1}"))
                for name in names
            }
        )

    def replacements(name: str) -> Column:
        total = F.lit(0)
        for step, (pattern, _) in enumerate(fixed.REDACTIONS, start=1):
            before, after = F.col(f"_{name}_{step - 1}"), F.col(f"_{name}_{step}")
            touched = (before != after) | F.contains(before, F.lit(fixed.REDACTION_MARK))
            counted = F.when(
                F.col(f"_{name}_may_{step}") & touched, F.regexp_count(before, F.lit(pattern))
            )
            total = total + counted.otherwise(0)
        return total

    last = len(fixed.REDACTIONS)
    totals = [replacements(name) for name in names]
    masked = {name: F.col(f"_{name}_{last}") for name in names}
    masked[counts] = F.greatest(*totals) if len(totals) > 1 else totals[0]
    order = [*frame.columns, *([] if counts in frame.columns else [counts])]
    return pinned(staged, masked).select(*order)


def _may_match(lowered: Column, needed: Iterable[Iterable[str]]) -> Column:
    """Whether the text holds at least one literal of every group."""
    tests = [text.contains_any(lowered, literals) for literals in needed]
    return reduce(lambda left, right: left & right, tests)


def redact_events(events: DataFrame, enabled: bool = True) -> DataFrame:
    """Mask message and raw line; ``redactions`` is the larger of the two counts.

    The service and rejected lines are left as they are.
    """
    if not enabled:
        return events.withColumn("redactions", F.lit(0))
    return redact_columns(events, ("message", "raw_line"), "redactions")


def redaction_totals(redacted: DataFrame) -> DataFrame:
    return redacted.groupBy("incident_id").agg(F.sum("redactions").alias("redactions"))


def is_serious(level: Column | str = "level") -> Column:
    column = F.col(level) if isinstance(level, str) else level
    return column.isin(*fixed.SERIOUS_LEVELS)


def serious(events: DataFrame) -> DataFrame:
    return events.filter(is_serious())


def with_levels(events: DataFrame, levels: Iterable[str]) -> DataFrame:
    """The severity filter of the timeline."""
    return events.filter(F.col("level").isin(*levels))


def level_rank(level: Column) -> Column:
    """Position of a level in severity order, from 1; unknown levels come last."""
    found = F.array_position(F.array(*(F.lit(name) for name in fixed.LEVELS)), level)
    return F.when(found == 0, F.lit(len(fixed.LEVELS) + 1)).otherwise(found)


def event_frame(events: DataFrame) -> DataFrame:
    return events.select(
        "incident_id",
        F.col("ts").alias("Time"),
        F.col("level").alias("Level"),
        F.col("service").alias("Service"),
        F.col("message").alias("Message"),
        F.col("line_number").alias("Line"),
    )


def timeline(events: DataFrame, levels: Iterable[str] | None = None) -> DataFrame:
    shown = events if levels is None else with_levels(events, levels)
    return event_frame(shown).withColumn("Time", times.short_text(F.col("Time")))


def verified_evidence(events: DataFrame) -> DataFrame:
    return serious(events).select(
        "incident_id",
        F.concat(F.lit("L"), F.col("line_number").cast("string")).alias("Evidence"),
        times.second_text(F.col("ts")).alias("Time"),
        F.col("level").alias("Level"),
        F.col("service").alias("Service"),
        F.col("message").alias("Message"),
    )
