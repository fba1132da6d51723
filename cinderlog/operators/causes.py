"""Rule-based cause detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import contains_any
from cinderlog.operators.events import EVENT_ORDER

Rule = tuple[str, str, Sequence[str]]
CITATIONS = 3


def _pick(rule: Column, values: Sequence[str]) -> Column:
    """Value of a rule number; rules are constants, so this is a CASE and not a join."""
    picked = F.when(rule == 0, F.lit(values[0]))
    for number, value in enumerate(values[1:], start=1):
        picked = picked.when(rule == number, F.lit(value))
    return picked


def _rules_hit(events: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Events with ``_hits``, the array of the rules whose keywords occur in the message."""
    message = F.col("_message")
    hits = F.array_compact(
        F.array(
            *(
                F.when(contains_any(message, keywords), F.lit(number))
                for number, (_, _, keywords) in enumerate(rules)
            )
        )
    )
    lowered = events.select("incident_id", *EVENT_ORDER, F.lower("message").alias("_message"))
    return lowered.select("incident_id", *EVENT_ORDER, hits.alias("_hits"))


def rule_matches(events: DataFrame, rules: Sequence[Rule] = fixed.CAUSE_RULES) -> DataFrame:
    """One row per event and rule whose keywords occur in its message, at any level."""
    return _rules_hit(events, rules).select(
        "incident_id", *EVENT_ORDER, F.explode("_hits").alias("rule")
    )


def detect_causes(events: DataFrame, rules: Sequence[Rule] = fixed.CAUSE_RULES) -> DataFrame:
    """The rule with most matching events per incident, with up to three citations.

    An event counts once per rule; the earlier rule wins a tie.  Incidents without a match
    come out with a null ``source`` and low confidence.  Counts and first matches are both
    reduced on the map side, so no task holds an incident's events.  The events are read twice.
    """
    # Events without a match count under the null rule, which keeps their incident.
    counts = (
        _rules_hit(events, rules)
        .select("incident_id", F.explode_outer("_hits").alias("rule"))
        .groupBy("incident_id", "rule")
        .agg(F.count("rule").alias("matches"))
    )
    # Most matches first and, among equals, the earlier rule: one number per rule.
    weight = F.col("matches") * len(rules) + (len(rules) - 1 - F.col("rule"))
    best = (
        counts.groupBy("incident_id")
        .agg(F.max(weight).alias("_weight"))
        .select(
            "incident_id",
            F.floor(F.col("_weight") / len(rules)).alias("matches"),
            (len(rules) - 1 - F.col("_weight") % len(rules)).alias("rule"),
        )
    )
    early = Window.partitionBy("incident_id", "rule").orderBy(*EVENT_ORDER)
    citations = (
        rule_matches(events, rules)
        .withColumn("_rank", F.row_number().over(early))
        .filter(F.col("_rank") <= CITATIONS)
        .groupBy("incident_id", "rule")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_rank", "line_number"))),
                    lambda item: F.format_string("[L%d]", item["line_number"]),
                ),
                " ",
            ).alias("citations")
        )
    )
    found = best.join(citations, ["incident_id", "rule"], "left")
    return found.select(
        "incident_id",
        F.coalesce(
            _pick(F.col("rule"), [rule[0] for rule in rules]), F.lit(fixed.UNKNOWN_CAUSE)
        ).alias("cause"),
        _pick(F.col("rule"), [rule[1] for rule in rules]).alias("source"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.coalesce("citations", F.lit(fixed.UNKNOWN_CAUSE_CITATION)).alias("citations"),
        cause_confidence(F.coalesce("matches", F.lit(0))).alias("confidence"),
    )


def cause_confidence(matches: Column) -> Column:
    return F.when(matches == 0, "Low").when(matches >= 2, "High").otherwise("Medium")
