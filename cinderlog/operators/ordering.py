"""Positions within a group and ordered text, for groups of any size.

A plain ``row_number`` window puts a whole group into one task.  Here a group is cut along its
own order: rows are range-partitioned by (group, order), numbered inside each partition, and the
few counts per (group, partition) give every partition its starting number.  One group that
holds a third of all rows is then spread over a third of the partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.staging import broadcast_if_small, stage

# Begins the join keys of rows that are meant to match nothing.  A null key would do as well,
# but all null keys meet in one task.
UNMATCHED = "\x00"
# Place and range partition of rows that ``sort_once`` has put in order.
ORDERED = ("_slot", "_range")
# Bytes that make one part of an assembled text.
PART_BYTES = 4 * 1024 * 1024


def _in_order(frame: DataFrame, sort_keys: Sequence[Column]) -> DataFrame:
    """The rows sorted over all partitions and staged, with ``_slot`` (place) and ``_range``."""
    return stage(
        frame.repartitionByRange(*sort_keys)
        .sortWithinPartitions(*sort_keys)
        .withColumn("_slot", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_range", F.shiftright("_slot", 33))


def sort_once(frame: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows in order, staged, for several texts and numberings of the same groups.

    ``assemble`` takes the result, also filtered and with more columns, without sorting it again;
    ``with_position`` does so with ``dense``.
    """
    return _in_order(frame, _columns([*keys, *order]))


def is_sorted(frame: DataFrame) -> bool:
    """Whether the rows come from ``sort_once``."""
    return set(ORDERED) <= set(frame.columns)


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in items]


def with_position(
    frame: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    position: str = "position",
    total: str | None = None,
    dense: bool = False,
) -> DataFrame:
    """Number the rows of every group from 1 in the given order, without empty numbers.

    ``total``, if named, receives the group's row count.  The order should be unique in a
    group.  No group ever has to fit into one task.  The frame is read twice, once to find the
    range bounds, so an expensive one should be staged first.

    ``dense`` tells that the frame holds all rows of ``sort_once`` by the same keys and order, none left out:
    it is not sorted again.
    """
    if not dense:
        frame = frame.drop(*ORDERED)
    sorted_rows = frame if dense else _in_order(frame, _columns([*keys, *order]))
    runs = sorted_rows.groupBy(*keys, "_range").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    # At most one row per range partition and group goes through these windows.
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(
        runs.select(
            *keys,
            "_range",
            (F.col("_first") - 1 - F.coalesce(F.sum("_rows").over(before), F.lit(0))).alias(
                "_base"
            ),
            F.sum("_rows").over(group).alias("_total"),
        ),
        "starts",
    )
    numbered = sorted_rows.join(broadcast_if_small(starts), [*keys, "_range"])
    added = [(F.col("_slot") - F.col("_base")).alias(position)]
    if total is not None:
        added.append(F.col("_total").alias(total))
    return numbered.select(*frame.columns, *added)


def with_total_before(
    frame: DataFrame, order: Sequence[str | Column], weight: str, before: str
) -> DataFrame:
    """Add the sum of ``weight`` over all rows that come earlier in the order."""
    sorted_rows = _in_order(frame, _columns(order))
    # One row per range partition.
    sums = sorted_rows.groupBy("_range").agg(F.sum(weight).alias("_sum"))
    ranges = Window.partitionBy(F.lit(0)).orderBy("_range")
    starts = stage(
        sums.select(
            "_range",
            F.coalesce(
                F.sum("_sum").over(ranges.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ).alias("_start"),
        ),
        "starts",
    )
    # One range partition's rows at a time.
    inside = Window.partitionBy("_range").orderBy("_slot")
    earlier = F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (
        sorted_rows.withColumn("_inside", F.coalesce(earlier, F.lit(0)))
        .join(broadcast_if_small(starts), "_range")
        .select(*frame.columns, (F.col("_start") + F.col("_inside")).alias(before))
    )


def assemble(
    lines: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    text: str,
    separator: str,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Join each group's lines in order: ``(keys, part, parts, <text>)``.

    A line belongs to the part that the bytes before it fill, so a part has ``part_bytes`` and one
    line at most, at every size of the group and however the rows are dealt out.  Parts are
    numbered from 1; joining them in order, with nothing in between, gives the whole text.

    The lines are sorted and staged once, or before by ``sort_once``.  Where parts begin is found from
    their lengths alone.
    """
    if is_sorted(lines):
        placed = lines.select(*keys, text, *ORDERED)
    else:
        narrow = lines.select(*keys, *_needed(lines, keys, order, text))
        placed = _in_order(narrow, _columns([*keys, *order]))
    length = F.octet_length(text) + F.lit(len(separator.encode()))
    sizes = placed.select(*keys, "_range", "_slot", length.alias("_bytes"))
    sums = sizes.groupBy(*keys, "_range").agg(F.sum("_bytes").alias("_sum"))
    # At most one row per range partition and group goes through the first window, the lengths of one
    # range partition's rows through the second, one row per part through the third.
    ranges = Window.partitionBy(*keys).orderBy("_range")
    earlier = F.sum("_sum").over(ranges.rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*keys, "_range", F.coalesce(earlier, F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "_range").orderBy("_slot")
    upto = F.sum("_bytes").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    filled = (
        sizes.withColumn("_inside", F.coalesce(upto, F.lit(0)))
        .join(starts, [*keys, "_range"])
        .withColumn("_fill", F.floor((F.col("_start") + F.col("_inside")) / F.lit(part_bytes)))
        .groupBy(*keys, "_range", "_fill")
        .agg(F.min("_slot").alias("_from"))
    )
    by_fill = Window.partitionBy(*keys).orderBy("_fill")
    cuts = filled.withColumn("part", F.dense_rank().over(by_fill).cast("int"))
    cuts = cuts.withColumn("parts", F.max("part").over(Window.partitionBy(*keys)))
    begins = stage(
        cuts.groupBy(*keys, "_range", "parts").agg(
            F.collect_list(F.struct("_from", "part")).alias("_begins")
        ),
        "part-begins",
    )
    part = F.array_max(F.filter("_begins", lambda begin: begin["_from"] <= F.col("_slot")))["part"]
    joined = F.array_join(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_slot", F.col(text).alias("_text")))),
            lambda line: line["_text"],
        ),
        separator,
    )
    lead = F.when(F.col("part") > 1, F.lit(separator)).otherwise(F.lit(""))
    return (
        placed.join(broadcast_if_small(begins), [*keys, "_range"])
        .withColumn("part", part)
        .groupBy(*keys, "part", "parts")
        .agg(joined.alias("_joined"))
        .select(*keys, "part", "parts", F.concat(lead, "_joined").alias(text))
    )


def _needed(
    lines: DataFrame, keys: Sequence[str], order: Sequence[str | Column], text: str
) -> list[str]:
    """Columns other than the keys that numbering and joining the lines use."""
    if any(not isinstance(item, str) for item in order):
        return [name for name in lines.columns if name not in keys]
    return list(dict.fromkeys([*order, text]))


def wrap(
    groups: DataFrame,
    body: DataFrame,
    keys: Sequence[str],
    text: str,
    head: Column,
    tail: Column,
    empty: Column | None = None,
) -> DataFrame:
    """Put a head before the first and a tail after the last part of every group's text.

    A group of ``groups`` without a body comes out as one part around ``empty``.
    ``head`` and ``tail`` may use the columns of ``groups``.
    """
    joined = groups.join(body, list(keys), "left")
    middle = F.coalesce(F.col(text), empty if empty is not None else F.lit(""))
    first = F.coalesce(F.col("part"), F.lit(1)) == 1
    last = F.coalesce(F.col("part") == F.col("parts"), F.lit(True))
    return joined.select(
        *groups.columns,
        F.coalesce("part", F.lit(1)).alias("part"),
        F.coalesce("parts", F.lit(1)).alias("parts"),
        F.concat(
            F.when(first, head).otherwise(F.lit("")),
            middle,
            F.when(last, tail).otherwise(F.lit("")),
        ).alias(text),
    )
