"""Log file sources: ``(incident_id, source_name, line_number, raw_line)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.sources.staging import broadcast_if_small, stage


def read_log_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of UTF-8 text files, numbered from 1 within each file, blank lines included.

    Files are split into blocks as usual.  A line's number is its place in its block plus the
    lines of the blocks before it.  The lines are read and staged in one pass, together with
    their block and place, and numbered from that table: how a later job would split the files
    does not matter.  Only the line counts per block are shuffled.  Each file is an incident,
    named by its path.
    """
    blocks = stage(
        spark.read.text(paths if isinstance(paths, str) else list(paths)).select(
            F.col("_metadata.file_path").alias("incident_id"),
            F.col("_metadata.file_name").alias("source_name"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.make_valid_utf8("value").alias("raw_line"),
            # Rising within a task, and a block is read by one task in file order.
            F.monotonically_increasing_id().alias("_slot"),
        ),
        "lines",
    )
    return _numbered(blocks).select("incident_id", "source_name", "line_number", "raw_line")


def _numbered(blocks: DataFrame) -> DataFrame:
    """Staged lines with ``line_number``, from their ``_block`` and their ``_slot`` in it."""
    counts = blocks.groupBy("incident_id", "_block").agg(
        F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    before = (
        Window.partitionBy("incident_id")
        .orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = stage(
        counts.select(
            "incident_id",
            "_block",
            (F.col("_first") - 1 - F.coalesce(F.sum("_lines").over(before), F.lit(0))).alias(
                "_base"
            ),
        ),
        "block-offsets",
    )
    return blocks.join(broadcast_if_small(offsets), ["incident_id", "_block"]).withColumn(
        "line_number", F.col("_slot") - F.col("_base")
    )


def read_uploaded_logs(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Lines of uploaded files, split at every line boundary of a decoded text.

    Unlike ``read_log_files`` this knows all line boundaries of text and gives the empty line behind a
    last boundary, also the one line of an empty file.  Files are read in blocks: what lies between two
    line feeds is a row, which is then cut at the other boundaries; a file may have any size.
    """
    given = paths if isinstance(paths, str) else list(paths)
    path, name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    value = F.col("value")
    # A row's carriage return belongs to its line feed.
    body = F.regexp_replace(value, r"\r\z", "")
    pieces = F.split(F.make_valid_utf8(body), fixed.LINE_BOUNDARY, -1)
    blocks = stage(
        spark.read.option("lineSep", "\n").text(given).select(
            path.alias("incident_id"),
            name.alias("source_name"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.octet_length("value").alias("_bytes"),
            F.endswith(value, F.lit("\r")).alias("_return"),
            F.posexplode(pieces).alias("_place", "raw_line"),
        ).select(
            "incident_id",
            "source_name",
            "_block",
            # A row counts with its line feed, and once.
            F.when(F.col("_place") == 0, F.col("_bytes") + 1).otherwise(0).alias("_bytes"),
            "_return",
            "raw_line",
            F.monotonically_increasing_id().alias("_slot"),
        ),
        "lines",
    )
    last = F.max_by("_return", F.struct("_block", "_slot"))
    read = blocks.groupBy("incident_id").agg(
        F.count(F.lit(1)).alias("_lines"), F.sum("_bytes").alias("_read"), last.alias("_return")
    )
    # The listing alone: no content is read.
    files = spark.read.format("binaryFile").load(given).select(
        path.alias("incident_id"), name.alias("source_name"), F.col("length").alias("_length")
    )
    # More bytes than the file has: the last row had no line feed.  A byte-order mark (3 bytes) is not read.
    open_end = (F.col("_read") - F.col("_length")).isin(1, -2)
    ended = files.join(read, "incident_id", "left").where(
        F.col("_lines").isNull() | ~open_end | F.col("_return")
    )
    behind = ended.select(
        "incident_id",
        "source_name",
        (F.coalesce("_lines", F.lit(0)) + 1).alias("line_number"),
        F.lit("").alias("raw_line"),
    )
    lines = _numbered(blocks).select("incident_id", "source_name", "line_number", "raw_line")
    return lines.unionByName(behind)


def demo_scenarios(spark: SparkSession) -> DataFrame:
    """The named demo incidents and their files."""
    return spark.createDataFrame(
        list(fixed.DEMO_INCIDENTS.items()), "scenario string, source_name string"
    )


def with_scenario(lines: DataFrame) -> DataFrame:
    """Keep the lines of demo files and add their ``scenario``."""
    return lines.join(demo_scenarios(lines.sparkSession), "source_name")
