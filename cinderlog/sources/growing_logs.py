"""Log files that grow: a run reads only the bytes that came since the last one.

A ledger notes for each file how many bytes and lines were taken.  Aggregates are kept as partial sums, so the
new events' sums are added to them and the old events are not needed again.  Every run writes a
new version of these tables and then, as its last step, one row that names it; a reader takes the last version
with such a row, so a run that breaks off is as if it had not been.

Files are opened in the tasks, by URI (local and shared folders and the object stores that Arrow knows).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.operators import events as event_ops
from cinderlog.operators import metrics
from cinderlog.operators.events import level_rank
from cinderlog.operators.ordering import with_position
from cinderlog.sources.staging import broadcast_if_small, stage

# Bytes of a file that one row of work stands for, and that are read at once.
BLOCK_BYTES = 64 * 1024 * 1024
_READ = 1 << 20
_ROWS = 10_000

_LEDGER = "incident_id string, source_name string, taken long, lines long"
_TOTALS = (
    "incident_id string, service string, events long, errors long, critical long, serious long, "
    "severity_points long, started_at timestamp_ntz, ended_at timestamp_ntz"
)
_LEVELS = "incident_id string, level string, events long"
_REJECTED = "incident_id string, rejected long"
_TABLES = {"ledger": _LEDGER, "totals": _TOTALS, "levels": _LEVELS, "rejected": _REJECTED}


class LogState(NamedTuple):
    """What the runs so far know of all files; an incident is a file, named by its path."""

    ledger: DataFrame
    totals: DataFrame
    levels: DataFrame
    rejected: DataFrame

    def metrics(self) -> DataFrame:
        return metrics.metrics_of_totals(self.totals, self.ledger)

    def impact(self) -> DataFrame:
        return metrics.scores_of_totals(self.totals, self.ledger)

    def level_counts(self) -> DataFrame:
        return self.levels.withColumn("severity", level_rank(F.col("level")))

    def service_counts(self) -> DataFrame:
        return self.totals.select("incident_id", "service", "events")


def _version(spark: SparkSession, folder: str) -> int:
    try:
        done = spark.read.schema("version int").parquet(f"{folder}/done")
        return done.agg(F.max("version")).first()[0] or 0
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def read_state(spark: SparkSession, folder: str) -> LogState:
    """The last finished version; empty tables before the first run."""
    version = _version(spark, folder)
    if not version:
        return LogState(*(spark.createDataFrame([], schema) for schema in _TABLES.values()))
    return LogState(
        *(spark.read.schema(schema).parquet(f"{folder}/v{version}/{name}") for name, schema in _TABLES.items())
    )


def lines_between(file, first: int, begin: int, end: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Places and bytes of the complete lines that start in ``[begin, end)``.

    A line starts at ``first`` or behind a line feed, and ends with one before ``stop``.
    """
    # The byte before tells whether a line starts at ``begin``.
    at = begin if begin == first else begin - 1
    skipping = begin != first
    file.seek(at)
    held: list[bytes] = []
    place, left = at, stop - at
    while left > 0:
        chunk = file.read(min(_READ, left))
        if not chunk:
            return
        left -= len(chunk)
        if b"\n" not in chunk:
            held.append(chunk)
            continue
        *lines, rest = (b"".join(held) + chunk).split(b"\n")
        held = [rest]
        for line in lines:
            if not skipping:
                if place >= end:
                    return
                yield place, line
            skipping = False
            place += len(line) + 1


def _new_lines(ranges: DataFrame) -> DataFrame:
    """``incident_id, source_name, place, following, raw_line`` of the complete lines in ranges of files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = fs.FileSystem.from_uri(row["incident_id"])
                with store.open_input_file(path) as file:
                    found = lines_between(file, row["taken"], row["begin"], row["end"], row["size"])
                    held: list[tuple[int, int, str]] = []
                    for place, line in found:
                        following = place + len(line) + 1
                        line = line.removesuffix(b"\r")
                        if place == 0:
                            line = line.removeprefix(b"\xef\xbb\xbf")
                        held.append((place, following, line.decode("utf-8", "replace")))
                        if len(held) == _ROWS:
                            yield _batch(row, held)
                            held = []
                    if held:
                        yield _batch(row, held)

    return ranges.mapInArrow(
        read, "incident_id string, source_name string, place long, following long, raw_line string"
    )


def _batch(row: dict, held: list[tuple[int, int, str]]) -> pa.RecordBatch:
    place, following, text = zip(*held)
    names = [pa.array([row[name]] * len(held)) for name in ("incident_id", "source_name")]
    columns = [*names, pa.array(place, pa.int64()), pa.array(following, pa.int64()), pa.array(text, pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["incident_id", "source_name", "place", "following", "raw_line"])


def update(
    spark: SparkSession, paths: str | Sequence[str], folder: str, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Take in what the files under ``paths`` have gained; returns the new lines, parsed.

    ``folder`` holds the ledger and the sums.  Lines end with a line feed (a carriage return before it is dropped) and
    go on with the numbers of their file; a last line without one waits for its end.  A file that is shorter
    than what was taken of it has been replaced: it starts anew, and its earlier sums go.  Files that are
    no longer there keep their sums.
    """
    state = read_state(spark, folder)
    version = _version(spark, folder) + 1
    listed = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("incident_id"),
        F.col("_metadata.file_name").alias("source_name"),
        F.col("length").alias("size"),
    )
    known = state.ledger.select("incident_id", "taken", "lines")
    files = stage(
        listed.join(known, "incident_id", "left").select(
            "incident_id",
            "source_name",
            "size",
            (F.col("size") < F.col("taken")).alias("replaced"),
            *(
                F.when(F.col("size") >= F.col(name if name == "taken" else "taken"), F.col(name)).otherwise(0).alias(name)
                for name in ("taken", "lines")
            ),
        ),
        "listed-files",
    )
    step = F.lit(block_bytes).cast("long")
    grown = files.where(F.col("size") > F.col("taken"))
    ranges = grown.select(
        "*", F.explode(F.sequence(F.col("taken"), F.col("size") - 1, step)).alias("begin")
    ).withColumn("end", F.least(F.col("begin") + step, F.col("size")))
    # Blocks are dealt out by their place, so that a large file is read by many tasks.
    dealt = ranges.repartition(F.xxhash64("incident_id", "begin"))
    lines = stage(_new_lines(dealt), "new-lines")
    numbered = with_position(lines, ["incident_id"], ["place"], "_number").join(
        broadcast_if_small(stage(grown.select("incident_id", "lines"), "known-lines")), "incident_id"
    )
    parsed = stage(
        event_ops.parse_lines(
            numbered.select("incident_id", "source_name", (F.col("lines") + F.col("_number")).alias("line_number"), "raw_line")
        ),
        "new-parsed",
    )
    taken = lines.groupBy("incident_id").agg(F.max("following").alias("_following"), F.count(F.lit(1)).alias("_more"))
    counted = files.join(taken, "incident_id", "left").select(
        "incident_id",
        "source_name",
        F.coalesce("_following", "taken").alias("taken"),
        (F.col("lines") + F.coalesce("_more", F.lit(0))).alias("lines"),
    )
    gone = state.ledger.join(files.select("incident_id"), "incident_id", "left_anti")
    replaced = stage(files.where("replaced").select("incident_id"), "replaced-files")

    def kept(frame: DataFrame) -> DataFrame:
        return frame.join(broadcast_if_small(replaced), "incident_id", "left_anti")

    new = event_ops.events_of(parsed)
    levels = metrics.level_counts(new).drop("severity").unionByName(kept(state.levels))
    rejected = event_ops.rejected_counts(parsed).unionByName(kept(state.rejected))
    written = {
        "ledger": counted.unionByName(gone),
        "totals": metrics.merged_totals(metrics.service_totals(new).unionByName(kept(state.totals))),
        "levels": levels.groupBy("incident_id", "level").agg(F.sum("events").alias("events")),
        "rejected": rejected.groupBy("incident_id").agg(F.sum("rejected").alias("rejected")),
    }
    for name, frame in written.items():
        frame.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{folder}/v{version}/{name}")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("append").parquet(f"{folder}/done")
    return parsed
