"""Table schemas shared by the operators, sources and sinks."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LOG_LINES = _struct(
    ("incident_id", T.StringType()),
    ("line_number", T.LongType()),
    ("raw_line", T.StringType()),
)

EVENTS = _struct(
    ("incident_id", T.StringType()),
    ("ts", T.TimestampNTZType()),
    ("level", T.StringType()),
    ("service", T.StringType()),
    ("message", T.StringType()),
    ("raw_line", T.StringType()),
    ("line_number", T.LongType()),
)

DOCUMENTS = _struct(
    ("source", T.StringType()),
    ("text", T.StringType()),
)

CHUNKS = _struct(
    ("id", T.LongType()),
    ("source", T.StringType()),
    ("heading", T.StringType()),
    ("content", T.StringType()),
    ("embedding", T.ArrayType(T.FloatType())),
)

QUERY_VECTORS = _struct(
    ("query_id", T.LongType()),
    ("embedding", T.ArrayType(T.FloatType())),
)

EVALUATION_CASES = _struct(
    ("name", T.StringType()),
    ("query", T.StringType()),
    ("expected_source", T.StringType()),
    ("answerable", T.BooleanType()),
)

REPORTS = _struct(
    ("id", T.LongType()),
    ("signature", T.StringType()),
    ("part", T.IntegerType()),
    ("source_name", T.StringType()),
    ("created_at", T.StringType()),
    ("event_count", T.LongType()),
    ("started_at", T.StringType()),
    ("ended_at", T.StringType()),
    ("analysis_markdown", T.StringType()),
)
