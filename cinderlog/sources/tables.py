"""The chunk and report tables at rest.

Both are Parquet, split into hash buckets of their key, so that a change rewrites only the
buckets it touches.  Writes go through a ``rebalance`` hint: a bucket that holds far more rows
than the others is written by several tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.operators import index as chunk_index
from cinderlog.operators import reports as report_ops
from cinderlog.schemas import CHUNKS, REPORTS
from cinderlog.sources.staging import stage

# Buckets of a new table; a table keeps the number it was made with.
BUCKETS = 64
_BUCKET = "bucket"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _facts_path(path: str) -> str:
    """A small table beside the table: bucket count, highest id it ever gave out, embedder."""
    return f"{path.rstrip('/')}.facts"


class _Facts(NamedTuple):
    buckets: int = BUCKETS
    highest: int = 0
    # Name of the embedder that made all vectors, if known.
    embedder: str | None = None


_FACTS = "buckets int, highest long, embedder string"


def _facts(spark: SparkSession, path: str, buckets: int = BUCKETS) -> _Facts:
    try:
        row = spark.read.schema(_FACTS).parquet(_facts_path(path)).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return _Facts(*row) if row else _Facts(buckets)


def _note(spark: SparkSession, path: str, facts: _Facts) -> None:
    spark.createDataFrame([tuple(facts)], _FACTS).coalesce(1).write.mode("overwrite").option(
        "partitionOverwriteMode", "static"
    ).parquet(_facts_path(path))


def _stored(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_BUCKET, T.IntegerType())])


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table with its bucket column; empty when it does not exist yet."""
    try:
        return spark.read.schema(_stored(schema)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _stored(schema))


def _write(rows: DataFrame, path: str, key: str, touched: Sequence[int] | None, buckets: int) -> None:
    """Write whole buckets, all of them or the touched ones.

    A touched bucket that has no rows left is emptied through a filter on the whole table's files:
    its folder is overwritten with a file without rows.
    """
    bucketed = rows.withColumn(_BUCKET, _bucket(F.col(key), buckets))
    writer = bucketed.hint("rebalance", F.col(_BUCKET)).write.mode("overwrite")
    (
        writer.option("partitionOverwriteMode", "static" if touched is None else "dynamic")
        .partitionBy(_BUCKET)
        .parquet(path)
    )
    if touched is None:
        return
    spark = rows.sparkSession
    left = {row[_BUCKET] for row in bucketed.select(_BUCKET).distinct().collect()}
    for number in set(touched) - left:
        rows.limit(0).coalesce(1).write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).parquet(f"{path.rstrip('/')}/{_BUCKET}={number}")
    spark.catalog.refreshByPath(path)


def _touched(keys: DataFrame, key: str, buckets: int) -> list[int]:
    """The bucket numbers of some keys: at most ``buckets`` small integers."""
    rows = keys.select(_bucket(F.col(key), buckets).alias(_BUCKET)).distinct().collect()
    return sorted(row[_BUCKET] for row in rows)


def _require_unique(chunks: DataFrame) -> None:
    repeated = chunk_index.duplicate_keys(chunks).first()
    if repeated is not None:
        raise ValueError(
            f"section {repeated['heading']!r} of source {repeated['source']!r} "
            f"occurs {repeated['chunks']} times"
        )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CHUNKS).drop(_BUCKET)


def write_chunks(
    chunks: DataFrame, path: str, buckets: int = BUCKETS, embedder: str | None = None
) -> None:
    """Full rebuild: the table holds exactly the given chunks afterwards.

    A repeated (source, heading) fails the write and leaves the table as it was.  ``embedder`` names what made
    the vectors, so that ``replace_in_table`` can use them again.
    """
    spark = chunks.sparkSession
    rows = stage(chunks.select(*CHUNKS.fieldNames()), "chunk-rows")
    _require_unique(rows)
    highest = max(_facts(spark, path).highest, rows.agg(F.max("id")).first()[0] or 0)
    _note(spark, path, _Facts(buckets, highest, embedder))
    _write(rows, path, "source", None, buckets)


def replace_in_table(
    documents: DataFrame, path: str, embed: chunk_index.Embedder, embedder: str | None = None
) -> DataFrame:
    """Index ``(source, text)`` documents, replacing the chunks their sources had.

    A document without any text, or a repeated (source, heading), fails the job and leaves the table as
    it was.  Ids go on after the highest one ever given.  Returns the new chunk count per source.

    If ``embedder`` is the name that the table was written with, chunks whose text is unchanged keep their
    vectors and only the others are embedded.  An empty table takes the name; another name, or
    none, embeds all and leaves the table without one.
    """
    spark = documents.sparkSession
    stored = _read(spark, path, CHUNKS)
    facts = _facts(spark, path)
    highest = max(facts.highest, stored.agg(F.max("id")).first()[0] or 0)
    touched = _touched(documents, "source", facts.buckets)
    near = stored.filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
    same = embedder is not None and embedder == facts.embedder
    known = near.join(documents.select("source").distinct(), "source", "left_semi") if same else None
    fresh = stage(chunk_index.build_index(documents, embed, highest + 1, known), "fresh-chunks")
    without_text = documents.select("source").distinct().join(fresh, "source", "left_anti")
    if not without_text.isEmpty():
        raise ValueError("Document does not contain extractable text.")
    _require_unique(fresh)
    merged = stage(chunk_index.replace_sources(near, fresh), "merged-chunks")
    # All vectors are one embedder's only if those that stay are.
    one = embedder if same or stored.isEmpty() else None
    _note(spark, path, _Facts(facts.buckets, max(highest, fresh.agg(F.max("id")).first()[0] or 0), one))
    _write(merged, path, "source", touched, facts.buckets)
    return chunk_index.source_counts(fresh)


def delete_from_table(spark: SparkSession, path: str, source: str) -> int:
    """Remove the chunks of one source; returns how many there were."""
    stored = _read(spark, path, CHUNKS)
    facts = _facts(spark, path)
    keys = spark.createDataFrame([(source,)], "source string")
    touched = _touched(keys, "source", facts.buckets)
    bucket = stored.filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
    removed = bucket.filter(F.col("source") == source).count()
    if removed:
        highest = max(facts.highest, stored.agg(F.max("id")).first()[0] or 0)
        _note(spark, path, facts._replace(highest=highest))
        kept = stage(chunk_index.without_sources(bucket, [source]), "kept-chunks")
        _write(kept, path, "source", touched, facts.buckets)
    return removed


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, REPORTS).drop(_BUCKET)


def save_reports(rows: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Merge report rows into the table; returns ``(id, signature)`` of the saved reports.

    Only the buckets of the rows' signatures are read and written, and of the others the ids alone.
    A new table has ``buckets`` buckets.
    """
    spark = rows.sparkSession
    rows = stage(rows, "report-rows")
    facts = _facts(spark, path, buckets)
    stored = _read(spark, path, REPORTS)
    highest = max(facts.highest, stored.agg(F.max("id")).first()[0] or 0)
    touched = _touched(rows, "signature", facts.buckets)
    near = stored.filter(F.col(_BUCKET).isin(touched)).drop(_BUCKET)
    merged = stage(report_ops.upsert_reports(near, rows, highest), "reports")
    _note(spark, path, facts._replace(highest=max(highest, merged.agg(F.max("id")).first()[0] or 0)))
    _write(merged, path, "signature", touched, facts.buckets)
    saved = rows.select("signature").distinct()
    return merged.where("part = 1").join(saved, "signature", "left_semi").select("id", "signature")
