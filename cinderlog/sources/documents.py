"""Document sources: runbook folders and uploaded files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import decode_utf8, file_suffix, source_name, strip
from cinderlog.sources.listed_files import read_files
from cinderlog.sources.logs import read_log_files


def read_runbooks(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """``(source, text)`` of the files in a folder with names like ``pattern``; the source is the file name.

    A file is one row; ``read_runbook_lines`` reads files of any size.
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    )
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("source"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("text"),
    )


def read_runbook_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``(source, line_number, place, line)`` of the Markdown files in a folder, of any size.

    Files are read in blocks, so no file has to fit into a row.  A line that the reader leaves whole
    though it holds other line boundaries is cut there; ``place`` orders its parts.  The rows are input of
    ``long_documents.chunk_lines`` with ``order=("line_number", "place")``.
    """
    lines = read_log_files(spark, f"{folder.rstrip('/')}/*.md")
    return lines.select(
        F.col("source_name").alias("source"),
        "line_number",
        F.posexplode(F.split("raw_line", fixed.LINE_BOUNDARY, -1)).alias("place", "line"),
    )


def read_uploads(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Uploaded files with their extracted text, or the reason there is none.

    The content of a file over the size limit or of another type is never read: both checks are
    on columns the file listing has.  Folders are listed in the tasks (``listed_files``).
    """
    known = file_suffix(F.col("path")).isin(*fixed.DOCUMENT_TYPES)
    small = known & (F.col("length") <= fixed.DOCUMENT_BYTES)
    return extract_documents(read_files(spark, paths, small))


def extract_documents(files: DataFrame) -> DataFrame:
    """``(path, source, text, reason)`` of ``(path, length, content)`` rows.

    Exactly one of text and reason is set.
    """
    suffix = file_suffix(F.col("path"))
    staged = files.select(
        "path",
        "length",
        source_name(F.col("path")).alias("source"),
        suffix.alias("_suffix"),
        F.when(
            suffix.isin(*fixed.DOCUMENT_TYPES) & (F.col("length") <= fixed.DOCUMENT_BYTES),
            strip(decode_utf8(F.col("content"))),
        ).alias("_text"),
    )
    reason = _reason(F.col("_suffix"), F.col("length"), F.col("_text"), F.col("source"))
    return staged.withColumn("reason", reason).select(
        "path", "source", F.when(F.col("reason").isNull(), F.col("_text")).alias("text"), "reason"
    )


def _reason(suffix: Column, length: Column, text: Column, source: Column) -> Column:
    return (
        F.when(source.isNull(), "Document filename is empty.")
        .when(
            ~suffix.isin(*fixed.DOCUMENT_TYPES),
            F.concat(
                F.lit("Unsupported document type: "),
                F.when(suffix == "", "none").otherwise(suffix),
            ),
        )
        .when(length > fixed.DOCUMENT_BYTES, "Document exceeds the 10 MB local indexing limit.")
        .when(text == "", "No extractable text was found in the document.")
    )


def accepted_documents(extracted: DataFrame) -> DataFrame:
    """``(source, text)`` of the files whose text could be extracted."""
    return extracted.filter(F.col("reason").isNull()).select("source", "text")
