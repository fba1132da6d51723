"""Documents to labelled, size-limited chunks.

A document is one row of bounded size, so everything happens inside the row: no shuffle, and the
text leaves the JVM at no point.  Documents of any size are chunked from their lines by
``long_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.stages import pinned
from cinderlog.functions.text import strip, unify_line_ends

_NEW_LINE = "\n"
_BLANK_LINE = "\n\n"


def _section(piece: Column, number: Column) -> Column:
    """Heading and content of a piece that starts at a heading line (or at the text's start)."""
    end = F.locate(_NEW_LINE, piece)
    first_line = F.when(end == 0, piece).otherwise(F.substr(piece, F.lit(1), end - 1))
    rest = F.when(end == 0, F.lit("")).otherwise(F.substr(piece, end + 1))
    headed = F.struct(
        strip(F.ltrim(first_line, F.lit("#"))).alias("heading"), strip(rest).alias("content")
    )
    untitled = F.struct(
        F.lit(fixed.DEFAULT_HEADING).alias("heading"), strip(piece).alias("content")
    )
    return F.when(number == 0, untitled).otherwise(headed)


def sections(text: Column) -> Column:
    """Array of ``struct<heading, content>``: every line that starts with ``#`` opens one.

    Text before the first heading is the default section; empty sections are dropped.
    """
    pieces = F.split(F.concat(F.lit(_NEW_LINE), unify_line_ends(text)), r"\n(?=#)", -1)
    return F.filter(F.transform(pieces, _section), lambda section: section["content"] != "")


def pack_paragraphs(text: Column, max_characters: int = fixed.CHUNK_CHARACTERS) -> Column:
    """Array of chunks of at most ``max_characters`` characters.

    Paragraphs are packed together in order while they fit; a paragraph that is too long by
    itself is cut into pieces of full length.
    """
    paragraphs = F.filter(
        F.transform(F.split(text, _BLANK_LINE, -1), strip), lambda paragraph: paragraph != ""
    )
    none = F.array().cast("array<string>")

    def closed(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(
            F.concat(state["done"], F.array(state["open"]))
        )

    def take(state: Column, paragraph: Column) -> Column:
        def result(done: Column, current: Column) -> Column:
            return F.struct(done.alias("done"), current.alias("open"))

        joined = F.concat(state["open"], F.lit(_BLANK_LINE), paragraph)
        pieces = F.regexp_extract_all(
            paragraph, F.lit("(?s).{1,%d}" % max_characters), F.lit(0)
        )
        return (
            F.when(
                F.length(paragraph) > max_characters,
                result(F.concat(closed(state), pieces), F.lit("")),
            )
            .when(state["open"] == "", result(state["done"], paragraph))
            .when(F.length(joined) > max_characters, result(closed(state), paragraph))
            .otherwise(result(state["done"], joined))
        )

    start = F.struct(none.alias("done"), F.lit("").alias("open"))
    return F.aggregate(paragraphs, start, take, closed)


def _occurrences(labels: Column) -> Column:
    """For every label how often it has come up so far, itself included.

    Labels are compared with the earlier ones of their document, which is one row of bounded size;
    ``long_documents`` numbers those of larger documents by sorting.
    """
    return F.transform(
        labels,
        lambda label, number: F.size(
            F.filter(F.slice(labels, 1, number + 1), lambda other: other == label)
        ),
    )


def split_sections(documents: DataFrame) -> DataFrame:
    """``(source, section, heading, content)`` rows of ``(source, text)`` documents."""
    return documents.select("source", F.posexplode(sections(F.col("text")))).select(
        "source", (F.col("pos") + 1).alias("section"), "col.heading", "col.content"
    )


def chunk_documents(
    documents: DataFrame, max_characters: int = fixed.CHUNK_CHARACTERS
) -> DataFrame:
    """``(source, position, heading, content)`` chunks with labels unique in a document.

    A section in several chunks numbers them ``(part n)``; a label that occurs again gets its
    occurrence number.  A document without text, or with a null one, gives no chunk.
    """
    packed = F.transform(
        F.col("_sections"),
        lambda section: F.struct(
            section["heading"].alias("heading"),
            pack_paragraphs(section["content"], max_characters).alias("parts"),
        ),
    )

    def labelled(section: Column) -> Column:
        many = F.size(section["parts"]) > 1
        return F.transform(
            section["parts"],
            lambda part, number: F.struct(
                F.when(many, F.format_string("%s (part %d)", section["heading"], number + 1))
                .otherwise(section["heading"])
                .alias("label"),
                part.alias("content"),
            ),
        )

    staged = (
        documents.select("source", sections(F.coalesce("text", F.lit(""))).alias("_sections"))
        .select("source", packed.alias("_packed"))
        .select("source", F.flatten(F.transform("_packed", labelled)).alias("_chunks"))
    )
    # Each step is computed once: a label list that is computed anew for each label is not.
    listed = pinned(staged, {"_chunks": F.col("_chunks"), "_labels": F.col("_chunks.label")})
    counted = listed.withColumn("_occurrences", _occurrences(F.col("_labels")))
    label, occurrence = F.col("col._chunks.label"), F.col("col._occurrences")
    return counted.select(
        "source", F.posexplode(F.arrays_zip("_chunks", "_occurrences"))
    ).select(
        "source",
        (F.col("pos") + 1).alias("position"),
        F.when(occurrence == 1, label)
        .otherwise(F.format_string("%s (%d)", label, occurrence))
        .alias("heading"),
        F.col("col._chunks.content").alias("content"),
    )


def embedding_text(heading: Column, content: Column) -> Column:
    return F.concat_ws("\n", heading, content)
