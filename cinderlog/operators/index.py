"""The chunk index: building, replacing and removing sources, inventory and key check."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.operators.chunks import chunk_documents, embedding_text
from cinderlog.operators.ordering import with_total_before
from cinderlog.sources.staging import broadcast_if_small, stage

# Takes a frame with a ``text`` column and adds ``embedding array<float>``.
Embedder = Callable[[DataFrame], DataFrame]

COLUMNS = ("id", "source", "heading", "content", "embedding")


def embed_chunks(chunks: DataFrame, embed: Embedder) -> DataFrame:
    texts = chunks.withColumn("text", embedding_text(F.col("heading"), F.col("content")))
    return embed(texts).drop("text")


def embed_unseen(chunks: DataFrame, known: DataFrame, embed: Embedder) -> DataFrame:
    """Add ``embedding`` to chunks, calling the embedder only for texts that have no vector yet.

    ``known`` holds ``heading``, ``content`` and ``embedding`` of chunks that the same embedder has seen.  A
    text stands for its vector: it is named by its SHA-256, so the same text in another source or under
    another id is not embedded again, and a new text that repeats is embedded once.

    ``chunks`` and ``known`` are each read twice and should be staged or stored.
    """
    digest = F.sha2(embedding_text(F.col("heading"), F.col("content")), 256)
    named = chunks.withColumn("_digest", digest)
    wanted = named.select("_digest").distinct()
    seen = (
        known.where(F.col("embedding").isNotNull())
        .select(digest.alias("_digest"), "embedding")
        .join(wanted, "_digest", "left_semi")
        .groupBy("_digest")
        .agg(F.min("embedding").alias("embedding"))
    )
    seen = stage(seen, "known-vectors")
    unseen = named.join(seen.select("_digest"), "_digest", "left_anti").groupBy("_digest").agg(
        F.min(embedding_text(F.col("heading"), F.col("content"))).alias("text")
    )
    fresh = embed(unseen).select("_digest", F.col("embedding").cast("array<float>").alias("embedding"))
    vectors = stage(seen.unionByName(fresh), "vectors")
    return named.join(broadcast_if_small(vectors), "_digest").select(*chunks.columns, "embedding")


def one_per_source(documents: DataFrame) -> DataFrame:
    """One document for each source: of several, the last by path, or by text without a path.

    Only the texts of sources that repeat are shuffled.
    """
    named = documents.groupBy("source").agg(F.count(F.lit(1)).alias("_documents"))
    repeated = broadcast_if_small(
        stage(named.where("_documents > 1").select("source"), "repeated-sources")
    )
    place = [name for name in ("path", "text") if name in documents.columns]
    several = documents.join(repeated, "source", "left_semi").select("source", *place)
    last = several.groupBy("source").agg(F.max(F.struct(*place)).alias("_last"))
    return (
        documents.join(repeated, "source", "left_anti")
        .select("source", "text")
        .unionByName(last.select("source", "_last.text"))
    )


def build_index(
    documents: DataFrame, embed: Embedder, first_id: int = 1, known: DataFrame | None = None
) -> DataFrame:
    """Chunk, embed and number whole documents, in order of source and position.

    With ``known`` chunks only unseen texts are embedded, see ``embed_unseen``.

    A source has one document; see ``one_per_source`` for a batch with more.

    Ids come from the chunk counts of the sources before, so only (source, count) rows are
    sorted.  Documents are chunked once and the chunks staged; their texts are shuffled, by source,
    only when the counts are too many to broadcast.  Every chunk is embedded once.
    """
    chunks = stage(chunk_documents(one_per_source(documents)), "chunks")
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("_chunks"))
    offsets = stage(
        with_total_before(counts, ["source"], "_chunks", "_before").select("source", "_before"),
        "source-offsets",
    )
    numbered = (
        chunks
        .join(broadcast_if_small(offsets), "source")
        .withColumn("id", F.col("_before") + F.col("position") + (first_id - 1))
    )
    if known is not None:
        return embed_unseen(stage(numbered, "numbered-chunks"), known, embed).select(*COLUMNS)
    return embed_chunks(numbered, embed).select(*COLUMNS)


def replace_sources(index: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """The index with every source of ``new_chunks`` replaced by its new chunks."""
    replaced = new_chunks.select("source").distinct()
    return index.join(replaced, "source", "left_anti").select(*index.columns).unionByName(
        new_chunks.select(*index.columns)
    )


def without_sources(index: DataFrame, sources: Sequence[str]) -> DataFrame:
    return index.filter(~F.col("source").isin(*sources))


def removed_counts(index: DataFrame, sources: Sequence[str]) -> DataFrame:
    """How many chunks leave with each of the given sources."""
    return list_sources(index.filter(F.col("source").isin(*sources))).select(
        "source", "chunk_count"
    )


def chunk_count(index: DataFrame) -> DataFrame:
    return index.agg(F.count(F.lit(1)).alias("chunk_count"))


def source_kind(source: Column) -> Column:
    return F.when(F.startswith(source, F.lit(fixed.CUSTOM_PREFIX)), "Custom").otherwise("Built-in")


def source_counts(index: DataFrame) -> DataFrame:
    return (
        index.groupBy("source")
        .agg(F.count(F.lit(1)).alias("chunk_count"))
        .withColumn("kind", source_kind(F.col("source")))
    )


def list_sources(index: DataFrame) -> DataFrame:
    return source_counts(index).orderBy("source")


def source_chunks(index: DataFrame, source: str) -> DataFrame:
    """All chunks of one source in index order, without a similarity."""
    return (
        index.filter(F.col("source") == source)
        .select("id", "source", "heading", "content", F.lit(1.0).alias("score"))
        .orderBy("id")
    )


def duplicate_keys(index: DataFrame) -> DataFrame:
    """``(source, heading)`` keys that occur more than once; empty for a sound index."""
    return (
        index.groupBy("source", "heading")
        .agg(F.count(F.lit(1)).alias("chunks"))
        .filter(F.col("chunks") > 1)
    )
