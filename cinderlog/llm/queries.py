"""Registered queries of the operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm import (
    bpe,
    chat,
    decontamination,
    language,
    mixing,
    negatives,
    quality,
    repeats,
    rules,
    secrets,
    simhash,
    spelling,
    urls,
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _remainder(count: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % count


def op1_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation against itself with its neighbour's last reply."""
    conversations = _table(spark, folder, "conversations")
    return chat.format_preferences(chat.alternative_replies(conversations))


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, folder, "documents"))


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = quality.learn(
        documents, _table(spark, folder, "labels").where(_remainder(4) != 2)
    )
    return quality.score_quality(documents, model).select(
        "doc_id", held_out.alias("held_out"), "quality.score", "quality.predicted", "quality.attention"
    )


def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.find_contamination(documents, _table(spark, folder, "benchmark"))
    hit = F.col("contamination")
    return found.select(
        "doc_id",
        hit["n_words"].alias("n_words"),
        hit["n_hit"].alias("n_hit"),
        F.size(hit["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(hit["items"], ","), 256).alias("items_sha256"),
        (hit["n_hit"] > 0).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = rules.judge(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.array_join("broken", ",").alias("broken"),
    )


def op6_repeats(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    removed = F.aggregate(
        "removed", F.lit(0).cast("long"), lambda sum_, span: sum_ + span["end"] - span["start"]
    )
    return repeats.remove_repeats(documents).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


def op8_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    judged = urls.judge_urls(_table(spark, folder, "pages"))
    return judged.select(
        "page_id",
        "host",
        "path",
        "rule",
        "verdict",
        F.array_join("strict_terms", ",").alias("strict_terms"),
        F.array_join("soft_terms", ",").alias("soft_terms"),
    )


def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    found = secrets.find_secrets(documents).select("doc_id", "secrets.base", "secrets.all")
    count = lambda kind: F.size(
        F.filter("base", lambda x: x["kind"] == secrets.KINDS.index(kind))
    ).cast("long")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("all")).alias("spans"),
    )


def op10_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = language.learn(documents.where(_remainder(5) != 0))
    return language.identify(documents.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out"),
        "language.lang_pred",
        "language.score",
        "language.ambiguous",
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """A letter is taken out of every 31st run, by a hash of document and run."""
    runs = spelling.letter_runs(_table(spark, folder, "documents").select("doc_id", "text"))
    hashed = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    runs = runs.withColumn("_hash", hashed)
    at = (F.col("_hash") % F.length("run")).cast("int")
    left_out = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.select(F.when(F.col("_hash") % 31 == 0, left_out).otherwise(F.col("run")).alias("word"))
    return spelling.group_variants(spelling.word_counts(words))


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of every seventh row are moved by one; components are whole 256ths."""
    rows = _table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    given = rows.where(finite).select("vec_id", label.alias("label"), vector.alias("vector"))
    return negatives.mine_negatives(given, F.col("vec_id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode(bpe.encode(documents, *vocabulary), *vocabulary)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_preference_formatting,
        op2_mixing,
        op3_quality_classifier,
        op4_decontamination,
        op5_quality_rules,
        op6_repeats,
        op7_simhash,
        op8_url_filters,
        op9_secrets,
        op10_language,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_byte_bpe,
    )
}
