"""Retrieval evaluation over labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.operators.retrieval import search, with_chunks
from cinderlog.schemas import EVALUATION_CASES


def available_cases(spark: SparkSession, index: DataFrame) -> DataFrame:
    """The built-in cases, and the optional one when its source is indexed."""
    built_in = spark.createDataFrame(fixed.EVALUATION_CASES, EVALUATION_CASES)
    optional = spark.createDataFrame([fixed.OPTIONAL_EVALUATION_CASE], EVALUATION_CASES)
    return built_in.unionByName(indexed_cases(optional, index))


def indexed_cases(cases: DataFrame, index: DataFrame) -> DataFrame:
    """The cases whose expected source is indexed."""
    indexed = index.select(F.col("source").alias("expected_source")).distinct()
    return cases.join(indexed, "expected_source", "left_semi")


def evaluate_retrieval(
    cases: DataFrame, index: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD
) -> DataFrame:
    """Top-1 retrieval of ``(case_id, name, expected_source, answerable, embedding)`` cases.

    An answerable case passes when its best chunk is accepted and of the expected source, an
    unanswerable one when nothing is accepted.
    """
    queries = cases.select(F.col("case_id").alias("query_id"), "embedding")
    top = with_chunks(search(queries, index, 1), index).select(
        F.col("query_id").alias("case_id"),
        F.col("source").alias("_source"),
        F.col("heading").alias("_heading"),
        F.col("score").alias("_score"),
    )
    found = F.col("_score").isNotNull()
    accepted = F.coalesce(F.col("_score") >= threshold, F.lit(False))
    judged = cases.join(top, "case_id", "left").withColumn("accepted", accepted)
    return judged.select(
        *(name for name in cases.columns if name not in ("embedding", "query")),
        F.when(~found, fixed.NO_RESULT_SOURCE)
        .when(F.col("accepted"), F.col("_source"))
        .otherwise(fixed.REJECTED_SOURCE)
        .alias("retrieved_source"),
        F.coalesce("_heading", F.lit(fixed.NO_RESULT_HEADING)).alias("retrieved_heading"),
        F.coalesce("_score", F.lit(0.0)).alias("score"),
        "accepted",
        F.when(
            F.col("answerable"),
            F.col("accepted") & (F.col("_source") == F.col("expected_source")),
        )
        .otherwise(~F.col("accepted"))
        .alias("passed"),
    )


def evaluation_summary(results: DataFrame) -> DataFrame:
    """Passed cases, accuracy in percent and, where measured, mean latency."""
    latency = (
        F.avg("latency_seconds")
        if "latency_seconds" in results.columns
        else F.lit(None).cast("double")
    )
    return results.agg(
        F.count_if("passed").alias("passed"),
        F.count(F.lit(1)).alias("cases"),
        (F.count_if("passed") / F.count(F.lit(1)) * 100).alias("accuracy_percent"),
        latency.alias("mean_latency_seconds"),
    )


def evaluation_table(results: DataFrame) -> DataFrame:
    """Display form of the results."""
    latency = (
        F.round("latency_seconds", 2)
        if "latency_seconds" in results.columns
        else F.lit(None).cast("double")
    )
    return results.select(
        F.when(F.col("passed"), "PASS").otherwise("FAIL").alias("Result"),
        F.col("name").alias("Case"),
        F.when(F.col("answerable"), "Answer").otherwise("Reject").alias("Expected behavior"),
        F.col("expected_source").alias("Expected"),
        F.col("retrieved_source").alias("Retrieved"),
        F.col("retrieved_heading").alias("Section"),
        F.round("score", 3).alias("Similarity"),
        latency.alias("Latency (sec)"),
    )
