"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; 0 for a zero vector, an error for unequal or empty vectors."""
    lengths = norm(left) * norm(right)
    return (
        F.when(
            (F.size(left) != F.size(right)) | (F.size(left) < 1),
            F.raise_error(F.lit("vectors must have the same length, at least 1")).cast("double"),
        )
        .when(lengths == 0, F.lit(0.0))
        .otherwise(dot(left, right) / lengths)
    )


def from_json_text(text: Column) -> Column:
    """Vector stored as JSON text, for importing an existing index."""
    return F.from_json(text, "array<double>").cast("array<float>")


def to_json_text(vector: Column) -> Column:
    return F.to_json(vector)
