"""Embedders: frames with a ``text`` column gain ``embedding array<float>``.

Any function of that shape can be used; three are given here.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hashed_words(dimensions: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Unit-length hashed word counts: deterministic, needs no model and no fitting pass."""

    def embed(texts: DataFrame) -> DataFrame:
        words = RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"[^\p{L}\p{N}]+")
        counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions)
        unit = Normalizer(inputCol="_counts", outputCol="_unit")
        staged = unit.transform(counts.transform(words.transform(texts)))
        return staged.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
            "_words", "_counts", "_unit"
        )

    return embed


def term_counts(terms: Sequence[str]) -> Callable[[DataFrame], DataFrame]:
    """How often each term occurs, as written and without overlap: one dimension a term, no model.

    A text without any of the terms gets zeros, which score 0 with every query; null is an empty text.
    """
    if not terms or not all(terms):
        raise ValueError("terms must not be empty")

    def embed(texts: DataFrame) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        counts = [
            (F.length(text) - F.length(F.replace(text, F.lit(term)))) / F.lit(len(term))
            for term in terms
        ]
        return texts.withColumn("embedding", F.array(*(count.cast("float") for count in counts)))

    return embed


def from_function(function: Callable[[str], Sequence[float]]) -> Callable[[DataFrame], DataFrame]:
    """Wrap a plain ``text -> vector`` function; runs in Arrow batches inside the tasks."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: [float(value) for value in function(text)])

    def embed(texts: DataFrame) -> DataFrame:
        return texts.withColumn("embedding", apply("text"))

    return embed
