"""Small helpers for Arrow batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Bytes that Spark sends to a Python worker at once; a single row may have more.
BATCH_BYTES = "8m"
# Text bytes that one round of array work inside a task holds at once.
ROUND_BYTES = 2 << 20


def rounds(texts: pa.Array, limit: int = ROUND_BYTES) -> Iterator[list[bytes]]:
    """The texts of a batch in order, in lists of about ``limit`` bytes; null is empty.

    A longer text makes a list of its own, so memory follows the longest text.
    """
    held: list[bytes] = []
    size = 0
    for scalar in texts:
        value = scalar.as_py() or b""
        if held and size + len(value) > limit:
            yield held
            held, size = [], 0
        held.append(value)
        size += len(value)
    if held:
        yield held


def bound_batches() -> None:
    """Let Arrow batches of the active session follow bytes, as texts differ much in length."""
    session = SparkSession.active()
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def arrow_udf(function: Callable, kind: str) -> Callable[..., Column]:
    """An Arrow function over columns, for batches of bounded size."""
    bound_batches()
    return F.arrow_udf(function, kind)
