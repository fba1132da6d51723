"""Intermediate tables in the cluster's shared checkpoint folder.

A staged table cuts the lineage: its rows, and any row numbers taken from their physical order,
stay the same however often later tasks are retried or executors are lost.  Tables that are staged inside
``scratch`` go when its work is done; others stay until ``discard``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
# Attribute of a staged frame that holds the bytes of its rows.
_MEASURED = "_cinderlog_bytes"
BROADCAST_BYTES = 64 * 1024 * 1024


def staging_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting; it then gets a temporary folder.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="cinderlog-")
        spark.conf.set(_SETTING, root)
    return f"{root.rstrip('/')}/cinderlog-{spark.conf.get('spark.app.id')}"


# Folders of the open ``scratch`` blocks, of the driver's thread.
_open: ContextVar[tuple[str, ...]] = ContextVar("cinderlog_scratch", default=())


@contextmanager
def scratch(spark: SparkSession, name: str = "work") -> Iterator[None]:
    """Delete the tables that are staged inside the block when it ends well.

    What is to be read afterwards must be written inside: elsewhere, or by ``stage`` with ``lasting``.  After
    an error the tables stay, as they may tell what went wrong.
    """
    folder = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    token = _open.set((*_open.get(), folder))
    try:
        yield
    finally:
        _open.reset(token)
    _delete(spark, folder)


def discard(spark: SparkSession) -> None:
    """Delete all staged tables of this application."""
    _delete(spark, staging_root(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _folder(spark: SparkSession, lasting: bool = False) -> str:
    opened = _open.get()[:-1] if lasting else _open.get()
    return opened[-1] if opened else staging_root(spark)


def stage(frame: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write the rows to a new staged table and return it.

    Inside ``scratch`` the table goes with the block, or if ``lasting`` with the one around it.

    The bytes of flat rows are added up while they are written, so that ``broadcast_if_small`` needs no
    job of its own for the table.
    """
    spark = frame.sparkSession
    path = f"{_folder(spark, lasting)}/{name}-{uuid.uuid4().hex}"
    flat = not any(isinstance(field.dataType, _NESTED) for field in frame.schema)
    if not flat or frame.isStreaming:
        frame.write.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)
    seen = Observation()
    frame.observe(seen, F.sum(_row_bytes(frame)).alias("bytes")).write.parquet(path)
    table = spark.read.schema(frame.schema).parquet(path)
    setattr(table, _MEASURED, seen.get["bytes"] or 0)
    return table


def broadcast_if_small(frame: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the rows are measured to take at most ``max_bytes``.

    Strings and binaries count with their length, arrays, maps and structs with all they hold,
    and other values with 16 bytes.  A larger frame is left to the planner, which then joins by
    shuffle.  The frame should be a staged or stored table, so that measuring it is cheap.
    """
    return F.broadcast(frame) if _total_bytes(frame) <= max_bytes else frame


# Copies of each row of a large side that a hot key of the other side is spread over.
SPREAD = 16


def join_unique(
    frame: DataFrame,
    unique: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join (``inner`` or ``left``) with a staged side that has each key once.

    A side of at most ``max_bytes`` is broadcast.  A larger one is shuffled, each of its rows ``SPREAD`` times, so
    that the rows of one key of ``frame`` meet it in as many tasks, dealt out by the ``spread`` columns.
    """
    if _total_bytes(unique) <= max_bytes:
        return frame.join(F.broadcast(unique), list(keys), how)
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long")))
    dealt = F.pmod(F.xxhash64(F.lit(11), *spread), F.lit(SPREAD))
    return frame.withColumn("_copy", dealt).join(unique.withColumn("_copy", copies), [*keys, "_copy"], how).drop("_copy")


def _total_bytes(frame: DataFrame) -> int:
    total = measured_bytes(frame)
    return (frame.agg(F.sum(_row_bytes(frame))).first()[0] or 0) if total is None else total


def measured_bytes(frame: DataFrame) -> int | None:
    """Bytes of a staged table as added up while it was written; null for other frames and nested rows."""
    return getattr(frame, _MEASURED, None)


def _row_bytes(frame: DataFrame) -> Column:
    return reduce(add, [_bytes(F.col(f"`{field.name}`"), field.dataType) for field in frame.schema])


def _bytes(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + F.lit(16)
    if isinstance(kind, T.StructType):
        return reduce(add, [_bytes(value[field.name], field.dataType) for field in kind], F.lit(16))
    if isinstance(kind, T.MapType):
        pairs = T.StructType().add("key", kind.keyType).add("value", kind.valueType)
        return _bytes(F.map_entries(value), T.ArrayType(pairs))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.NumericType | T.BooleanType):
            return F.lit(16) * (1 + F.greatest(F.size(value), F.lit(0)).cast("long"))
        held = F.aggregate(
            value, F.lit(16).cast("long"), lambda sum_, x: sum_ + _bytes(x, kind.elementType)
        )
        return F.coalesce(held, F.lit(16))
    return F.lit(16).cast("long")
