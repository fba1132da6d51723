"""Files as rows, whose names never come to the driver.

Folders are listed in the tasks and the names go to a staged table; the tasks that then open the files are dealt out by
bytes and by files.  Spark's own reader keeps a list of all files on the driver and makes a task of every few small ones.
It is still used where only it can tell what the paths mean: patterns, folders named like partitions, and stores that
Arrow cannot open.
"""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.sources.staging import stage

# What one task opens.
TASK_BYTES = 32 * 1024 * 1024
TASK_FILES = 2_000
# Content in a batch of rows; a single file may have more.
_BATCH_BYTES = 4 * 1024 * 1024
_ROWS = 10_000

_PATTERN = frozenset("{}[]*?\\")
_ROOTS = "folder string, uri string, name string"
_LISTED = "folder string, uri string, name string, length long"
_READ = "path string, length long, content binary"


def read_files(spark: SparkSession, paths: str | Sequence[str], wanted: Column) -> DataFrame:
    """``(path, length, content)`` of the files under ``paths``, as Spark's ``binaryFile`` has them.

    ``wanted`` tells by path and length which files are opened; the others have a null content.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    roots = _roots(spark, given)
    if not roots:
        return _read_by_spark(spark, given, wanted)
    listed = stage(spark.createDataFrame(roots, _ROOTS).mapInArrow(_list, _LISTED), "listed-files")
    path = F.concat("folder", F.lit("/"), "name")
    files = listed.withColumn("path", path).withColumn("wanted", wanted)
    sums = files.agg(
        F.count("name").alias("files"),
        F.count_if(F.col("name").isNull()).alias("unknown"),
        F.coalesce(F.sum(F.when(F.col("wanted"), F.col("length"))), F.lit(0)).alias("bytes"),
    ).first()
    if sums.unknown:
        return _read_by_spark(spark, given, wanted)
    tasks = max(-(-sums.bytes // TASK_BYTES), -(-sums.files // TASK_FILES), spark.sparkContext.defaultParallelism)
    return files.drop("folder").repartition(tasks).mapInArrow(_read, _READ)


def _read_by_spark(spark: SparkSession, paths: list[str], wanted: Column) -> DataFrame:
    files = spark.read.format("binaryFile").load(paths)
    listed = files.filter(~wanted).select("path", "length", F.lit(None).cast("binary").alias("content"))
    return files.filter(wanted).select("path", "length", "content").unionByName(listed)


def _roots(spark: SparkSession, paths: list[str]) -> list[tuple[str, str, str]]:
    """The folder each path is in, the folder's URI and the path's name; none when only Spark's reader knows a path."""
    folders: dict[str, tuple[str, str] | None] = {}
    roots = []
    for given in paths:
        if not _PATTERN.isdisjoint(given):
            return []
        above, _, name = given.rpartition("/")
        if name in ("", ".", "..") or above[-1:] in ("", "/", ":"):
            path = _qualified(spark, given)
            above, name = (path.getParent() or path).toString(), path.getName()
        if above not in folders:
            folders[above] = _folder(spark, above)
        if folders[above] is None:
            return []
        roots.append((*folders[above], name))
    return roots


def _qualified(spark: SparkSession, path: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)


def _folder(spark: SparkSession, path: str) -> tuple[str, str] | None:
    """Path and URI of a folder without a slash at the end; null if Arrow cannot open it."""
    folder = _qualified(spark, path)
    parts = folder.toUri()
    uri = f"{parts.getScheme()}://{parts.getAuthority() or ''}{quote(parts.getPath())}".removesuffix("/")
    try:
        _store(uri)
    except (pa.ArrowException, OSError):
        return None
    return folder.toString().removesuffix("/"), uri


@lru_cache(maxsize=64)
def _store(uri: str) -> tuple[fs.FileSystem, str]:
    store, folder = fs.FileSystem.from_uri(f"{uri}/")
    return store, folder.rstrip("/")


def _visible(name: str) -> bool:
    """Whether Spark's readers take a file or folder of this name."""
    hidden = name.startswith("_") and "=" not in name
    return not (hidden or name.startswith(".") or name.endswith("._COPYING_"))


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Name and length of the visible files and folders in a folder; a folder has no length.

    A local folder is read entry by entry, so that its size does not matter.
    """
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder or "/") as found:
            for entry in found:
                if _visible(entry.name):
                    try:
                        yield entry.name, None if entry.is_dir() else entry.stat().st_size
                    except FileNotFoundError:
                        pass  # gone since, or a link to nothing
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            if _visible(info.base_name):
                yield info.base_name, None if info.type == fs.FileType.Directory else info.size


def _found(folder: str, uri: str, name: str) -> Iterator[tuple[str, str, str | None, int | None]]:
    """Rows of the files of a root; the name is null for what only Spark's reader knows.

    That is a path without a file, and a folder at any depth that is named like a partition.
    """
    store, above = _store(uri)
    root = store.get_file_info(f"{above}/{name}")
    if root.type == fs.FileType.NotFound:
        yield folder, uri, None, None
        return
    if root.type != fs.FileType.Directory:
        if root.size and _visible(name):
            yield folder, uri, name, root.size
        return
    if name:
        folder, uri, above = f"{folder}/{name}", f"{uri}/{quote(name)}", f"{above}/{name}"
    below = []
    for name, length in _entries(store, above):
        if length is None:
            below.append(f"{above}/{name}")
        elif length:
            yield folder, uri, name, length
    # Files further down do not count, unless folders are partitions.
    while below:
        inner = below.pop()
        if "=" in inner.rpartition("/")[2]:
            yield folder, uri, None, None
            return
        below += [f"{inner}/{name}" for name, length in _entries(store, inner) if length is None]


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for root in batch.to_pylist():
            held = []
            for row in _found(root["folder"], root["uri"], root["name"]):
                held.append(row)
                if len(held) == _ROWS:
                    yield _listed_batch(held)
                    held = []
            if held:
                yield _listed_batch(held)


def _listed_batch(rows: list[tuple]) -> pa.RecordBatch:
    *texts, lengths = zip(*rows)
    columns = [*(pa.array(text, pa.string()) for text in texts), pa.array(lengths, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["folder", "uri", "name", "length"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size = [], 0
        for row in batch.to_pylist():
            content = None
            if row["wanted"]:
                store, folder = _store(row["uri"])
                with store.open_input_file(f"{folder}/{row['name']}") as file:
                    content = file.read()
                size += len(content)
            held.append((row["path"], row["length"], content))
            if size >= _BATCH_BYTES:
                yield _read_batch(held)
                held, size = [], 0
        if held:
            yield _read_batch(held)


def _read_batch(rows: list[tuple]) -> pa.RecordBatch:
    paths, lengths, contents = zip(*rows)
    columns = [pa.array(paths, pa.string()), pa.array(lengths, pa.int64()), pa.array(contents, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["path", "length", "content"])
