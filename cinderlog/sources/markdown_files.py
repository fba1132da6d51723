"""A sink that writes each report as one Markdown file, named by the report, or each row as a file of text.

A Python data source.  All parts of a report come to one task, in order, and go to a hidden file that then
takes the report's name in one step.  A task that is tried again writes the same names again, so no
report has two files and none is seen half written.  ``_SUCCESS`` follows when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FORMAT = "markdown_files"


@dataclass
class Written(WriterCommitMessage):
    files: int


def file_name(name: str) -> str:
    """The name with percent codes for what a visible file's name cannot have or begin with."""
    quoted = quote(name, safe=" ")
    return f"%{ord(quoted[0]):02X}{quoted[1:]}" if quoted[:1] in (".", "_") else quoted or "%"


# Folder of files that are being written.
_UNFINISHED = "_unfinished"


class MarkdownWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool, suffix: str = ".md"):
        self.path, self.overwrite, self.suffix = path, overwrite, suffix
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        if overwrite:
            store.delete_dir_contents(folder)
        store.create_dir(f"{folder}/{_UNFINISHED}")

    def _store(self) -> tuple[fs.FileSystem, str]:
        store, folder = fs.FileSystem.from_uri(self.path)
        return store, folder.rstrip("/")

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, folder = self._store()
        files = 0
        for name, parts in groupby(iterator, key=lambda row: row[0]):
            hidden = f"{folder}/{_UNFINISHED}/{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as file:
                for row in parts:
                    text = row[1] or b""
                    file.write(text.encode("utf-8") if isinstance(text, str) else text)
                file.write(b"\n")
            store.move(hidden, f"{folder}/{file_name(name)}{self.suffix}")
            files += 1
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = self._store()
        self._clear(store, folder)
        with store.open_output_stream(f"{folder}/_SUCCESS"):
            pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, folder: str) -> None:
        """Remove what broken-off tasks left behind, without a list of all files."""
        store.delete_dir(f"{folder}/{_UNFINISHED}")


class MarkdownFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return MarkdownWriter(self.options["path"], overwrite, self.options.get("suffix", ".md"))


def export_markdown(reports: DataFrame, path: str, key: str = "id", overwrite: bool = True) -> None:
    """Write each report as ``<key>.md`` under ``path``, its parts one after the other, with a line feed at the end.

    ``path`` is a URI or a folder that all executors share.  What else the folder holds goes, unless
    ``overwrite`` is false: then reports of the same name are replaced.  Letters that a file name
    cannot have are written as percent codes; a null text is an empty one, a report with a null key is not written.
    """
    part = F.col("part") if "part" in reports.columns else F.lit(1)
    texts = (
        reports.select(F.col(key).cast("string").alias("name"), "analysis_markdown", part.alias("part"))
        .where("name IS NOT NULL")
        .repartition("name")
        .sortWithinPartitions("name", "part")
    )
    _write(texts, "analysis_markdown", path, ".md", overwrite)


def export_texts(texts: DataFrame, path: str, suffix: str) -> None:
    """Write each row of ``(name, text)`` as the file ``<name><suffix>`` under ``path``, a line feed at the end.

    Rows stay in their partitions; names must be unique.  What else the folder holds goes.
    """
    _write(texts, "text", path, suffix, True)


def _write(texts: DataFrame, text: str, path: str, suffix: str, overwrite: bool) -> None:
    texts.sparkSession.dataSource.register(MarkdownFiles)
    (
        texts.select("name", F.col(text).cast("binary").alias("text"))
        .write.format(FORMAT)
        .mode("overwrite" if overwrite else "append")
        .option("path", path)
        .option("suffix", suffix)
        .save()
    )
