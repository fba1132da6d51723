"""Files as rows: the same as Spark's reader gives, without a list of files on the driver."""

import os

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from cinderlog.plans import stored
from cinderlog.plans.driver_tables import DriverTables
from cinderlog.sources import documents, listed_files


def is_text():
    return F.endswith("path", F.lit(".txt"))


@pytest.fixture
def folder(tmp_path):
    """A folder with names of all kinds, empty and hidden files, links and folders."""
    (tmp_path / "sub" / "deeper").mkdir(parents=True)
    (tmp_path / "sub" / "o d%20ü#+~").mkdir()
    (tmp_path / "_hidden").mkdir()
    names = ["a.txt", "b c%20ü#+.txt", "n.json", "no suffix", "_b.txt", ".c.txt", "_k=1.txt", "d.txt._COPYING_",
             "sub/e.txt", "sub/deeper/f.txt", "_hidden/g.txt",
             "sub/o d%20ü#+~/h &;=%41.txt", "sub/o d%20ü#+~/i'j.txt"]
    for name in names:
        (tmp_path / name).write_bytes(name.encode() + b"\xff\0\n")
    (tmp_path / "empty.txt").touch()
    (tmp_path / "link.txt").symlink_to(tmp_path / "_b.txt")
    (tmp_path / "broken.txt").symlink_to(tmp_path / "nothing")
    return tmp_path


def rows(files):
    found = files.select("path", "length", "content").collect()
    return sorted(((row.path, row.length, row.content and bytes(row.content)) for row in found), key=str)


def by_spark(spark, *paths):
    found = rows(spark.read.format("binaryFile").load([str(path) for path in paths]))
    return sorted(((p, n, c if p.endswith(".txt") else None) for p, n, c in found), key=str)


def test_folders_and_files_as_spark_reads_them(spark, folder, monkeypatch):
    cases = [
        [folder],
        [f"file://{folder}/"],
        [folder / "sub", folder / "_hidden"],
        [folder, folder, folder / "a.txt", folder / "b c%20ü#+.txt", folder / "_b.txt", folder / "empty.txt"],
        [folder / "sub" / ".." / "sub" / "deeper"],
        [folder / "sub" / "o d%20ü#+~", folder / "sub" / "o d%20ü#+~" / "h &;=%41.txt"],
        [f"{folder}/sub/..", f"{folder}//sub///", f"file:{folder}/sub/./e.txt"],
        [os.path.relpath(folder / "sub"), os.path.relpath(folder / "a.txt")],
    ]
    expected = [by_spark(spark, *paths) for paths in cases]
    assert [len(found) for found in expected] == [6, 6, 2, 14, 1, 3, 8, 2]
    monkeypatch.setattr(listed_files, "_read_by_spark", None)
    for paths, found in zip(cases, expected):
        assert rows(listed_files.read_files(spark, [str(path) for path in paths], is_text())) == found


def test_paths_that_only_spark_knows(spark, folder):
    (folder / "parts" / "day=1" / "more").mkdir(parents=True)
    (folder / "parts" / "day=2").mkdir()
    (folder / "parts" / "day=1" / "more" / "x.txt").write_text("x")
    (folder / "parts" / "day=2" / "y.json").write_text("y")
    for path, count in (("*.txt", 4), ("{a.txt,n.json}", 2), ("parts", 2), ("parts/day=1/more", 1)):
        found = rows(listed_files.read_files(spark, f"{folder}/{path}", is_text()))
        assert found == by_spark(spark, folder / path) and len(found) == count
    assert rows(listed_files.read_files(spark, [], is_text())) == []
    for missing in (folder / "nothing", folder / "none" / "nothing", folder / "broken.txt"):
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            listed_files.read_files(spark, [str(folder), str(missing)], is_text())


def test_a_file_that_is_gone_is_an_error(spark, folder):
    found = listed_files.read_files(spark, str(folder), is_text())
    (folder / "a.txt").unlink()
    with pytest.raises(Exception, match="a.txt"):
        found.collect()


def test_entries_of_other_stores(folder):
    local = dict(listed_files._entries(fs.LocalFileSystem(), str(folder)))
    other = dict(listed_files._entries(fs.SubTreeFileSystem(str(folder.parent), fs.LocalFileSystem()), folder.name))
    assert local.pop("sub") is None and other.pop("sub", 0) is None
    other.pop("broken.txt", None)
    assert local == other


def test_uploads_are_bounded_on_the_driver(spark, tmp_path):
    """The plan names no upload, and small files share tasks; the reader opens them in small batches."""
    for n in range(600):
        (tmp_path / f"{n}.{'json' if n % 3 == 0 else 'txt'}").write_text(f"text {n}")
    found = documents.read_uploads(spark, str(tmp_path))
    assert len(found.inputFiles()) <= spark.sparkContext.defaultParallelism
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    texts = {row.source: (row.text, row.reason) for row in found.collect()}
    assert texts == {
        f"custom/{n}.{'json' if n % 3 == 0 else 'txt'}": (None, "Unsupported document type: .json") if n % 3 == 0 else (f"text {n}", None)
        for n in range(600)
    }


def test_paths_of_one_folder_are_looked_up_once(spark, tmp_path, monkeypatch):
    """A long list of files costs the driver no call for each."""
    for n in range(30):
        (tmp_path / f"{n}.txt").write_text(f"text {n}")
    asked = []
    known = listed_files._qualified
    monkeypatch.setattr(listed_files, "_qualified", lambda spark, path: asked.append(path) or known(spark, path))
    paths = [str(tmp_path / f"{n}.txt") for n in range(30)]
    assert rows(listed_files.read_files(spark, paths, is_text())) == by_spark(spark, *paths)
    assert asked == [str(tmp_path)]


def test_tasks_follow_bytes_and_files(spark, tmp_path, monkeypatch):
    for n in range(40):
        (tmp_path / f"{n}.txt").write_text("x" * 100)
    (tmp_path / "big.json").write_text("x" * 9_000)
    expected = by_spark(spark, tmp_path)
    for limits, tasks in (((1 << 20, 4), 11), ((400, 1_000), 10), ((1 << 20, 1_000), 4)):
        monkeypatch.setattr(listed_files, "TASK_BYTES", limits[0])
        monkeypatch.setattr(listed_files, "TASK_FILES", limits[1])
        found = listed_files.read_files(spark, str(tmp_path), is_text())
        assert found.rdd.getNumPartitions() == tasks
        assert rows(found) == expected


def test_batches_are_small(tmp_path):
    """A task holds few contents at a time, however many files it opens."""
    import pyarrow as pa

    for n in range(10):
        (tmp_path / f"{n}.txt").write_bytes(b"x" * (1 << 20))
    given = [{"path": f"p{n}", "uri": f"file://{tmp_path}", "name": f"{n}.txt", "length": 1 << 20, "wanted": True} for n in range(10)]
    batches = list(listed_files._read(iter([pa.RecordBatch.from_pylist(given)])))
    assert [batch.num_rows for batch in batches] == [4, 4, 2]


def test_query_over_pages_of_any_kind(spark, frame, tmp_path):
    pages = [(n, f"u{n}", f" <p>{n}</p>\n") for n in range(1, 130)] + [(3, "again", "<p>3</p>"), (None, "none", None)]
    frame("page_id long, url string, html string", *pages).write.parquet(str(tmp_path / "pages.parquet"))
    found = stored.read_uploads(DriverTables(spark, str(tmp_path)))
    assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    kinds = {(row.suffix, row.reason): row["count"] for row in found.groupBy("suffix", "reason").count().collect()}
    assert kinds == {
        (".json", "Unsupported document type: .json"): 131,
        (".txt", None): 117 + 1,
        (".txt", "No extractable text was found in the document."): 12 + 1,
    }
    assert found.where("text_md5 IS NULL").count() == 131 + 13
