from cinderlog.sources import markdown_files

REPORT = "id string, part int, analysis_markdown string"


def texts(path):
    return {file.name: file.read_text() for file in path.glob("*.md")}


def test_one_file_a_report(frame, tmp_path):
    path = tmp_path / "out"
    rows = [("7", part, f"part {part}\n") for part in range(40, 0, -1)] + [
        ("8", 1, "é"), ("a/b", 1, None), (None, 1, "no name"), ("../x", 1, "inside"),
    ]
    markdown_files.export_markdown(frame(REPORT, *rows).repartition(9), str(path))
    assert texts(path) == {
        "7.md": "".join(f"part {part}\n" for part in range(1, 41)) + "\n",
        "8.md": "é\n", "a%2Fb.md": "\n", "%2E.%2Fx.md": "inside\n",
    }
    assert (path / "_SUCCESS").exists() and not list(path.glob("_?" + "?" * 31))
    markdown_files.export_markdown(frame(REPORT, ("8", 1, "new"), ("9", 1, "more")), str(path), overwrite=False)
    assert (texts(path)["8.md"], texts(path)["9.md"], len(texts(path))) == ("new\n", "more\n", 5)
    markdown_files.export_markdown(frame("id long, analysis_markdown string", (1, "only")), str(path))
    assert texts(path) == {"1.md": "only\n"}


def test_tasks_that_are_tried_again(tmp_path):
    """A try that breaks off leaves a hidden file that nobody reads and that the commit removes."""
    path = tmp_path / "out"
    writer = markdown_files.MarkdownWriter(str(path), False)

    def broken():
        yield ("1", "first half, ", 1)
        raise RuntimeError("executor lost")

    try:
        writer.write(broken())
        raise AssertionError("the try should have failed")
    except RuntimeError:
        pass
    assert texts(path) == {}
    rows = [("1", "first half, ", 1), ("1", "second half", 2), ("2", "other", 1)]
    for _ in range(2):
        message = writer.write(iter(rows))
    assert message.files == 2
    writer.commit([message])
    assert texts(path) == {"1.md": "first half, second half\n", "2.md": "other\n"}
    assert sorted(file.name for file in path.iterdir()) == ["1.md", "2.md", "_SUCCESS"]


def test_rows_as_files_of_text(spark, frame, tmp_path):
    """Bytes that are no UTF-8 go through; rows stay where they are, and nothing unfinished is left."""
    path = tmp_path / "out"
    rows = frame("name string, text string", ("a", "é"), ("b", None), ("c", "x\ny"))
    odd = spark.range(1).selectExpr("'d' AS name", "CAST(X'FF41' AS STRING) AS text")
    markdown_files.export_texts(rows.repartition(3).unionByName(odd), str(path), ".txt")
    files = {file.name: file.read_bytes() for file in path.iterdir()}
    assert files.pop("_SUCCESS") == b""
    assert files == {"a.txt": "é\n".encode(), "b.txt": b"\n", "c.txt": b"x\ny\n", "d.txt": b"\xffA\n"}


def test_pages_become_files_in_many_tasks(spark, frame, tmp_path):
    """A page table of one piece is dealt out; pages with one id, or none, have files of their own."""
    from cinderlog.plans import stored
    from cinderlog.plans.driver_tables import DriverTables

    pages = [(n, f"u{n}", f"<p>{n}</p>") for n in range(1, 30)] + [(3, "again", "<p>again</p>"), (None, "none", None)]
    frame("page_id long, url string, html string", *pages).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    path = stored._page_files(DriverTables(spark, str(tmp_path)))
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(f"{path}/text").collect()
    blank = [b" \t\n"] * 2
    assert sorted(bytes(row.content) for row in found) == sorted(
        [b"\n", *blank, *(html.encode() + b"\n" for n, _, html in pages if html and n % 10)]
    )
    tasks = {int(row.path.rpartition("part-")[2][:-4]) >> 33 for row in found}
    assert len(tasks) == spark.sparkContext.defaultParallelism
    ids = spark.read.text(f"{path}/json").collect()
    assert sorted(row.value for row in ids) == sorted("{}" if n is None else f'{{"page_id":{n}}}' for n, _, _ in pages)
