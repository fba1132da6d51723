import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cinderlog.operators import chunks, embedding, index
from cinderlog.sources import documents, tables


def sections(frame, *texts):
    rows = frame("source string, text string", *enumerate_texts(texts))
    found = chunks.split_sections(rows).orderBy("source", "section").collect()
    return [(row.heading, row.content) for row in found]


def enumerate_texts(texts):
    return [(f"{number:03d}", text) for number, text in enumerate(texts)]


def test_sections(frame):
    assert sections(frame, "# Disk full\nWhat happens\n### Clean up\nRotate files") == [
        ("Disk full", "What happens"), ("Clean up", "Rotate files"),
    ]
    assert sections(frame, "before\r\n\r\n#A \x0btext\n# Empty\n##\nno title\n #no") == [
        ("Overview", "before"), ("A", "text"), ("", "no title\n #no"),
    ]
    assert sections(frame, " \n\t") == []


def packed(frame, text, size):
    row = frame("t string", (text,)).select(chunks.pack_paragraphs(chunks.F.col("t"), size)).first()
    return row[0]


def test_packing(frame):
    assert [len(part) for part in packed(frame, "z" * 31, 12)] == [12, 12, 7]
    assert packed(frame, "aaaa\n\nbbb\n\n" + "c" * 12 + "\n\ndd", 10) == [
        "aaaa\n\nbbb", "c" * 10, "cc", "dd",
    ]
    assert packed(frame, " \n\n ", 10) == []


def expected_chunks(text, size):
    """The chunking rules, stated over plain lists."""
    headings = [(0, "Overview")]
    lines = text.split("\n")
    headings += [(n + 1, line.lstrip("#").strip()) for n, line in enumerate(lines) if line[:1] == "#"]
    ends = [start - 1 for start, _ in headings[1:]] + [len(lines)]
    labels, result = [], []
    for (start, heading), end in zip(headings, ends):
        parts, room = [], False
        for paragraph in "\n".join(lines[start:end]).strip().split("\n\n"):
            paragraph = paragraph.strip()
            if not paragraph:
                continue
            if len(paragraph) > size:
                parts += [paragraph[n : n + size] for n in range(0, len(paragraph), size)]
                room = False
            elif room and len(parts[-1]) + 2 + len(paragraph) <= size:
                parts[-1] += "\n\n" + paragraph
            else:
                parts.append(paragraph)
                room = True
        for number, part in enumerate(parts, start=1):
            label = heading if len(parts) == 1 else f"{heading} (part {number})"
            labels.append(label)
            seen = labels.count(label)
            result.append((label if seen == 1 else f"{label} ({seen})", part))
    return result


TEXT_PIECES = st.sampled_from(
    ["# A\n", "## A\n", "#\n", "#B\n", "one", "two words", "x" * 9, "\n", "\n\n", " ", "é" * 7, "\n# A\nq"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(TEXT_PIECES, max_size=25).map("".join), min_size=30, max_size=40))
def test_chunks_follow_the_rules(spark, texts):
    rows = spark.createDataFrame(enumerate_texts(texts), "source string, text string")
    found = {}
    for row in chunks.chunk_documents(rows, 20).orderBy("source", "position").collect():
        found.setdefault(row.source, []).append((row.heading, row.content))
    for source, text in enumerate_texts(texts):
        assert found.get(source, []) == expected_chunks(text, 20)


def test_whole_long_document_is_chunked(frame):
    text = "\n".join(f"# S{n % 7}\n" + "word " * 700 for n in range(60))
    rows = chunks.chunk_documents(frame("source string, text string", ("a", text))).collect()
    assert len({row.heading for row in rows}) == len(rows) == 180
    assert "".join(row.content for row in rows).count("word") >= 60 * 700 - 120


def test_uploads(spark, tmp_path):
    (tmp_path / "Notes.TXT").write_bytes(b"\xef\xbb\xbf hello \xff \n")
    (tmp_path / "empty.md").write_bytes(b" \n")
    (tmp_path / "run.exe").write_bytes(b"x")
    (tmp_path / "plain").write_bytes(b"x")
    (tmp_path / "scan.pdf").write_bytes(b"%PDF")
    with open(tmp_path / "big.txt", "wb") as file:
        file.write(b"a" * (10 * 1024 * 1024 + 1))
    rows = documents.read_uploads(spark, str(tmp_path)).collect()
    found = {row.source: (row.text, row.reason) for row in rows}
    assert found == {
        "custom/Notes.TXT": ("hello �", None),
        "custom/empty.md": (None, "No extractable text was found in the document."),
        "custom/run.exe": (None, "Unsupported document type: .exe"),
        "custom/plain": (None, "Unsupported document type: none"),
        "custom/scan.pdf": (None, "Unsupported document type: .pdf"),
        "custom/big.txt": (None, "Document exceeds the 10 MB local indexing limit."),
    }


def test_source_names(frame):
    from cinderlog.functions.text import source_name

    names = ["../runbook.md", " a b.txt ", "x\\y.md", "/", "dir/sub/"]
    row = [
        frame("p string", (name,)).select(source_name(documents.F.col("p"))).first()[0]
        for name in names
    ]
    assert row == ["custom/runbook.md", "custom/a b.txt", "custom/x_y.md", None, "custom/sub"]


def test_index_at_rest(spark, frame, tmp_path):
    folder = tmp_path / "runbooks"
    folder.mkdir()
    (folder / "b.md").write_text("# One\nalpha\n# Two\nbeta")
    (folder / "a.md").write_text("only text")
    (folder / "skip.txt").write_text("no")
    embed = embedding.hashed_words(16)
    path = str(tmp_path / "index")
    assert tables.read_chunks(spark, path).count() == 0

    tables.write_chunks(index.build_index(documents.read_runbooks(spark, str(folder)), embed), path)
    rows = tables.read_chunks(spark, path).orderBy("id").collect()
    assert [(r.id, r.source, r.heading) for r in rows] == [
        (1, "a.md", "Overview"), (2, "b.md", "One"), (3, "b.md", "Two"),
    ]
    assert len(rows[0].embedding) == 16

    new = frame("source string, text string", ("b.md", "fresh"), ("custom/c.txt", "# H\nmore"))
    counts = {r.source: r.chunk_count for r in tables.replace_in_table(new, path, embed).collect()}
    assert counts == {"b.md": 1, "custom/c.txt": 1}
    stored = tables.read_chunks(spark, path)
    assert [(r.source, r.chunk_count, r.kind) for r in index.list_sources(stored).collect()] == [
        ("a.md", 1, "Built-in"), ("b.md", 1, "Built-in"), ("custom/c.txt", 1, "Custom"),
    ]
    assert [r.id for r in stored.orderBy("id").collect()] == [1, 4, 5]
    assert index.duplicate_keys(stored).count() == 0

    assert tables.delete_from_table(spark, path, "b.md") == 1
    assert tables.delete_from_table(spark, path, "b.md") == 0
    assert index.chunk_count(tables.read_chunks(spark, path)).first().chunk_count == 2
    row = index.source_chunks(tables.read_chunks(spark, path), "custom/c.txt").first()
    assert (row.heading, row.content, row.score) == ("H", "more", 1.0)

    with pytest.raises(ValueError, match="extractable"):
        tables.replace_in_table(frame("source string, text string", ("e", " ")), path, embed)


def test_keys_are_kept_unique(spark, frame, tmp_path):
    embed = embedding.hashed_words(8)
    path = str(tmp_path / "index")
    schema = "source string, text string"
    twice = frame("path string, source string, text string", ("a/r.md", "custom/r.md", "one"),
                  ("b/r.md", "custom/r.md", "# H\ntwo"), ("c", "x.md", "three"))
    built = index.build_index(twice, embed).orderBy("id").collect()
    assert [(r.id, r.source, r.content) for r in built] == [(1, "custom/r.md", "two"), (2, "x.md", "three")]
    tables.write_chunks(index.build_index(twice, embed), path, buckets=4)

    # A numbered heading can meet one that is spelled with the same number.
    clash = frame(schema, ("x.md", "# A\n1\n# A\n2\n# A (2)\n3"))
    if index.duplicate_keys(index.build_index(clash, embed)).count():
        with pytest.raises(ValueError, match="occurs 2 times"):
            tables.replace_in_table(clash, path, embed)
    same = tables.read_chunks(spark, path)
    with pytest.raises(ValueError, match="occurs 2 times"):
        tables.write_chunks(same.unionByName(same), path)
    assert sorted(r.id for r in tables.read_chunks(spark, path).collect()) == [1, 2]
    repeated = frame(schema, ("y.md", "first"), ("y.md", "second"))
    tables.replace_in_table(repeated, path, embed)
    stored = tables.read_chunks(spark, path).filter("source = 'y.md'").collect()
    assert [(r.id, r.content) for r in stored] == [(3, "second")]
    assert tables.delete_from_table(spark, path, "y.md") == 1
    assert spark.read.parquet(path).filter("id is null").count() == 0
    tables.replace_in_table(repeated, path, embed)
    assert tables.read_chunks(spark, path).agg({"id": "max"}).first()[0] == 4


def test_embedder_from_a_function(frame):
    embed = embedding.from_function(lambda text: [float(len(text)), 1.0])
    row = embed(frame("text string", ("abc",))).first()
    assert list(row.embedding) == [3.0, 1.0]


def test_embedder_that_counts_terms(frame):
    embed = embedding.term_counts(["aa", "B."])
    rows = embed(frame("text string", ("aaa B. b. B.",), ("",), (None,))).collect()
    assert [list(row.embedding) for row in rows] == [[1.0, 2.0], [0.0, 0.0], [0.0, 0.0]]
    with pytest.raises(ValueError, match="empty"):
        embedding.term_counts(["a", ""])
