from pyspark.sql import functions as F

from cinderlog.operators import embedding, index
from cinderlog.sources import tables


def counting(spark):
    """An embedder that notes the texts it is called for."""
    calls = spark.sparkContext.accumulator(0)

    def embed(text):
        calls.add(1)
        return [float(len(text)), float(text.count("e"))]

    return embedding.from_function(embed), calls


def vectors(spark, path):
    return {(r.source, r.heading): list(r.embedding) for r in tables.read_chunks(spark, path).collect()}


def test_only_changed_sections_are_embedded(spark, frame, tmp_path):
    path = str(tmp_path / "index")
    embed, calls = counting(spark)
    schema = "source string, text string"
    old = [(f"d{k}", f"# A\nfirst {k}\n# B\nsecond {k}\n# C\nthird") for k in range(6)]
    tables.write_chunks(index.build_index(frame(schema, *old), embed), path, embedder="lengths")
    assert calls.value == 18
    before = vectors(spark, path)
    calls.value = 0
    new = frame(schema, ("d1", "# A\nfirst 1\n# B\nsecond, changed\n# C\nthird"), ("d9", "# C\nthird\n# D\nnew"))
    assert {tuple(r) for r in tables.replace_in_table(new, path, embed, "lengths").select("source", "chunk_count").collect()} == {
        ("d1", 3), ("d9", 2),
    }
    # The changed section and the one new text; the text that another document of the batch has is known.
    assert calls.value == 2
    after = vectors(spark, path)
    assert after == before | {
        ("d1", "B"): [17.0, 2.0], ("d9", "C"): before["d1", "C"], ("d9", "D"): [5.0, 1.0],
    }
    calls.value = 0
    tables.replace_in_table(new, path, embed, "lengths")
    assert calls.value == 0 and vectors(spark, path) == after
    # Another embedder, or one without a name, is called for everything, also afterwards.
    tables.replace_in_table(new, path, embed, "other")
    assert calls.value == 5
    calls.value = 0
    tables.replace_in_table(new, path, embed, "other")
    assert calls.value == 5


def test_texts_that_repeat(spark, frame):
    embed, calls = counting(spark)
    rows = [(n, "same" if n % 3 else f"h{n}", "text") for n in range(30)]
    chunks = frame("id long, heading string, content string", *rows)
    known = frame(
        "heading string, content string, embedding array<float>",
        ("h0", "text", [1.0]), ("h0", "text", [1.0]), ("h3", "text", None), ("other", "text", [5.0]),
    )
    found = {r.id: list(r.embedding) for r in index.embed_unseen(chunks, known, embed).collect()}
    assert len(found) == 30 and found[0] == [1.0] and found[3] == [7.0, 1.0]
    assert calls.value == 10
    assert index.embed_unseen(chunks.where("false"), known, embed).count() == 0
    assert index.embed_unseen(chunks, known.where("false"), embed).where(F.size("embedding") == 2).count() == 30
