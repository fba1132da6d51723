"""The corpus pipeline: each stage against what it has to do with its own input."""

from zlib import crc32

import pytest
from test_matches import WORDS, base_by_hand, components_of, entropy_by_pieces, hit_words, lowered, print_of

import corpus_pipeline
from cinderlog.llm import mixing, quality

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def passed(spark, tmp_path_factory):
    """Input and output rows of every stage."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = []
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        result = apply(spark, docs, FOLDER)
        result.write.parquet(f"{root}/{k}")
        after = spark.read.parquet(f"{root}/{k}")
        out.append((name, docs.columns, after.columns, docs.collect(), after.collect()))
        docs = after
    return out


def test_names_and_columns(passed):
    assert [name for name, *_ in passed] == [
        "quality classifier", "SimHash near-dedup", "benchmark decontamination", "secret scans",
        "mixing sources to target weights",
    ]
    assert all(after == before for _, before, after, _, _ in passed[:4])


def test_rejected_documents_go(spark, passed):
    before, after = passed[0][3:]
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    known = {r.doc_id: r.quality for r in labels}
    frame = spark.createDataFrame([r for r in labels if crc32(str(r.doc_id).encode()) % 4 != 2])
    model = quality.learn(spark.createDataFrame(before), frame)
    scores = model.score([(r.text or "").encode() for r in before])[0]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores) if s >= 0.7)
    good = [r.doc_id for r in before if known.get(r.doc_id) == 1]
    assert len({*good} & {r.doc_id for r in after}) > 0.95 * len(good)


def test_one_of_each_group_stays(passed):
    before, after = passed[1][3:]
    rows = sorted(before, key=lambda r: r.doc_id)
    groups = components_of([print_of(r.text) for r in rows])
    assert sorted(r.doc_id for r in after) == [rows[k].doc_id for k in sorted(set(groups))]


def test_no_passage_is_left(spark, passed):
    before, after = passed[2][3:]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()][:15]
    kept = {r.doc_id: r for r in after}
    for row in before:
        n_words, hits, _ = hit_words(row.text, items, 10)
        if row.doc_id in kept:
            assert not hit_words(kept[row.doc_id].text, items, 10)[1]
        else:
            assert n_words > 0
        if not hits and row.doc_id in kept and "benchmark" not in row.text:
            assert len(kept[row.doc_id].text) <= len(row.text)


def test_secrets_are_masked(passed):
    before, after = passed[3][3:]
    texts = {r.doc_id: r.text for r in after}
    assert len(before) == len(after)
    for row in before:
        spans = base_by_hand(row.text)
        spans = spans + entropy_by_pieces(row.text, spans)
        assert (texts[row.doc_id] == row.text) == (not spans)
        assert all(row.text[a:b] not in texts[row.doc_id] for a, _, b in spans)


def test_mix_takes_what_is_planned(spark, passed):
    before, after = passed[4][3:]
    planned = mixing.plan_mix(spark.createDataFrame(before)).collect()
    copies = {r.doc_id: r.copies for r in planned if r.copies}
    counted = {}
    for row in after:
        counted[row.doc_id] = counted.get(row.doc_id, 0) + 1
    assert counted == copies


def test_run_gives_the_last_stage(spark, passed):
    result = corpus_pipeline.run(spark, FOLDER)
    assert result.columns == passed[4][2]
    assert result.count() == len(passed[4][4])


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, apply in corpus_pipeline.STAGES:
        assert apply(spark, docs, FOLDER).count() == 0


def hit_by_hand(words, items, window=10):
    """Places of words inside an occurrence of an item's window, or of a whole shorter item."""
    known = {}
    for own in items:
        size = min(window, len(own))
        known.setdefault(size, set()).update(tuple(own[k : k + size]) for k in range(len(own) - size + 1 if size else 0))
    hits = set()
    for size, runs in known.items():
        for at in range(len(words) - size + 1):
            if tuple(words[at : at + size]) in runs:
                hits.update(range(at, at + size))
    return hits


def cut_by_hand(text, items):
    """The text without runs of hit words, until nothing is hit."""
    while True:
        found = list(WORDS.finditer(lowered(text)))
        hits = hit_by_hand([m.group() for m in found], items)
        if not hits:
            return text
        kept, at = [], 0
        for k in sorted(hits):
            if k - 1 not in hits:
                kept.append(text[at : found[k].start()])
            at = found[k].end()
        text = "".join([*kept, text[at:]])


def test_documents_are_dropped_and_cut_exactly(spark, passed):
    before, after = passed[2][3:]
    items = [WORDS.findall(lowered(r.text)) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    assert len(items) == 40
    expected, dropped, cut = {}, 0, 0
    for row in before:
        words = WORDS.findall(lowered(row.text))
        hits = hit_by_hand(words, items)
        if 2 * len(hits) > len(words):
            dropped += 1
            continue
        expected[row.doc_id] = cut_by_hand(row.text, items) if hits else row.text
        cut += bool(hits)
    assert {r.doc_id: r.text for r in after} == expected
    assert len(after) == len(expected)
    assert cut and len(expected) > cut
    print("dropped", dropped, "cut", cut, "kept", len(expected))
