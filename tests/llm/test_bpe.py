import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from cinderlog.llm import bpe, queries

PATTERN = public_tokenizers.PATTERN
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


def content_of(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def packed(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.mark.parametrize("name", VOCABULARIES)
def test_random_texts_as_the_library(name):
    own = bpe.encoder(content_of(name), PATTERN)
    other = library(bpe.read_ranks(content_of(name)))
    chosen = random.Random(7)
    alphabets = ["ab", "etaoin ", "aA1 .\n\t'sd", "éüß中文 日本　", "=-_ ", "՘౜\U00016a70\U000323b0 a1!", "\U0001f600x‍ "]
    for _ in range(6000):
        alphabet = chosen.choice(alphabets)
        text = "".join(chosen.choices(alphabet, k=chosen.randint(0, 80)))
        assert own.encode(text) == packed(other.encode_ordinary(text)), text
        assert own.decode(own.encode(text)) == text.encode()


def test_long_runs_take_linear_time_and_come_back():
    own = bpe.encoder(content_of(VOCABULARIES[0]), PATTERN)
    other = library(bpe.read_ranks(content_of(VOCABULARIES[0])))
    chosen = random.Random(3)
    letters = "".join(chosen.choices("etaoinsr", k=20_000))
    assert own.encode(letters) == packed(other.encode_ordinary(letters))
    for text in ("x" * 1_500_000, "=" * 300_000, " " * 300_000 + "a", letters * 20, "word " * 400_000):
        assert own.decode(own.encode(text)) == text.encode()


def test_small_vocabularies_against_plain_merging():
    """Vocabularies grown by random merges; the plain way merges the least rank until none is left."""

    def plain(ranks, piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            places = [k for k in range(len(parts) - 1) if parts[k] + parts[k + 1] in ranks]
            if not places or piece in ranks:
                return [ranks[piece]] if piece in ranks else [ranks[part] for part in parts]
            at = min(places, key=lambda k: (ranks[parts[k] + parts[k + 1]], k))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    chosen = random.Random(11)
    for _ in range(60):
        ranks = {bytes([byte]): byte for byte in range(256)}
        made = [b"a", b"b", b"c"]
        while len(made) < 25:
            token = chosen.choice(made) + chosen.choice(made)
            # As in training: a merge joins what the earlier merges leave side by side.
            if token not in ranks and len(plain(ranks, token)) == 2:
                ranks[token] = 231 + len(made) + 25
                made.append(token)
        own = bpe.Encoder(ranks, PATTERN)
        for _ in range(150):
            piece = bytes(chosen.choices(b"abc", k=chosen.randint(1, 24)))
            assert own.merge(piece) == plain(ranks, piece), piece


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 50)
    own = bpe.Encoder(bpe.read_ranks(content_of(VOCABULARIES[0])), PATTERN)
    text = " ".join(f"qz{k}k" for k in range(400)) + " " + "y" * 500
    assert own.decode(own.encode(text)) == text.encode()
    for memo in (own.packed, own.compatible):
        assert 0 < len(memo) + len(memo.before) <= 50
    assert all(len(piece) <= 48 for piece in (*own.packed, *own.packed.before))


def test_vocabulary_must_hold_all_bytes(tmp_path, frame):
    path = tmp_path / "ranks"
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError, match="no token"):
        bpe.encoder(path.read_bytes(), PATTERN)


def test_odd_rows(frame):
    rows = [(1, None, "t", 5), (2, "", "t", None), (3, "a" * 100_000, None, 1), (3, "a" * 100_000, None, 1), (None, " \n ", "x", 0)]
    vocabulary = public_tokenizers.path(VOCABULARIES[0])
    given = frame("doc_id long, text string, token_ids string, decoded int", *rows)
    done = bpe.decode(bpe.encode(given, vocabulary, PATTERN), vocabulary, PATTERN)
    got = sorted((r.doc_id or 0, bytes(r.token_ids), bytes(r.decoded)) for r in done.collect())
    other = library(bpe.read_ranks(content_of(VOCABULARIES[0])))
    want = sorted((k or 0, packed(other.encode_ordinary(t or "")), (t or "").encode()) for k, t, _, _ in rows)
    assert got == want
    empty = given.where("false")
    assert bpe.encode(empty, vocabulary, PATTERN).count() == 0


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    other = library(bpe.read_ranks(content_of(VOCABULARIES[0])))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.QUERIES["op13_byte_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = other.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(packed(ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()
