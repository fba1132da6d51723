import random
import zlib
from collections import Counter

import numpy as np
import pytest

from cinderlog.llm import queries, spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def by_hand(counts, factor=10):
    near = {word: [other for other in counts if one_edit(word, other)] for word in counts}
    best = {word: min(found, key=lambda o: (-counts[o], o)) for word, found in near.items() if found}
    form = {word: other for word, other in best.items() if counts[other] >= factor * counts[word]}
    rows = set()
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        rows.add((word, form.get(word), root, n, len(near[word]), counts[form[word]] if word in form else None))
    return rows


def variants(chosen, alphabet, count, sizes):
    """Words and many of their variants, so that near words are common."""
    words = {"".join(chosen.choices(alphabet, k=chosen.choice(sizes))) for _ in range(count)}
    for word in list(words):
        for _ in range(2):
            at = chosen.randrange(len(word) + 1)
            words.add(word[:at] + word[at + 1 :])
            words.add(word[:at] + chosen.choice(alphabet) + word[at + chosen.randrange(2) :])
    return {word: chosen.choice((1, 1, 2, 3, 9, 25, 40, 400, 5000)) for word in words}


def grouped(frame, counts, **options):
    rows = spelling.group_variants(frame("word string, n long, form int, root string", *((w, n, 1, "x") for w, n in counts.items())), **options)
    got = rows.collect()
    assert len(got) == len(counts)
    return {tuple(row) for row in got}


@pytest.mark.parametrize(
    "alphabet, sizes, cell", [("abcdefghijklmnopqrstuvwxyzéüß", (5, 6, 7), 40), ("abc", (3, 4, 6), 7), ("ab中\U0001f600", (1, 2, 9), 1000)]
)
def test_against_all_pairs(frame, monkeypatch, alphabet, sizes, cell):
    monkeypatch.setattr(spelling, "_PAIRS_AT_ONCE", 16)
    counts = variants(random.Random(cell), alphabet, 60, sizes)
    want = by_hand(counts)
    assert sum(row[4] for row in want) > 40 and any(row[1] and row[2] != row[1] for row in want)
    assert grouped(frame, counts, cell=cell) == want


def test_one_vector_with_most_words(frame):
    """Anagrams share a vector: it is cut into parts, and all parts meet."""
    chosen = random.Random(2)
    words = {"".join(chosen.sample("abcdefgh", 8)) for _ in range(60)}
    words |= {word[:3] + word[4:] for word in list(words)[:20]} | {word + "h" for word in list(words)[:20]}
    counts = {word: 1 + k * k for k, word in enumerate(sorted(words))}
    assert grouped(frame, counts, cell=4) == by_hand(counts)


def test_odd_words(frame):
    counts = {"": 500, "a": 40, "b": 3, "ab": 4, "x" * 3000: 7, "x" * 2999: 80, "x" * 1500 + "y" + "x" * 1500: 1, "\u0000a": 1}
    assert grouped(frame, counts) == by_hand(counts)
    rows = [("abc", 1), ("abc", 2), (None, 5), ("abd", None), ("abx", 30)]
    got = spelling.group_variants(frame("word string, n long", *rows)).collect()
    assert {tuple(row) for row in got} == by_hand({"abc": 3, "abx": 30})
    assert spelling.group_variants(frame("word string, n long", *rows).where("false")).count() == 0


def test_trie_reaches_what_differs_by_one_each():
    chosen = np.random.default_rng(3)
    vectors = np.unique(chosen.integers(0, 3, size=(300, spelling.GROUPS)) * (chosen.random((300, spelling.GROUPS)) < 0.3), axis=0)
    trie = spelling.Trie(vectors)
    got = set()
    for query, leaf, state in trie.search(vectors):
        got |= {(int(q), int(x), state) for q, x in zip(query, leaf)}
    row_of = {int(leaf): row for row, leaf in enumerate(trie.leaf)}
    want = set()
    for q in range(len(vectors)):
        for leaf, row in row_of.items():
            apart = vectors[row] - vectors[q]
            changed = apart[apart != 0].tolist()
            if changed in ([], [1], [1, -1]):
                want.add((q, leaf, len(changed)))
    assert got == want


def test_letter_runs(frame):
    rows = [(1, "ABCdefghÉüx y ABCDEFGőhij 12abcdefg"), (2, None), (3, ""), (None, "×÷abcdefg")]
    got = {tuple(r) for r in spelling.letter_runs(frame("doc_id long, text string", *rows)).collect()}
    assert got == {(1, "abcdefghÉüx"), (1, "abcdefg"), (None, "×÷abcdefg")}


def test_query_over_whole_table(spark):
    """Against words counted here; near words by what is left when one letter is taken out."""
    folder = "/root/testdata/sf0.001"
    counts = Counter()
    for row in spark.read.parquet(f"{folder}/documents.parquet").collect():
        run = ""
        for letter in (row.text or "") + " ":
            if letter.isascii() and letter.isalpha() or "À" <= letter <= "ÿ":
                run += letter.lower() if letter.isascii() else letter
                continue
            if run:
                value = zlib.crc32(f"{row.doc_id}:{run}".encode())
                at = value % len(run)
                counts[run[:at] + run[at + 1 :] if value % 31 == 0 else run] += 1
            run = ""
    counts = {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}
    holes = {}
    for word in counts:
        for k in range(len(word)):
            holes.setdefault(word[:k] + "*" + word[k + 1 :], set()).add(word)
    near = {word: set() for word in counts}
    for word in counts:
        for k in range(len(word)):
            near[word] |= holes[word[:k] + "*" + word[k + 1 :]]
            shorter = word[:k] + word[k + 1 :]
            if shorter in counts:
                near[word].add(shorter)
                near[shorter].add(word)
        near[word].discard(word)
    got = {row.word: row for row in queries.QUERIES["op11_spelling_variants"](spark, folder).collect()}
    assert set(got) == set(counts)
    for word, row in got.items():
        assert (row.n, row.n_near) == (counts[word], len(near[word]))
        best = min(near[word], key=lambda other: (-counts[other], other), default=None)
        frequent = best is not None and counts[best] >= 10 * counts[word]
        assert (row.form, row.form_n) == ((best, counts[best]) if frequent else (None, None))
        assert row.root == (got[row.form].root if row.form else word)
