"""Spelling variants: words one edit apart, found in a trie over letter-group counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import bound_batches
from cinderlog.sources.staging import broadcast_if_small, stage

LETTERS = r"[A-Za-z\x{C0}-\x{FF}]"
LEAST_LETTERS = 7
LEAST_COUNT = 2
# A form occurs so many times as often as its variant.
FACTOR = 10
# Levels of the trie.
GROUPS = 16
# Words of one cell, which is a subtree of the trie that one task holds.
CELL = 1 << 16
# Letters compared, and candidates listed, at once.
_CELLS_AT_ONCE = 1 << 21
_PAIRS_AT_ONCE = 1 << 19
_SHIFT = 31
# What a step down the trie may add to the count, and the state after it: no difference yet, one
# surplus, one surplus and one deficit.  The first difference is a surplus: of two words that differ
# exactly one finds the other.
_MOVES = {0: ((0, 0), (1, 1)), 1: ((0, 1), (-1, 2)), 2: ((0, 2),)}


class Words:
    """Words as one array of code points."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        self.size = np.array([len(word) for word in words], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __len__(self) -> int:
        return len(self.size)

    def rows_by_size(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """Positions in ``rows``, cut so that a matrix of the words stays small."""
        classes = np.frexp(self.size[rows].astype(float))[1]
        for bits in np.unique(classes):
            some = np.flatnonzero(classes == bits)
            step = max(1, _CELLS_AT_ONCE >> int(bits))
            yield from (some[k : k + step] for k in range(0, len(some), step))

    def letters(self, rows: np.ndarray, width: int, from_end: bool) -> np.ndarray:
        """The first (or last, backwards) ``width`` letters of words that are at least that long, else -1."""
        at = np.arange(width)
        places = (self.start[rows] + self.size[rows] - 1)[:, None] - at if from_end else self.start[rows][:, None] + at
        inside = at < self.size[rows][:, None]
        return np.where(inside, self.codes[np.where(inside, places, 0)], -1) if len(self.codes) else np.full(places.shape, -1)

    def ends(self, rows: np.ndarray, width: np.ndarray, from_end: bool) -> np.ndarray:
        """A hash of the first (or last) ``width`` letters of each word."""
        out = np.zeros(len(rows), dtype=np.uint64)
        for some in self.rows_by_size(rows):
            most = int(width[some].max(initial=0))
            power = np.cumprod(np.full(most, 0x9E3779B97F4A7C15, dtype=np.uint64))
            held = self.letters(rows[some], most, from_end)
            kept = np.where(np.arange(most) < width[some][:, None], held + 1, 0).astype(np.uint64)
            out[some] = (kept * power).sum(axis=1, dtype=np.uint64)
        return out


class Groups(NamedTuple):
    """Letters in order of their code points, and the group of each."""

    letters: np.ndarray
    group: np.ndarray

    def counts(self, words: Words) -> np.ndarray:
        own = self.group[np.searchsorted(self.letters, words.codes)]
        row = np.repeat(np.arange(len(words)), words.size)
        return np.bincount(row * GROUPS + own, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def balanced_groups(letters: np.ndarray, counts: np.ndarray) -> Groups:
    """Groups of about equal letter counts, the largest first: each letter joins the smallest so far."""
    total, group = np.zeros(GROUPS), np.zeros(len(letters), dtype=np.int64)
    for place in np.lexsort((letters, -counts)):
        group[place] = total.argmin()
        total[group[place]] += counts[place]
    rank = np.argsort(np.argsort(-total, kind="stable"), kind="stable")
    order = np.argsort(letters)
    return Groups(letters[order], rank[group[order]])


class Trie:
    """Vectors, or prefixes of them, arranged by successive counts."""

    def __init__(self, vectors: np.ndarray, depth: np.ndarray | None = None):
        depth = np.full(len(vectors), vectors.shape[1]) if depth is None else depth
        self.keys: list[np.ndarray] = []
        # Of the nodes of each level: the number of the leaf, or -1.
        self.leaves: list[np.ndarray] = []
        # The leaf of each given vector.
        self.leaf = np.zeros(len(vectors), dtype=np.int64)
        rows, node, nodes, found = np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64), 1, 0
        for level in range(int(depth.max(initial=0)) + 1):
            ends = depth[rows] == level
            which, leaf = np.unique(node[ends], return_inverse=True)
            leaves = np.full(nodes, -1)
            leaves[which] = found + np.arange(len(which))
            self.leaves.append(leaves)
            self.leaf[rows[ends]] = found + leaf
            found += len(which)
            rows, node = rows[~ends], node[~ends]
            if level < vectors.shape[1]:
                keys, node = np.unique((node << _SHIFT) + vectors[rows, level], return_inverse=True)
                self.keys.append(keys)
                nodes = len(keys)

    def search(self, vectors: np.ndarray, moves: dict = _MOVES) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Leaves that each vector reaches with at most one surplus and one deficit, depth first.

        All vectors go down together: a branch is taken once, by the vectors that can take it.
        """
        stack = [(0, 0, np.arange(len(vectors)), np.zeros(len(vectors), dtype=np.int64))]
        while stack:
            level, state, query, node = stack.pop()
            leaf = self.leaves[level][node]
            here = leaf >= 0
            if here.any():
                yield query[here], leaf[here], state
                query, node = query[~here], node[~here]
            if not len(query) or level == len(self.leaves) - 1:
                continue
            base, keys = (node << _SHIFT) + vectors[query, level], self.keys[level]
            for added, after in moves[state]:
                at = np.minimum(np.searchsorted(keys, base + added), len(keys) - 1)
                found = keys[at] == base + added
                if found.any():
                    stack.append((level + 1, after, query[found], at[found]))


def near(words: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pair of words differs by exactly one edit, and the length of their common start."""
    good, heads = np.zeros(len(a), dtype=bool), np.zeros(len(a), dtype=np.int64)
    shorter = np.minimum(words.size[a], words.size[b])
    for some in words.rows_by_size(a):
        width = int(shorter[some].max(initial=0)) + 1
        inside = np.arange(width) < shorter[some][:, None]
        head, tail = (
            ((words.letters(a[some], width, end) == words.letters(b[some], width, end)) & inside).argmin(axis=1)
            for end in (False, True)
        )
        apart = np.abs(words.size[a[some]] - words.size[b[some]])
        least = shorter[some]
        good[some] = np.where(apart == 0, (head < least) & (head + tail >= least - 1), (apart == 1) & (head + tail >= least))
        heads[some] = head
    return good, heads


class Cell:
    """Words of a subtree, with an index of each leaf's words by their first and last halves."""

    def __init__(self, words: Words, vectors: np.ndarray, index: np.ndarray):
        self.words, self.vectors, self.index = words, vectors, index
        self.trie = Trie(vectors[index])
        self.size = np.zeros(self.trie.leaf.max(initial=-1) + 1, dtype=np.int64)
        self.size[self.trie.leaf] = words.size[index]
        self.halves = []
        for from_end in (False, True):
            keys = self._key(words.ends(index, self._half(words.size[index]), from_end), self.trie.leaf)
            order = np.argsort(keys, kind="stable")
            self.halves.append((keys[order], order))

    @staticmethod
    def _half(size: np.ndarray) -> np.ndarray:
        """One edit leaves so many letters at one end alone, whichever of two words has ``size`` letters."""
        return np.maximum(0, (size - 1) // 2)

    @staticmethod
    def _key(ends: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        return ends * np.uint64(0xD6E8FEB86659FD93) + leaf.astype(np.uint64)

    def pairs(self, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Near pairs ``query, word, state`` as positions; state 0 comes from either side."""
        # A word meets leaves of its own length, and of one letter more.
        size = self.words.size[queries]
        ends = [
            [self.words.ends(queries, np.minimum(self._half(size + more), size), from_end) for more in (0, 1)]
            for from_end in (False, True)
        ]
        for query, leaf, state in self.trie.search(self.vectors[queries]):
            more = self.size[leaf] - size[query]
            for from_end in (False, True):
                keys, order = self.halves[from_end]
                key = self._key(np.where(more == 1, ends[from_end][1][query], ends[from_end][0][query]), leaf)
                low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                for some, places in _ranges(low, high):
                    word = order[places]
                    same = self.trie.leaf[word] == leaf[some]
                    some, word = some[same], word[same]
                    a, b = queries[query[some]], self.index[word]
                    good, heads = near(self.words, a, b)
                    if from_end:
                        # Those with the same first half were found by it.
                        good &= heads < self._half(self.words.size[b])
                    yield a[good], b[good], state


def _ranges(low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the ranges, repeated, with the places in them; a bounded number at once."""
    some = np.flatnonzero(high > low)
    sizes = (high - low)[some]
    batch = np.cumsum(sizes) // _PAIRS_AT_ONCE
    for part in np.split(np.arange(len(some)), np.flatnonzero(np.diff(batch)) + 1) if len(some) else ():
        own = np.repeat(some[part], sizes[part])
        ahead = np.cumsum(sizes[part]) - sizes[part]
        yield own, low[own] + np.arange(len(own)) - np.repeat(ahead, sizes[part])


def _partial(table: pa.Table, groups: Groups) -> pa.Table:
    """For the words of a cell: near words met here, and the most frequent of them."""
    listed = table["word"].to_pylist()
    words = Words(listed)
    n = table["n"].to_numpy()
    index, queries = (np.flatnonzero(table[name].to_numpy(zero_copy_only=False)) for name in ("index", "query"))
    # The better a word as a form, the earlier its place.
    order = sorted(range(len(listed)), key=lambda k: (-n[k], listed[k]))
    place = np.empty(len(listed), dtype=np.int64)
    place[order] = np.arange(len(listed))
    count, best = np.zeros(len(listed), dtype=np.int64), np.full(len(listed), len(listed))
    if len(index):
        for a, b, state in Cell(words, groups.counts(words), index).pairs(queries):
            np.add.at(count, a, 1)
            np.minimum.at(best, a, place[b])
            if state:
                np.add.at(count, b, 1)
                np.minimum.at(best, b, place[a])
    met = np.flatnonzero(count)
    chosen = [order[k] for k in best[met]]
    return pa.table(
        {
            "word": pa.array([listed[k] for k in met], pa.string()),
            "near": pa.array(count[met], pa.int64()),
            "form": pa.array([listed[k] for k in chosen], pa.string()),
            "form_n": pa.array(n[chosen] if chosen else [], pa.int64()),
        }
    )


def word_counts(words: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n`` of the words of a column ``word`` that are long and frequent enough; null is none."""
    long = words.where(F.length("word") >= least_letters)
    counted = long.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def letter_runs(documents: DataFrame, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """``doc_id, run``: maximal runs of Latin-1 letters of at least so many letters, A-Z lower-cased."""
    text = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{least_letters},}}"), F.lit(0))
    return documents.select("doc_id", F.explode(found).alias("run"))


def _letters(words: DataFrame) -> Groups | None:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters, counts = np.unique(Words(batch.column(0).to_pylist()).codes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(letters), pa.array(counts)], names=["letter", "n"])

    parts = words.select("word").mapInArrow(counted, "letter long, n long")
    rows = parts.groupBy("letter").agg(F.sum("n").alias("n")).sort("letter").collect()
    return balanced_groups(*(np.array([row[k] for row in rows], dtype=np.int64) for k in (0, 1))) if rows else None


def _cut(words: DataFrame, groups: Groups, count: int, cell: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefixes of vectors (padded), their depths, and parts: subtrees of at most ``cell`` words a part.

    A subtree with more words is cut one level further down; one vector with more of them has several parts.
    The result grows with the words divided by ``cell``.
    """
    done: list[tuple[list[int], int]] = []
    heavy = [[]] if count > cell else []
    if not heavy:
        done.append(([], count))
    while heavy:
        depth = len(heavy[0])
        trie = Trie(np.array(heavy, dtype=np.int64).reshape(len(heavy), depth))

        def counted(batches: Iterator[pa.RecordBatch], trie: Trie = trie, depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vectors = groups.counts(Words(batch.column(0).to_pylist()))
                inside = [query for query, _, _ in trie.search(vectors, {0: ((0, 0),)})]
                chosen = vectors[np.concatenate(inside)] if inside else vectors[:0]
                prefixes, counts = np.unique(chosen[:, : depth + 1], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prefixes.tolist(), pa.list_(pa.int64())), pa.array(counts)], names=["prefix", "n"]
                )

        parts = words.select("word").mapInArrow(counted, "prefix array<long>, n long")
        rows = parts.groupBy("prefix").agg(F.sum("n").alias("n")).sort("prefix").collect()
        deepest = depth + 1 == GROUPS
        done += [(row["prefix"], row["n"]) for row in rows if row["n"] <= cell or deepest]
        heavy = [row["prefix"] for row in rows if row["n"] > cell and not deepest]
    depth = np.array([len(prefix) for prefix, _ in done])
    vectors = np.zeros((len(done), GROUPS), dtype=np.int64)
    for row, (prefix, _) in enumerate(done):
        vectors[row, : len(prefix)] = prefix
    return vectors, depth, np.array([-(-n // cell) for _, n in done])


def near_words(counts: DataFrame, cell: int = CELL) -> DataFrame:
    """``word, n_near, form, form_n``: number and most frequent one of the words one edit away.

    ``counts`` (``word, n``, words distinct) is a staged or stored table.  One edit is an inserted, deleted
    or replaced code point; ties go to the smallest word.  Words without near words are left out.

    One edit changes the vector of letter-group counts by one surplus and one deficit at most.  Words are
    dealt out by the subtree of the vector trie they belong to; each word also goes to the subtrees that its
    search reaches, and is searched there.
    """
    bound_batches()
    empty = counts.sparkSession.createDataFrame([], "word string, n_near long, form string, form_n long")
    groups = _letters(counts)
    if groups is None:
        return empty
    vectors, depth, parts = _cut(counts, groups, counts.count(), cell)
    top = Trie(vectors, depth)
    parts_of = np.zeros(len(parts), dtype=np.int64)
    parts_of[top.leaf] = parts

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = groups.counts(Words(batch.column(0).to_pylist()))
            for query, leaf, state in top.search(own):
                rows = batch.take(pa.array(query))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(leaf), pa.array(parts_of[leaf]), pa.array(np.full(len(leaf), state == 0))],
                    names=["word", "n", "cell", "parts", "own"],
                )

    reached = counts.select("word", "n").mapInArrow(dealt, "word string, n long, cell long, parts long, own boolean")
    hashed = F.pmod(F.xxhash64("word"), F.col("parts"))
    each = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
    zero = F.lit(0).cast("long")

    def place(i, j, index, query):
        return F.struct(i.alias("i"), j.alias("j"), index.alias("index"), query.alias("query"))

    yes, no = F.lit(True), F.lit(False)
    grid = F.concat(
        F.transform(F.filter(each, lambda _: F.col("own")), lambda j: place(hashed, j, yes, no)),
        F.transform(each, lambda i: place(i, hashed, no, yes)),
    )
    spread = reached.select(
        "word", "n", "cell", F.inline(F.when(F.col("parts") == 1, F.array(place(zero, zero, F.col("own"), yes))).otherwise(grid))
    )
    met = spread.groupBy("cell", "i", "j").applyInArrow(
        lambda table: _partial(table, groups), "word string, near long, form string, form_n long"
    )
    best = F.min(F.struct((-F.col("form_n")).alias("order"), "form"))
    return met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("_best")).select(
        "word", "n_near", F.col("_best.form").alias("form"), (-F.col("_best.order")).alias("form_n")
    )


def group_variants(counts: DataFrame, factor: int = FACTOR, cell: int = CELL) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    A word's form is its most frequent near word (ties: the smallest), if that occurs at least ``factor`` times
    as often; ``root`` is the last word on the way from form to form, the word itself without one.

    ``counts`` has ``word`` and ``n``.  Repeated rows of a word are added up, null words and null counts
    dropped; other columns are ignored and an empty table gives an empty result.
    """
    summed = counts.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    words = stage(summed, "words")
    near_by = near_words(words, cell).select(F.col("word").alias("_word"), "n_near", "form", "form_n")
    joined = words.join(near_by, F.col("word") == F.col("_word"), "left")
    frequent = F.col("form_n") >= F.lit(factor) * F.col("n")
    formed = stage(
        joined.select(
            "word",
            F.when(frequent, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(frequent, F.col("form_n")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(formed.where("form IS NOT NULL").select("word", "form"))
    found = roots.select(F.col("word").alias("_word"), "root")
    return formed.join(broadcast_if_small(found), F.col("word") == F.col("_word"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def _roots(links: DataFrame) -> DataFrame:
    """Ends of the ways along ``word -> form``; counts grow along a way, so it ends, and ways double each round."""
    ways = stage(links.select("word", F.col("form").alias("root")), "ways")
    while True:
        further = ways.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        longer = stage(
            ways.join(broadcast_if_small(further), F.col("root") == F.col("_at"), "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "ways",
        )
        ways = longer.select("word", "root")
        if longer.where("_moved").isEmpty():
            return ways
