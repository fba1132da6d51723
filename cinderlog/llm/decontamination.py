"""Benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf, rounds
from cinderlog.sources.staging import stage

WINDOW = 10
# Item words of one automaton; more items are matched in several blocks, one after the other.
BLOCK_WORDS = 50_000
# Longer items are cut into pieces that overlap by a window less one word.
PIECE_WORDS = 5_000
# A document of which more than this part is hit goes as a whole.
MOST_HIT = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bytes of words stay, in lower case; every other byte is a space.
_TO_WORDS = bytes(
    code + 32 if 65 <= code <= 90 else code if code >= 128 or 48 <= code <= 57 or 97 <= code <= 122 else 32
    for code in range(256)
)
_WORD_BYTES = re.compile(rb"[^ ]+")


class SuffixAutomaton:
    """Accepts every run of words that occurs in some item.

    ``next``, ``link`` and ``length`` are the automaton's transitions, suffix links and longest
    lengths.  ``items`` names the items that hold a state's words, for states a window can be in.
    """

    def __init__(self, pieces: Iterable[tuple[str, list[bytes], int]], window: int = WINDOW) -> None:
        """``pieces``: item name, words, and the words of the whole item."""
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        self._suffixes: dict[int, list[tuple[int, set[str]]]] = {}
        held = [
            (name, [self.vocabulary.setdefault(word, len(self.vocabulary)) for word in words], whole)
            for name, words, whole in pieces
            if words
        ]
        pairs = set()
        for _, words, _ in held:
            last = 0
            for word in words:
                last = self._extend(last, word)
            pairs.update(zip(words, words[1:]))
        self.least = min((min(window, whole) for _, _, whole in held), default=window)
        size = max(1, len(self.vocabulary))
        self.pairs = np.array(sorted(a * size + b for a, b in pairs), dtype=np.int64)
        for name, words, whole in held:
            self._mark(name, words, whole)

    def _extend(self, last: int, word: int) -> int:
        """The state of the item's words so far and ``word``."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        state = self._add(self.length[last] + 1, {}, 0)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = state
            at = self.link[at]
        if at != -1:
            target = self.next[at][word]
            fits = self.length[target] == self.length[at] + 1
            self.link[state] = target if fits else self._clone(at, word, target)
        return state

    def _add(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.link) - 1

    def _clone(self, at: int, word: int, target: int) -> int:
        copy = self._add(self.length[at] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while at != -1 and self.next[at].get(word) == target:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def _mark(self, name: str, words: list[int], whole: int) -> None:
        state = 0
        for word in words:
            state = self.next[state][word]
            above = state
            while above > 0 and self.length[above] >= self.window:
                named = self.items.setdefault(above, set())
                if name in named:
                    break
                named.add(name)
                above = self.link[above]
        if whole < self.window:
            self.short.setdefault(state, (whole, set()))[1].add(name)

    def _short_suffixes(self, state: int) -> list[tuple[int, set[str]]]:
        """Short items that are a suffix of the state's words, with their lengths."""
        found = self._suffixes.get(state)
        if found is None:
            found, at = [], state
            while at > 0:
                if at in self.short:
                    found.append(self.short[at])
                at = self.link[at]
            self._suffixes[state] = found
        return found

    def scan(self, words: list[int], spans: list[tuple[int, int]], names: set[str], offset: int) -> None:
        """Stream known words; add the hit spans (in words, end exclusive) and the items hit."""
        moves, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for place, word in enumerate(words, offset + 1):
            target = moves[state].get(word)
            while target is None and state:
                state = link[state]
                matched = length[state]
                target = moves[state].get(word)
            if target is None:
                continue
            state = target
            matched += 1
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                names |= self.items[at]
                spans.append((place - matched, place))
            if self.short:
                for size, named in self._short_suffixes(state):
                    if size <= matched:
                        names |= named
                        spans.append((place - size, place))

    def runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches in which every pair of neighbours occurs in an item, long enough for a window.

        No match can leave such a stretch, so the automaton needs to see no other words.
        """
        if self.least < 2:
            inside = ids >= 0
            extra = 0
        else:
            size = max(1, len(self.vocabulary))
            known = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
            keys = ids[known] * size + ids[known + 1]
            at = np.searchsorted(self.pairs, keys)
            at[at == len(self.pairs)] = 0
            inside = np.zeros(max(0, len(ids) - 1), dtype=bool)
            if len(self.pairs):
                inside[known] = self.pairs[at] == keys
            extra = 1
        edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
        starts, ends = edges[::2], edges[1::2] + extra
        for k in np.flatnonzero(ends - starts >= self.least):
            yield int(starts[k]), int(ends[k])

    def match(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """Of every text: words, hit spans that do not touch each other, items hit."""
        split = [text.translate(_TO_WORDS).split() for text in texts]
        # One place without a word between two texts.
        starts = np.cumsum([0] + [len(words) + 1 for words in split])
        ids = np.fromiter(
            map(self.vocabulary.get, chain.from_iterable(chain(words, (None,)) for words in split), repeat(-1)),
            dtype=np.int64,
            count=int(starts[-1]),
        )
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        names: list[set[str]] = [set() for _ in texts]
        for start, end in self.runs(ids):
            text = bisect_right(starts, start) - 1
            self.scan(ids[start:end].tolist(), spans[text], names[text], start - int(starts[text]))
        return [(len(w), merged(s), n) for w, s, n in zip(split, spans, names)]

    def cleaned(self, text: bytes) -> bytes:
        """The text without hit words and what stands between them, until nothing is hit."""
        while True:
            _, spans, _ = self.match([text])[0]
            if not spans:
                return text
            words = [found.span() for found in _WORD_BYTES.finditer(text.translate(_TO_WORDS))]
            kept, at = [], 0
            for start, end in spans:
                kept.append(text[at : words[start][0]])
                at = words[end - 1][1]
            text = b"".join([*kept, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as sorted spans; spans that touch become one."""
    union: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if union and start <= union[-1][1]:
            union[-1] = (union[-1][0], max(union[-1][1], end))
        else:
            union.append((start, end))
    return union


def _words(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _block_count(items: DataFrame, block_words: int) -> int:
    total = items.agg(F.sum(F.size(F.coalesce(_words("text"), F.array().cast("array<string>"))))).first()[0]
    return max(1, -(-(total or 0) // block_words))


def item_blocks(items: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes], int]]]:
    """The items' words in blocks of about ``block_words``, as input of an automaton."""
    words = _words("text")
    listed = items.where(F.col("text").isNotNull()).select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("name"), words.alias("words")
    )
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)), F.lit(PIECE_WORDS - window + 1))
    pieces = listed.where(F.size("words") > 0).select(
        "name", F.size("words").alias("whole"), "words", F.explode(starts).alias("start")
    ).select("name", "whole", F.slice("words", F.col("start") + 1, F.lit(PIECE_WORDS)).alias("words"))
    blocks = _block_count(items, block_words)
    for block in range(blocks):
        own = F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == block
        rows = pieces.where(own).distinct().sort("name", "words").toLocalIterator()
        yield [(row["name"], [word.encode() for word in row["words"]], row["whole"]) for row in rows]


_FOUND = (
    "struct<n_words: bigint, n_hit: bigint, items: array<string>, spans: array<struct<start: bigint, end: bigint>>, "
    "cleaned: string>"
)
_ARROW = pa.struct(
    [
        ("n_words", pa.int64()),
        ("n_hit", pa.int64()),
        ("items", pa.list_(pa.string())),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("cleaned", pa.string()),
    ]
)


def _find(automaton: SuffixAutomaton, text: Column, most_hit: float | None = None) -> Column:
    """What is hit; with ``most_hit``, also the cleaned text where no more than that is hit."""

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for texts in rounds(batch):
                for value, (count, spans, names) in zip(texts, automaton.match(texts)):
                    hit = sum(end - start for start, end in spans)
                    clean = most_hit is not None and 0 < hit <= most_hit * count
                    out.append(
                        {
                            "n_words": count,
                            "n_hit": hit,
                            "items": sorted(names),
                            "spans": [{"start": start, "end": end} for start, end in spans],
                            "cleaned": automaton.cleaned(value).decode() if clean else None,
                        }
                    )
            yield pa.array(out, type=_ARROW)

    found.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Held as not deterministic, so that a filter on what is found does not match the texts twice.
    return arrow_udf(found, _FOUND).asNondeterministic()(text.cast("binary"))


def _joined(first: Column, second: Column) -> Column:
    """Findings of two blocks of items on one text."""
    spans = F.array_sort(F.concat(first["spans"], second["spans"]))
    last = lambda state: F.element_at(state, -1)

    def put(state: Column, span: Column) -> Column:
        touches = (F.size(state) > 0) & (span["start"] <= F.try_element_at(state, F.lit(-1))["end"])
        longer = F.struct(
            last(state)["start"].alias("start"), F.greatest(last(state)["end"], span["end"]).alias("end")
        )
        return F.when(
            touches, F.array_append(F.slice(state, F.lit(1), F.size(state) - 1), longer)
        ).otherwise(F.array_append(state, span))

    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")
    union = F.aggregate(spans, empty, put)
    hit = F.aggregate(union, F.lit(0).cast("bigint"), lambda sum_, x: sum_ + x["end"] - x["start"])
    return F.struct(
        first["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.array_sort(F.array_union(first["items"], second["items"])).alias("items"),
        union.alias("spans"),
        F.lit(None).cast("string").alias("cleaned"),
    )


def find_contamination(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    found: str = "contamination",
    most_hit: float | None = None,
) -> DataFrame:
    """Add the struct column ``found``: ``n_words, n_hit, items, spans, cleaned``.

    ``documents`` has ``text``; ``items`` has ``item_id, text``.  Both are lower-cased (A-Z) and cut
    into words of letters, digits and non-ASCII.  A document word is hit if it is inside an occurrence
    of ``window`` consecutive words of an item, or of a whole item that has fewer.  ``items`` are
    the ids of items with such an occurrence, sorted as strings; ``spans`` the runs of hit
    words, end exclusive.  ``cleaned`` is null, unless ``most_hit`` is given, there is a single block of
    items, and the text has hits but no larger part of it is hit: it is then the text without them.

    A null or empty text has no words and nothing hits it; items without words are ignored and an item
    without id is named ``null``.  Rows that repeat an item id count as one item.  A column
    with the name of ``found`` is replaced.  The automaton of at most about ``block_words`` words is
    sent to every task; more items are matched block by block, with the rows staged in between.
    """
    text = F.col("text")
    result = documents
    names: list[str] = []
    for block in item_blocks(items, window, block_words):
        names.append(f"_{found}_{len(names)}")
        result = result.withColumn(names[-1], _find(SuffixAutomaton(block, window), text, most_hit))
        if len(names) == 2:
            first, second = names
            result = result.withColumn(first, _joined(F.col(first), F.col(second))).drop(second)
            # One or two automata at a time: each further block reads the texts once more.
            result = stage(result, "contamination")
            names = [first]
    return result.withColumn(found, F.col(names[0])).drop(names[0])


def decontaminate(
    documents: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    most_hit: float = MOST_HIT,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Remove hit spans from the texts, and documents of which more than ``most_hit`` is hit.

    Removing goes on until a text has no hit left, also across a cut.  Columns are kept; ``n_chars``,
    where there is one, is counted anew for changed texts.  Cases as in ``find_contamination``; a
    null text stays null.
    """
    found = F.col("_found")
    # All other columns travel in one, so that none can have a name that is used here.
    held = documents.select(F.struct("*").alias("_document"), "text")
    judged = find_contamination(held, items, window, block_words, "_found", most_hit)
    kept = judged.where(
        found["n_hit"] <= F.lit(most_hit) * found["n_words"]
    ).withColumn("_hit", found["n_hit"] > 0)
    if _block_count(items, block_words) == 1:
        rows = kept.withColumn("_before", F.col("text")).withColumn(
            "text", F.when(F.col("_hit"), found["cleaned"]).otherwise(F.col("text"))
        )
    else:
        # A cut made for one block of items can bring together words of another block.
        rows = _cleaned_once(kept.drop("_found"), items, window, block_words)
        while True:
            again = find_contamination(rows, items, window, block_words, "_found")
            rows = stage(again.withColumn("_hit", found["n_hit"] > 0), "decontaminated")
            if rows.where("_hit").isEmpty():
                break
            rows = _cleaned_once(rows.drop("_found"), items, window, block_words)
    own = {"text": F.col("text")}
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        changed = ~F.col("text").eqNullSafe(F.col("_before"))
        count = F.when(changed, F.length("text").cast(kind))
        own["n_chars"] = count.otherwise(F.col("_document")["n_chars"])
    return rows.select(*(own.get(name, F.col("_document")[name]).alias(name) for name in documents.columns))


def _cleaned_once(rows: DataFrame, items: DataFrame, window: int, block_words: int) -> DataFrame:
    """Texts of rows with ``_hit`` cleaned by each block in turn."""
    if "_before" not in rows.columns:
        rows = rows.withColumn("_before", F.col("text"))
    for number, block in enumerate(item_blocks(items, window, block_words)):
        if number:
            rows = stage(rows, "decontaminated")
        hit = F.when(F.col("_hit"), F.col("text"))
        rows = rows.withColumn("_cleaned", _find(SuffixAutomaton(block, window), hit, 1.0)["cleaned"])
        rows = rows.withColumn("text", F.coalesce("_cleaned", "text")).drop("_cleaned")
    return rows
