"""Byte-level BPE encoding and decoding with the ranks of a given vocabulary."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf

# Entries of each of the two memos of a Python worker (some 100 MB together).
MEMO = 1 << 19
# Longer pieces are encoded each time they occur.
_SHORT = 48
# Characters of a text whose pieces are listed at once; ids decoded at once.
_STRETCH = 1 << 20
_IDS = 1 << 16

# What later versions of Unicode made letters or numbers, which the library whose
# results are to be met (Unicode 16) does not know as such.
LATER_LETTERS = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2"
    "\ua7f1\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7"
    "\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81"
    "\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
LATER_NUMBERS = (
    "\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6"
)


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line holds a token in base 64, a space, and its rank."""
    pairs = (line.split() for line in content.splitlines() if line.strip())
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class _Pieces:
    """Cuts texts by a pattern as a library of Unicode 16 does."""

    def __init__(self, pattern: str):
        older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{LATER_LETTERS}{LATER_NUMBERS}])")
        older = older.replace(r"\p{L}+", rf"(?:(?![{LATER_LETTERS}])\p{{L}})+")
        older = older.replace(r"\p{N}+", rf"(?:(?![{LATER_NUMBERS}])\p{{N}})+")
        self.usual, self.older = regex.compile(pattern), regex.compile(older)
        self.later = regex.compile(f"[{LATER_LETTERS}{LATER_NUMBERS}]")
        # Most texts are plain ASCII, where the built-in module takes half the time.
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", r"[^\sA-Za-z0-9]")
        plain = plain.replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]")
        self.plain = self.usual if r"\p" in plain else re.compile(plain, re.ASCII)

    def of(self, text: str) -> Iterable[str]:
        if text.isascii():
            pattern = self.plain
        else:
            pattern = self.older if self.later.search(text) else self.usual
        if len(text) <= _STRETCH:
            return pattern.findall(text)
        return (match.group() for match in pattern.finditer(text))


class _Memo(dict):
    """Values by key, made when first asked for; those not asked for lately are forgotten."""

    def __init__(self, make, longest: int | None = None):
        self.make, self.longest = make, longest
        self.before: dict = {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
            if self.longest is not None and len(key) > self.longest:
                return value
        if 2 * len(self) >= MEMO:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Exact merges by rank, in time linear in the text.

    A merge replaces the neighbours whose joined bytes have the least rank, the leftmost first.  In
    the end two tokens may stand side by side only if no merge across their border would have come
    before the merges that made them; tokens that are pairwise compatible in this sense are the
    result, and there is only one such sequence.  So the longest token at a place is
    tried first, then its prefixes, and a place that cannot be reached from the left is given up for good.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        lacking = [byte for byte in range(256) if bytes([byte]) not in ranks]
        if lacking:
            raise ValueError(f"the vocabulary has no token for the bytes {lacking}")
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.pieces = _Pieces(pattern)
        # What a token was merged from, when (single bytes: before all), and the merges themselves.
        self.parts: dict[int, tuple[int, int]] = {}
        self.born = {ranks[bytes([byte])]: -1 for byte in range(256)}
        self.merges: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            if len(token) > 1 and not self._merge_of(token, rank):
                continue
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        for rank in self.born:
            token = self.bytes[rank]
            starts = (ranks.get(token[:end]) for end in range(len(token) - 1, 0, -1))
            self.shorter[rank] = next((r for r in starts if r in self.born), None)
        self.automaton.make_automaton()
        # A pair of tokens as one number.
        self.span = max(self.bytes) + 1
        self.compatible = _Memo(lambda pair: self._stay(*divmod(pair, self.span)))
        self.packed = _Memo(self._pack, _SHORT)

    def _merge_of(self, token: bytes, rank: int) -> bool:
        """Note the last merge that makes the token; False if merges never make it."""
        for cut in range(1, len(token)):
            left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
            if left in self.born and right in self.born and self._stay(left, right):
                self.parts[rank], self.merges[left, right] = (left, right), rank
                self.born[rank] = rank
                return True
        return False

    def _stay(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, are left alone by all merges so far.

        Goes back in time: the later one of the two is taken apart, and what then stands at the
        border must not merge before the token that was taken apart comes about.
        """
        left_until = right_until = 1 << 62
        while True:
            joined = self.merges.get((left, right))
            # Of two equal merges the left one comes first.
            if joined is not None and joined < left_until and joined <= right_until:
                return False
            if self.born[left] > self.born[right]:
                left_until, left = left, self.parts[left][1]
            elif self.born[right] >= 0:
                right_until, right = right, self.parts[right][0]
            else:
                return True

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        count, size, shorter, compatible, span = len(piece), self.size, self.shorter, self.compatible, self.span
        # Of the tokens with one start, those that end later come later.
        longest = [0] * count
        for last, (before, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[last - before] = token
        closed = bytearray(count + 1)
        taken: list[int] = []
        at, token, key = 0, longest[0] if count else 0, -1
        while at < count:
            end = at + size[token]
            if not closed[end] and (key < 0 or compatible[key + token]):
                taken.append(token)
                at, key = end, token * span
                if end < count:
                    token = longest[end]
            else:
                less = shorter[token]
                if less is None:
                    # Nothing follows the last token here: no tokens that end at this place do.
                    closed[at] = 1
                    token = taken.pop()
                    at -= size[token]
                    key = taken[-1] * span if taken else -1
                else:
                    token = less
        return taken

    def _pack(self, piece: str) -> bytes:
        ids = self.merge(piece.encode("utf-8"))
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Token ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces.of(text)))

    def decode(self, packed: bytes) -> bytes:
        if len(packed) % 4:
            raise ValueError("token ids take four bytes each")
        ids = np.frombuffer(packed, dtype="<u4")
        held = (
            b"".join(map(self.bytes.__getitem__, ids[start : start + _IDS].tolist()))
            for start in range(0, len(ids), _IDS)
        )
        return b"".join(held)


@lru_cache(maxsize=2)
def encoder(content: bytes, pattern: str) -> Encoder:
    """The encoder of a vocabulary file; a Python worker builds it once."""
    return Encoder(read_ranks(content), pattern)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(
    documents: DataFrame, vocabulary: str, pattern: str, column: str = "text", result: str = "token_ids"
) -> DataFrame:
    """Add the binary column ``result``: ids of the whole text, four bytes each, least byte first.

    ``vocabulary`` is a local path on the driver to a file of ranks, which must hold all single bytes; it
    goes to the tasks with the function (some hundred kilobytes).  ``pattern`` cuts texts into pieces, which
    are encoded separately, without special tokens.

    A null or empty text has no ids (an empty value, not null).  Bytes that are no UTF-8 count as
    U+FFFD.  Rows, repeated ones too, stay as they are, and an empty table stays empty; a column with the name of
    ``result`` is replaced.  A text's ids must fit one value (2 GB).
    """
    content = _read(vocabulary)

    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(content, pattern)
        for batch in batches:
            texts = (bytes(value.as_py() or b"").decode("utf-8", "replace") for value in batch)
            yield pa.array([own.encode(text) for text in texts], type=pa.binary())

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return documents.withColumn(result, arrow_udf(encoded, "binary")(F.col(column).cast("binary")))


def decode(
    frame: DataFrame, vocabulary: str, pattern: str, column: str = "token_ids", result: str = "decoded"
) -> DataFrame:
    """Add the binary column ``result``: the bytes of the ids that ``encode`` gave.

    Null ids give an empty value.  An id that the vocabulary lacks, or a value whose length
    is no multiple of four, fails.
    """
    content = _read(vocabulary)

    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = encoder(content, pattern)
        for batch in batches:
            yield pa.array([own.decode(value.as_py() or b"") for value in batch], type=pa.binary())

    decoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return frame.withColumn(result, arrow_udf(decoded, "binary")(F.col(column)))
