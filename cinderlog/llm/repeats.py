"""Exact removal of repeated byte strings: anchored-window comparison, not prefix doubling.

A window is a string of ``length`` bytes.  Sorting every byte position by pairs of ranks would move
the corpus many times in every round, so positions are ranked in bins.  The anchor of a window is the
leftmost least hashed ``GRAM`` inside it: equal windows have their anchor at the same offset, so only
windows with equal anchors and offsets need be compared.  A round ranks bins of
neighbouring offsets by what all their windows share, the core.  A core that is unique ends the bin; bins with
equal cores and equal whole contents are settled at once; the rest goes on, one bin for each content,
with smaller bins and so longer cores, from ``GRAM`` bytes up to the whole window, the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf, bound_batches
from cinderlog.sources.staging import broadcast_if_small, stage

LENGTH = 400
GRAM = 33
# Offsets per bin in each round.  The first takes all offsets of an anchor, the last single windows.
BINS = (LENGTH - GRAM + 1, 46, 8, 1)
# Windows of a text that are worked on at once; a power of two.
_STRETCH = 1 << 17
# Bins that a task holds before it hands them on.
_HELD_BINS = 1 << 15

_BINS_TYPE = "core long, whole long, row long, anchor long, first long, last long"
_BINS_ARROW = pa.schema([(field.split()[0], pa.int64()) for field in _BINS_TYPE.split(", ")])


# Tables by seed, made once in each worker.
_HELD: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of an odd base and of its inverse, modulo 2**64."""
    if seed in _HELD:
        return _HELD[seed]
    random = np.random.default_rng(seed)
    values = random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(random.integers(0, 1 << 61)) * 8 + 5
    count = _STRETCH + 2 * LENGTH + 2
    _HELD[seed] = values, _powers(base, count), _powers(pow(base, -1, 1 << 64), count)
    return _HELD[seed]


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(count, dtype=np.uint64)
    size = 1
    while size < count:
        more = min(size, count - size)
        out[size : size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    return out


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return hashes ^ (hashes >> np.uint64(29))


class _Hashes:
    """Hashes of any part of a stretch of bytes, from sums over its beginnings."""

    def __init__(self, codes: np.ndarray, seed: int) -> None:
        values, powers, self.inverse = _tables(seed)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(values[codes] * powers[: len(codes)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def window_anchors(hashes: _Hashes, windows: int, length: int) -> np.ndarray:
    """The anchor of each window that starts at 0, 1, ..."""
    width = length - GRAM + 1
    count = windows + width - 1
    starts = np.arange(count)
    # Least hash first, then leftmost; the place takes the low bits.
    keys = (hashes.of(starts, starts + GRAM) & ~np.uint64(2 * _STRETCH - 1)) | starts.astype(np.uint64)
    padded = np.full(-(-count // width) * width, ~np.uint64(0))
    padded[:count] = keys
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onwards = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(onwards[:windows], upto[width - 1 : width - 1 + windows])
    return (least & np.uint64(2 * _STRETCH - 1)).astype(np.int64)


def _binned(ranges: np.ndarray, size: int) -> np.ndarray:
    """Rows (anchor, first, last) of windows cut at multiples of ``size`` of the offset."""
    anchor, first, last = ranges
    low, high = (anchor - last) // size, (anchor - first) // size
    counts = high - low + 1
    owner = np.repeat(np.arange(len(anchor)), counts)
    step = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    anchor, first, last = anchor[owner], first[owner], last[owner]
    nearest, farthest = anchor - step * size, anchor - step * size - size + 1
    return np.array([anchor, np.maximum(first, farthest), np.minimum(last, nearest)])


def bins_of(text: bytes, ranges: np.ndarray | None, size: int, length: int) -> np.ndarray:
    """Rows (core, whole, anchor, first, last) of a text's bins; ``ranges`` of None is all windows."""
    windows = len(text) - length + 1
    codes = np.frombuffer(text, dtype=np.uint8)
    found = [np.zeros((5, 0), dtype=np.int64)]
    for begin in range(0, max(windows, 0), _STRETCH):
        own = min(_STRETCH, windows - begin)
        if ranges is None:
            part = codes[begin : begin + own + length - 1]
            hashes = _Hashes(part, 1)
            anchors = window_anchors(hashes, own, length)
            edges = np.flatnonzero(np.diff(anchors)) + 1
            firsts, lasts = np.append(0, edges), np.append(edges - 1, own - 1)
            local = np.array([anchors[firsts], firsts, lasts])
        else:
            inside = (ranges[1] >= begin) & (ranges[1] < begin + _STRETCH)
            if not inside.any():
                continue
            # A range has fewer windows than a window has bytes.
            part = codes[begin : begin + own + 2 * length]
            hashes = _Hashes(part, 1)
            local = ranges[:, inside] - begin
        anchor, first, last = local = _binned(local, size)
        step = (anchor - first) // size
        core_start = anchor - step * size
        core = hashes.of(core_start, core_start - size + 1 + length)
        # The whole content of a bin, its place and its width; one window for the last round.
        second = hashes if size > 1 else _Hashes(part, 2)
        shape = ((anchor - first) * length + (last - first)).astype(np.uint64)
        whole = _mixed(second.of(first, last + length) + shape * np.uint64(0xC2B2AE3D27D4EB4F))
        found.append(np.vstack([core.view(np.int64), whole.view(np.int64), local + begin]))
    return np.concatenate(found, axis=1)


def _bins(texts: DataFrame, size: int, length: int) -> DataFrame:
    """``texts``: ``row, text`` and, after the first round, ``ranges``."""
    ranged = "ranges" in texts.columns

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, count = [], 0
            for k in range(batch.num_rows):
                row, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                ranges = None
                if ranged:
                    # A list of lists of three numbers, flat below.
                    flat = batch.column(2)[k].values.flatten()
                    ranges = flat.to_numpy(zero_copy_only=False).reshape(-1, 3).T
                bins = bins_of(text, ranges, size, length)
                held.append(np.vstack([bins[:2], np.full((1, bins.shape[1]), row), bins[2:]]))
                count += bins.shape[1]
                if count > _HELD_BINS:
                    yield _batch(held)
                    held, count = [], 0
            if held:
                yield _batch(held)

    bound_batches()
    columns = [F.col("row"), F.col("text").cast("binary").alias("text")]
    if ranged:
        columns.append(F.col("ranges"))
    return texts.select(*columns).mapInArrow(emitted, _BINS_TYPE)


def _batch(held: list[np.ndarray]) -> pa.RecordBatch:
    rows = np.concatenate(held, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(column) for column in rows], schema=_BINS_ARROW)


def repeated_windows(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``row, first, last``: runs of window starts whose windows also start anywhere else.

    ``texts`` has ``row, text`` with a text in no row twice, and should be staged, as every round reads it.
    """
    wide = length - GRAM + 1
    sizes = [wide] + [size for size in BINS[1:] if size < wide]
    settled: DataFrame | None = None
    active = texts.select("row", "text").where(F.octet_length("text") >= length)
    for size in sizes:
        bins = _bins(active, size, length)
        if size != wide:
            bins = stage(bins, "repeat-bins")
        cores = stage(
            bins.groupBy("core")
            .agg(F.count(F.lit(1)).alias("_n"), (F.min("whole") != F.max("whole")).alias("mixed"))
            .where("_n > 1")
            .select(F.col("core").alias("_core"), "mixed"),
            "repeat-cores",
        )
        hits = stage(
            bins.join(broadcast_if_small(cores), F.col("core") == F.col("_core")).drop("_core"), "repeat-hits"
        )
        mixed = hits.where("mixed")
        wholes = stage(
            mixed.groupBy("core", "whole").agg(
                F.count(F.lit(1)).alias("_n"), F.min(F.struct("row", "anchor", "first", "last")).alias("_one")
            ),
            "repeat-wholes",
        )
        same = wholes.where("_n > 1").select(F.col("core").alias("_core"), F.col("whole").alias("_whole"))
        again = mixed.join(
            broadcast_if_small(same), (F.col("core") == F.col("_core")) & (F.col("whole") == F.col("_whole"))
        )
        spans = hits.where("not mixed").select("row", "first", "last").unionByName(again.select("row", "first", "last"))
        settled = spans if settled is None else settled.unionByName(spans)
        # One bin for each content goes on: it stands for all others like it.
        ranges = stage(
            wholes.select("_one.*").groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.array("anchor", "first", "last")).alias("ranges")),
            "repeat-ranges",
        )
        active = texts.join(broadcast_if_small(ranges), F.col("row") == F.col("_row")).select("row", "text", "ranges")
    return settled


def _merged(firsts_and_lasts: Column, length: int) -> Column:
    def merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for value in batch:
                runs = np.array(value.as_py(), dtype=np.int64).reshape(-1, 2)
                runs = runs[np.argsort(runs[:, 0])]
                ends = np.maximum.accumulate(runs[:, 1] + length)
                cuts = np.flatnonzero(runs[1:, 0] > ends[:-1]) + 1
                starts, stops = runs[np.append(0, cuts), 0], ends[np.append(cuts - 1, len(ends) - 1)]
                out.append([{"start": a, "end": b} for a, b in zip(starts.tolist(), stops.tolist())])
            yield pa.array(out, type=kind)

    merged.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(merged, "array<struct<start: long, end: long>>")(F.flatten(firsts_and_lasts))


def _kept(text: Column, spans: Column) -> Column:
    def kept(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, removed in batches:
            out = []
            for text, spans in zip(texts, removed):
                if not text.is_valid:
                    out.append(None)
                    continue
                value, at, pieces = text.as_py(), 0, []
                for span in spans.as_py():
                    pieces.append(value[at : span["start"]])
                    at = span["end"]
                out.append(b"".join([*pieces, value[at:]]))
            yield pa.array(out, type=pa.binary())

    kept.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]
    }
    return arrow_udf(kept, "binary")(text, spans)


def remove_repeats(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Add ``removed`` (byte spans, end exclusive, apart from each other) and ``kept`` (binary).

    Every byte of a text that lies in a string of ``length`` bytes, which also starts anywhere else in the
    corpus or the same text, is removed; overlaps count, matches never cross documents, and
    all are judged on the input.  ``kept`` is what remains; a cut may fall inside a character.

    A null text is empty; texts shorter than ``length`` stay whole.  Repeated rows are repeats of each other
    and lose all their windows.  Input columns named ``removed`` or ``kept`` are replaced.  The
    documents are staged once with a number for each row, as ids may repeat or be null.
    """
    if length <= GRAM:
        raise ValueError(f"strings must be longer than {GRAM} bytes")
    names = [name for name in documents.columns if name not in ("removed", "kept")]
    staged = stage(
        documents.select(F.struct(*names).alias("_document")).withColumn("row", F.monotonically_increasing_id()),
        "repeat-documents",
    )
    texts = staged.select("row", F.col("_document.text").alias("text"))
    runs = repeated_windows(texts, length).groupBy(F.col("row").alias("_row"))
    spans = stage(
        runs.agg(F.collect_list(F.array("first", "last")).alias("_runs")).select(
            "_row", _merged(F.col("_runs"), length).alias("removed")
        ),
        "repeat-spans",
    )
    text = F.coalesce(F.col("_document.text"), F.lit("")).cast("binary")
    found = staged.join(broadcast_if_small(spans), F.col("row") == F.col("_row"), "left")
    cut = _kept(F.when(F.col("removed").isNotNull(), text), F.col("removed"))
    empty = F.array().cast("array<struct<start: long, end: long>>")
    return found.withColumn("_cut", cut).select(
        "_document.*", F.coalesce("removed", empty).alias("removed"), F.coalesce("_cut", text).alias("kept")
    )
