"""Chunks of documents of any size, from their lines.

``chunks.chunk_documents`` works inside a row, which holds a whole document.  Here a document is its lines,
in as many tasks as its size asks for, and the chunks are the same:

- lines are sorted by document over all range partitions; sections, paragraphs and places in the
  text are running sums over them;
- paragraphs become rows of a few numbers.  Packing goes from left to right, but all that a range of paragraphs
  needs to know of those before it is how long the open chunk is.  So each range first answers
  for every such length with which one it would end, by pointers to the next cut that are composed by doubling;
  the answers are put together range by range, and a second pass makes the cuts;
- lines then go to their chunks, which are of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import strip, strip_end, strip_start, unify_line_ends
from cinderlog.operators.ordering import _in_order, with_position
from cinderlog.sources.staging import broadcast_if_small, stage

# Lines of a paragraph that one join key stands for.
_LINES_PER_KEY_BITS = 12


def document_lines(documents: DataFrame) -> DataFrame:
    """``(source, line_number, line)`` of documents that are rows."""
    lines = F.split(unify_line_ends(F.col("text")), "\n", -1)
    return documents.select("source", F.posexplode(lines).alias("_place", "line")).select(
        "source", (F.col("_place") + 1).cast("long").alias("line_number"), "line"
    )


def _with_running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Add running sums over all ordered rows (``_slot``, ``_range``), each row's own value left out."""
    kept = rows.withColumns(sums)
    totals = kept.groupBy("_range").agg(*(F.sum(name).alias(f"_sum_{name}") for name in sums))
    # One row per range partition, then one range partition's rows.
    ranges = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *(F.coalesce(F.sum(f"_sum_{name}").over(ranges), F.lit(0)).alias(f"_start_{name}") for name in sums))
    inside = Window.partitionBy("_range").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    running = kept.withColumns({name: F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in sums})
    joined = running.join(broadcast_if_small(stage(starts, "range-starts")), "_range")
    return joined.withColumns({name: F.col(name) + F.col(f"_start_{name}") for name in sums}).drop(
        *(f"_start_{name}" for name in sums)
    )


def _marked_lines(lines: DataFrame, order: Sequence[str]) -> DataFrame:
    """Sorted lines with what they are and where: ``_section``, ``_paragraph`` and ``_before``, characters before.

    An empty line ends a paragraph, a heading also a section.  The numbers rise over all documents.
    """
    placed = _in_order(lines.select("source", *order, "line"), [F.col("source"), *(F.col(name) for name in order)])
    line = F.col("line")
    marked = placed.select(
        "source",
        "_slot",
        "_range",
        "line",
        F.startswith(line, F.lit("#")).alias("_heading"),
        (strip(line) == "").alias("_blank"),
        (line == "").alias("_empty"),
    )
    heading = F.col("_heading").cast("long")
    ends = (F.col("_heading") | F.col("_empty")).cast("long")
    running = _with_running(
        marked, {"_section": heading, "_paragraph": ends, "_before": F.length("line").cast("long") + 1}
    )
    # The heading itself is the first line of its section.
    return stage(running.withColumn("_section", F.col("_section") + heading), "marked-lines")


def _paragraphs(marked: DataFrame) -> DataFrame:
    """``source, section, paragraph, first, last, start, size``: slots of its lines, place and characters."""
    line = F.col("line")
    lead = F.length(line) - F.length(strip_start(line))
    inside = marked.where(~F.col("_heading") & ~F.col("_blank")).select(
        "source",
        F.col("_section").alias("section"),
        F.col("_paragraph").alias("paragraph"),
        "_slot",
        (F.col("_before") + lead).alias("_from"),
        (F.col("_before") + F.length(strip_end(line))).alias("_to"),
    )
    ends = inside.groupBy("source", "section", "paragraph").agg(
        F.min(F.struct("_slot", "_from")).alias("_first"), F.max(F.struct("_slot", "_to")).alias("_last")
    )
    return ends.select(
        "source",
        "section",
        "paragraph",
        F.col("_first._slot").alias("first"),
        F.col("_last._slot").alias("last"),
        F.col("_first._from").alias("start"),
        (F.col("_last._to") - F.col("_first._from")).alias("size"),
    )


class Packing:
    """Greedy packing of one range of paragraphs; a state is the length of the open chunk, 0 if none is."""

    def __init__(self, size: np.ndarray, section: np.ndarray, most: int):
        self.size, self.most = size, most
        self.long = size > most
        # A segment is packed by itself: it starts at a section and behind, or as, a long paragraph.
        new = np.ones(len(size), dtype=bool)
        new[1:] = (section[1:] != section[:-1]) | self.long[1:] | self.long[:-1]
        self.starts = np.flatnonzero(new)
        self.ends = np.append(self.starts[1:], len(size))

    def _segment(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Running length with separators, and for each paragraph the place of the next cut after one at it."""
        upto = np.cumsum(self.size[start:end] + 2)
        begin = upto - (self.size[start:end] + 2)
        return upto, np.searchsorted(upto, begin + self.most + 2, side="right")

    def end_states(self) -> np.ndarray:
        """The state behind the range for each state before it: one number if that does not matter."""
        start, end = int(self.starts[-1]), int(self.ends[-1])
        if self.long[start]:
            return np.zeros(1, dtype=np.int64)
        upto, cut = self._segment(start, end)
        count = len(upto)
        last = np.where(cut < count, cut, np.arange(count))
        while True:
            further = last[last]
            if (further == last).all():
                break
            last = further
        open_ = upto[-1] - np.where(last > 0, upto[last - 1], 0) - 2
        if start:
            return open_[:1]
        states = np.arange(self.most + 1)
        first = np.searchsorted(upto, self.most - states, side="right")
        first[0] = 0
        return np.where(first < count, open_[np.minimum(first, count - 1)], states + upto[-1])

    def opens(self, state: int) -> np.ndarray:
        """Which paragraphs begin a chunk when the range is entered in ``state``."""
        opens = self.long.copy()
        for start, end in zip(self.starts.tolist(), self.ends.tolist()):
            if self.long[start]:
                continue
            upto, cut = self._segment(start, end)
            at = int(np.searchsorted(upto, self.most - state, side="right")) if state and not start else 0
            following = cut.tolist()
            while at < len(following):
                opens[start + at] = True
                at = following[at]
        return opens


def _packed(paragraphs: DataFrame, most: int) -> DataFrame:
    """Paragraphs in order with ``opens`` (begins a chunk) and ``weight`` (chunks that begin with it)."""
    placed = _in_order(paragraphs, [F.col("source"), F.col("paragraph")])

    def sections(table: pa.Table) -> np.ndarray:
        keys = table.select(["source", "section"]).to_pandas()
        return (keys != keys.shift()).any(axis=1).cumsum().to_numpy()

    def answered(table: pa.Table) -> pa.Table:
        table = table.sort_by("_slot")
        own = Packing(table["size"].to_numpy(), sections(table), most)
        ends = table.take([0, len(table) - 1])
        source, section = ends["source"].to_pylist(), ends["section"].to_pylist()
        states = own.end_states()
        return pa.table(
            {
                "_range": table["_range"].slice(0, 1),
                "first": [f"{section[0]} {source[0]}"],
                "last": [f"{section[1]} {source[1]}"],
                "states": pa.array([states.tolist()], pa.list_(pa.int64())),
            }
        )

    answers = placed.groupBy("_range").applyInArrow(answered, "_range long, first string, last string, states array<long>")
    # One row per range partition; only ranges that one section fills have more than one state.
    entered, state, before = {}, 0, None
    for row in answers.sort("_range").toLocalIterator():
        state = state if row["first"] == before else 0
        entered[row["_range"]] = state
        state, before = row["states"][state if len(row["states"]) > 1 else 0], row["last"]

    fields = placed.schema.fieldNames()

    def cut(table: pa.Table) -> pa.Table:
        table = table.select(fields).sort_by("_slot")
        own = Packing(table["size"].to_numpy(), sections(table), most)
        opens = own.opens(entered[table["_range"][0].as_py()])
        weight = np.where(own.long, -(-own.size // most), opens)
        return table.append_column("opens", pa.array(opens)).append_column("weight", pa.array(weight, pa.int64()))

    kinds = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in placed.schema)
    return placed.groupBy("_range").applyInArrow(cut, f"{kinds}, opens boolean, weight long")


def _numbered(packed: DataFrame) -> DataFrame:
    """Paragraphs with ``chunk``: the number, over all documents, of the chunk that they are in or begin."""
    running = _with_running(packed, {"_chunks": F.col("weight")})
    chunk = F.col("_chunks") + F.when(F.col("opens"), 1).otherwise(0)
    return running.withColumn("chunk", chunk).drop("_chunks", "_slot", "_range")


def chunk_lines(
    lines: DataFrame, max_characters: int = fixed.CHUNK_CHARACTERS, order: Sequence[str] = ("line_number",)
) -> DataFrame:
    """``(source, position, heading, content)`` as ``chunks.chunk_documents`` gives, from ``(source, …, line)``.

    A document, section or paragraph may have any number of lines; a line is a row.  ``order`` names the
    columns that give the lines of a document their order.  A null line is an empty one.
    """
    marked = _marked_lines(lines.withColumn("line", F.coalesce("line", F.lit(""))), order)
    paragraphs = stage(_numbered(_packed(_paragraphs(marked), max_characters)), "paragraphs")
    contents = _contents(marked, paragraphs, max_characters)
    labels = _labels(marked, paragraphs)
    return contents.join(labels, ["source", "chunk"]).select("source", "position", "heading", "content")


def _contents(marked: DataFrame, paragraphs: DataFrame, most: int) -> DataFrame:
    """``source, chunk, content``: the lines of every chunk, trimmed and joined."""
    key = F.shiftright("_slot", _LINES_PER_KEY_BITS)
    # A paragraph of many lines meets them under many keys.
    keys = F.sequence(F.shiftright("first", _LINES_PER_KEY_BITS), F.shiftright("last", _LINES_PER_KEY_BITS))
    known = stage(
        paragraphs.select(
            "source", F.col("paragraph").alias("_paragraph"), "first", "last", "start", "size", "opens", "chunk", F.explode(keys).alias("_key")
        ),
        "paragraph-keys",
    )
    text_lines = marked.where(~F.col("_heading") & ~F.col("_empty")).select(
        "source", "_slot", "_paragraph", "_before", "line", key.alias("_key")
    )
    met = text_lines.join(broadcast_if_small(known), ["source", "_paragraph", "_key"]).where(
        F.col("_slot").between(F.col("first"), F.col("last"))
    )
    is_first, is_last = F.col("_slot") == F.col("first"), F.col("_slot") == F.col("last")
    line = F.when(is_first, strip_start(F.col("line"))).otherwise(F.col("line"))
    line = F.when(is_last, strip_end(line)).otherwise(line)
    lead = F.when(~is_first, "\n").when(F.col("opens"), "").otherwise("\n\n")
    # Where the line with its lead begins in the paragraph.
    begin = F.when(is_first, 0).otherwise(F.col("_before") - F.col("start") - 1)
    pieces = met.select("source", "chunk", "size", "_slot", F.concat(lead, line).alias("_text"), begin.alias("_begin"))
    end = F.col("_begin") + F.length("_text")
    several = F.sequence(F.floor(F.col("_begin") / most), F.floor((end - 1) / most))
    number = F.explode(F.when(F.col("size") > most, several).otherwise(F.array(F.lit(0).cast("long"))))
    cut = pieces.select("*", number.alias("_piece"))
    skipped = F.greatest(F.lit(0), F.col("_piece") * most - F.col("_begin")).cast("int")
    taken = (F.least((F.col("_piece") + 1) * most, end) - F.col("_begin")).cast("int") - skipped
    part = F.when(F.col("size") > most, F.substr("_text", skipped + 1, taken)).otherwise(F.col("_text"))
    placed = cut.select("source", (F.col("chunk") + F.col("_piece")).alias("chunk"), F.struct("_slot", part.alias("part")).alias("_part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("_part")), lambda x: x["part"]), "")
    return placed.groupBy("source", "chunk").agg(joined.alias("content"))


def _labels(marked: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """``source, chunk, position, heading``: headings numbered by parts of a section and occurrences in a document."""
    headings = marked.where("_heading").select(
        F.col("source").alias("_source"), F.col("_section"), strip(F.ltrim(F.col("line"), F.lit("#"))).alias("_title")
    )
    sections = paragraphs.groupBy("source", "section").agg(F.min("chunk").alias("_first"), F.sum("weight").alias("_parts"))
    titled = sections.join(
        headings, (F.col("source") == F.col("_source")) & (F.col("section") == F.col("_section")), "left"
    ).withColumn("_title", F.coalesce("_title", F.lit(fixed.DEFAULT_HEADING)))
    begins = paragraphs.groupBy("source").agg(F.min("chunk").alias("_begin"))
    each = titled.join(begins, "source").select(
        "source", "_begin", "_first", "_parts", "_title", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_parts") - 1)).alias("chunk")
    )
    part = F.col("chunk") - F.col("_first") + 1
    label = F.when(F.col("_parts") > 1, F.format_string("%s (part %d)", "_title", part)).otherwise(F.col("_title"))
    labelled = each.select("source", "chunk", (F.col("chunk") - F.col("_begin") + 1).cast("int").alias("position"), label.alias("_label"))
    occurred = with_position(stage(labelled, "chunk-labels"), ["source", "_label"], ["chunk"], "_occurrence")
    heading = F.when(F.col("_occurrence") == 1, F.col("_label")).otherwise(F.format_string("%s (%d)", "_label", "_occurrence"))
    return occurred.select("source", "chunk", "position", heading.alias("heading"))
