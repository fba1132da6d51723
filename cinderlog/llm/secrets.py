"""Secret scans: known forms, and windows of high entropy in candidate strings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known forms: kind, pattern, group that is measured, its least length, and a test that is
# true of every text with a match, cheaper than finding the matches.
BASE = (
    (
        "assign",
        r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
        r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    ("hex", r"[0-9a-f]+", 0, 24, r"[0-9a-f]{24}"),
)
# Character classes of candidate strings: name, pattern of a candidate, bits of entropy that a
# window has to reach.
CLASSES = (
    ("hex", r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{20,}+", 3.0),
    ("token", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 3.7),
)
# Candidates that are no secrets: plain words, numbers, paths and joined words, UUIDs, examples.
ALLOWED = (
    r"\A[A-Za-z]+\z",
    r"\A[0-9]+\z",
    r"\A[^0-9]*\z",
    r"\A[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}\z",
    r"(?i)example",
)
WINDOW = 20
KINDS = ("assign", "access", "hex", "entropy")
_SPAN = "array<struct<start: bigint, kind: int, end: bigint>>"
# Values that one list of running states holds.
_BLOCK = 256
# Code points of the blocks of a text, and of the blocks of these, in which spans are cut out.
_LARGE, _SMALL = 1 << 18, 1 << 12


def _with(body: Callable[..., Column], *bound: object) -> Callable[[Column], Column]:
    """A one-argument function for a loop's own values; Spark counts the arguments."""
    return lambda x: body(x, *bound)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _none() -> Column:
    return F.array().cast(_SPAN)


def _before(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value the combination of all before it, in time that is linear in the values.

    A fold that lists its states copies the list at each step; blocks of bounded size keep the copies
    small, and the states before the blocks come from the same fold over the blocks' totals.
    """

    def states(start: Column, items: Column) -> Column:
        empty = F.filter(F.array(start), lambda _: F.lit(False))
        return F.aggregate(
            items,
            F.struct(start.alias("now"), empty.alias("past")),
            lambda state, item: F.struct(
                combine(state["now"], item).alias("now"), F.array_append(state["past"], state["now"]).alias("past")
            ),
        )["past"]

    def over(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, combine))
        zipped = F.arrays_zip(blocks.alias("block"), states(zero, totals).alias("start"))
        return F.flatten(F.transform(zipped, lambda x: states(x["start"], x["block"])))

    def cut(values: Column) -> Column:
        count = F.ceil(F.size(values) / _BLOCK).cast("int")
        numbers = F.slice(F.sequence(F.lit(0), count), 1, count)
        return F.transform(numbers, lambda block: F.slice(values, block * _BLOCK + 1, _BLOCK))

    return _bound(values, lambda values: _bound(cut(values), over))


def _added(total: Column, item: Column) -> Column:
    return total + item


def _larger(most: Column, item: Column) -> Column:
    return F.greatest(most, item)


def _located(text: Column, pattern: str, group: int = 0) -> Column:
    """Matches in order with their places: ``start, end, text`` (code points, end exclusive)."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What lies between matches, and behind the last one.
    columns = [hits.alias("hit"), F.split(text, pattern, -1).alias("gap")]
    if group:
        columns.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("group"))
    pieces = F.transform(
        F.filter(F.arrays_zip(*columns), lambda x: x["hit"].isNotNull()),
        lambda x: F.struct(
            F.length(x["gap"]).cast("bigint").alias("gap"),
            F.length(x["hit"]).cast("bigint").alias("hit"),
            x["group" if group else "hit"].alias("text"),
        ),
    )

    def placed(pieces: Column) -> Column:
        both = F.transform(pieces, lambda x: x["gap"] + x["hit"])
        starts = _before(both, F.lit(0).cast("bigint"), _added)
        return F.transform(
            F.arrays_zip(pieces.alias("piece"), starts.alias("at")),
            lambda x: F.struct(
                (x["at"] + x["piece"]["gap"]).alias("start"),
                (x["at"] + x["piece"]["gap"] + x["piece"]["hit"]).alias("end"),
                x["piece"]["text"].alias("text"),
            ),
        )

    return _bound(pieces, placed)


def _rewritten(text: Column, spans: Column, written: Callable[[Column, Column, Column, Column], Column]) -> Column:
    """The text with something else in place of sorted spans.

    The text is cut into blocks, and these into smaller ones, so that a span is looked for and cut out near
    where it is.  ``written`` gives, for a span, the place of its block in the text and the part of the block
    that it takes (from, to), what stands there.
    """

    def near(spans: Column, low: Column, size: int) -> Column:
        return F.filter(spans, lambda x: (x["end"] > low) & (x["start"] < low + size))

    def block(piece: Column, low: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text"))

        def put(state: Column, span: Column) -> Column:
            begin = F.greatest(state["at"], span["start"] - low)
            end = F.least(F.greatest(state["at"], span["end"] - low), F.lit(_SMALL).cast("bigint"))
            before = F.substring(piece, (state["at"] + 1).cast("int"), (begin - state["at"]).cast("int"))
            return F.struct(
                end.alias("at"), F.concat(state["text"], before, written(span, low, begin, end)).alias("text")
            )

        def rest(state: Column) -> Column:
            return F.concat(state["text"], F.substring(piece, (state["at"] + 1).cast("int"), F.lit(_SMALL)))

        return F.when(F.size(spans) > 0, F.aggregate(spans, start, put, rest)).otherwise(piece)

    def small(low: Column, spans: Column) -> Callable[[Column, Column], Column]:
        def each(piece: Column, number: Column) -> Column:
            at = low + number * _SMALL
            return _bound(near(spans, at, _SMALL), lambda own: block(piece, at, own))

        return each

    def large(piece: Column, number: Column) -> Column:
        low = number.cast("bigint") * _LARGE
        return _bound(
            near(spans, low, _LARGE),
            lambda own: F.array_join(F.transform(_cut(piece, _SMALL), small(low, own)), ""),
        )

    whole = F.array_join(F.transform(_cut(text, _LARGE), large), "")
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _cut(text: Column, size: int) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))


def base_spans(text: Column) -> Column:
    """Spans of the known forms, per kind leftmost and without overlap; matches too short go."""
    listed = []
    for kind, pattern, group, least, test in BASE:
        number, shortest = F.lit(KINDS.index(kind)), F.lit(least)
        found = F.filter(
            _located(text, pattern, group),
            _with(lambda x, shortest: F.length(x["text"]) >= shortest, shortest),
        )
        spans = F.transform(
            found,
            _with(
                lambda x, number: F.struct(
                    x["start"].alias("start"), number.alias("kind"), x["end"].alias("end")
                ),
                number,
            ),
        )
        listed.append(F.when(text.rlike(test), spans).otherwise(_none()))
    return F.array_sort(F.concat(*listed))


def _log_term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))


def window_span(candidate: Column, limit: float, window: int = WINDOW) -> Column:
    """``first, last``: start of the first and end of the last window with enough entropy, or null.

    One pass: a step adds a character's count, drops that of the character that leaves the window, and
    keeps the sum of ``c log2 c`` over the counts, from which the entropy follows.
    """

    def changed(counts: Column, letter: Column, by: int) -> Column:
        rest = F.map_filter(counts, lambda k, _: k != letter)
        return F.map_concat(rest, F.create_map(letter, _count(counts, letter) + by))

    def _count(counts: Column, letter: Column) -> Column:
        return F.coalesce(F.try_element_at(counts, letter), F.lit(0))

    def step(state: Column, item: Column) -> Column:
        new, old = item["new"], item["old"]
        came = _count(state["counts"], new)
        total = state["sum"] + _log_term(came + 1) - _log_term(came)
        counts = changed(state["counts"], new, 1)
        left = _count(counts, old)
        total = F.when(old.isNull(), total).otherwise(total + _log_term(left - 1) - _log_term(left))
        counts = F.when(old.isNull(), counts).otherwise(changed(counts, old, -1))
        entropy = F.log2(F.lit(float(window))) - total / window
        reached = (item["at"] >= window - 1) & (entropy >= limit)
        return F.struct(
            counts.alias("counts"),
            total.alias("sum"),
            F.when(reached & state["first"].isNull(), item["at"] - window + 1).otherwise(state["first"]).alias("first"),
            F.when(reached, item["at"] + 1).otherwise(state["last"]).alias("last"),
        )

    # Bound, as a step that names the split text would split it anew.
    items = _bound(
        F.split(candidate, "", -1),
        lambda letters: F.transform(
            letters,
            lambda letter, at: F.struct(
                letter.alias("new"),
                F.when(at >= window, F.try_element_at(letters, at - window + 1)).alias("old"),
                at.cast("int").alias("at"),
            ),
        ),
    )
    start = F.struct(
        F.create_map().cast("map<string, int>").alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(items, start, step, lambda state: F.struct(state["first"].alias("first"), state["last"].alias("last")))


def _blanked(text: Column, spans: Column) -> Column:
    """The text with spaces in place of every span; all other characters keep their places."""
    blank = lambda span, low, begin, end: F.repeat(F.lit(" "), (end - begin).cast("int"))
    return _bound(F.array_sort(spans), lambda spans: _rewritten(text, spans, blank))


def _class_spans(text: Column, pattern: str, limit: float, allowed: Sequence[str]) -> Column:
    candidates = F.filter(
        _located(text, pattern),
        lambda x: ~reduce(or_, (x["text"].rlike(rule) for rule in allowed), F.lit(False)),
    )
    windows = F.transform(
        candidates,
        lambda x: F.struct(x["start"].alias("at"), window_span(x["text"], limit).alias("w")),
    )
    found = F.transform(
        F.filter(windows, lambda x: x["w"]["first"].isNotNull()),
        lambda x: F.struct(
            (x["at"] + x["w"]["first"]).cast("bigint").alias("start"),
            F.lit(KINDS.index("entropy")).alias("kind"),
            (x["at"] + x["w"]["last"]).cast("bigint").alias("end"),
        ),
    )
    return F.when(text.rlike(pattern), found).otherwise(_none())


def entropy_spans(text: Column, taken: Column, allowed: Sequence[str] = ALLOWED) -> Column:
    """Spans with high entropy that overlap none of ``taken``, class by class.

    Candidates are the longest runs of a class's characters outside the spans so far: what stands before,
    between and after spans in one run is judged piece by piece, each by the allow-list too.  One on the
    allow-list is no secret: by default also every piece without a digit, and every one with "example" in it.
    """

    def more(spans: Column, pattern: str, limit: float) -> Column:
        free = _blanked(text, F.concat(taken, spans))
        return F.concat(spans, _bound(free, _with(_class_spans, pattern, limit, allowed)))

    spans = _none()
    for _, pattern, limit in CLASSES:
        spans = _bound(spans, _with(more, pattern, limit))
    return spans


def find_secrets(documents: DataFrame, result: str = "secrets") -> DataFrame:
    """Add the struct column ``result``: ``base`` and ``all``, spans ``(start, kind, end)``.

    ``kind`` is the place in ``KINDS``; spans are sorted by start and kind, count code points and end
    exclusively.  Known forms are found first; candidate strings of each character class then add
    windows of high Shannon entropy where no span is yet.  A null or empty text has no spans.
    Repeated rows are judged alike.  A column with the name of ``result`` is replaced.

    Expressions work on one row; a row takes memory in proportion to its text.
    """
    text = F.coalesce("text", F.lit(""))
    with_base = documents.withColumn(result, base_spans(text))
    base = F.col(result)
    both = F.struct(
        base.alias("base"), F.array_sort(F.concat(base, entropy_spans(text, base))).alias("all")
    )
    return with_base.withColumn(result, both)


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(
                ":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string")
            ),
        ),
        ",",
    )


def mask_secrets(documents: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """Replace each run of overlapping spans by ``mask``; columns are kept.

    ``n_chars``, where there is one, is counted anew for changed texts.  Cases as in ``find_secrets``; a null
    text stays null.
    """
    # All other columns travel in one, so that none can have a name that is used here.
    found = find_secrets(documents.select(F.struct("*").alias("_document"), "text"), "_secrets")
    spans = F.col("_secrets")["all"]

    def marked(spans: Column) -> Column:
        ends = F.transform(spans, lambda x: x["end"])
        earlier = _before(ends, F.lit(0).cast("bigint"), _larger)
        return F.transform(
            F.arrays_zip(spans.alias("span"), earlier.alias("until")),
            lambda x: F.struct(
                x["span"]["start"].alias("start"),
                x["span"]["end"].alias("end"),
                (x["span"]["start"] >= x["until"]).alias("opens"),
            ),
        )

    def written(span: Column, low: Column, begin: Column, end: Column) -> Column:
        return F.when(span["opens"] & (span["start"] >= low), F.lit(mask)).otherwise(F.lit(""))

    hit = F.size(spans) > 0
    cut = _bound(marked(spans), lambda spans: _rewritten(F.col("text"), spans, written))
    masked = F.when(hit, cut).otherwise(F.col("text"))
    result = found.withColumn("_masked", masked)
    own = {"text": F.col("_masked")}
    if "n_chars" in documents.columns:
        count = F.when(hit, F.length("_masked").cast(documents.schema["n_chars"].dataType))
        own["n_chars"] = count.otherwise(F.col("_document")["n_chars"])
    return result.select(*(own.get(name, F.col("_document")[name]).alias(name) for name in documents.columns))
