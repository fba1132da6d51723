"""Quality rules whose cutoffs are set by exact binomial bounds on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf, rounds
from cinderlog.sources.staging import broadcast_if_small, stage

REPEAT_WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
# Part of a stratum's good documents that all rules together may reject, and the chance of a
# wrong bound over all strata and rules.
FALSE_REJECTIONS = 0.02
ERROR = 0.05

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]
_STRUCT = "struct<" + ", ".join(f"{name}: bigint" for name in _COUNTS) + ">"


def repeated_words(words_of: list[list[bytes]], window: int = REPEAT_WINDOW) -> list[int]:
    """Per text: words inside windows that occur at least twice in the text."""
    ids: list[int] = []
    for words in words_of:
        # Ids start anew for each text, so that windows of two texts are never equal.
        own: dict[bytes, int] = {}
        base = len(ids)
        ids.extend(own.setdefault(word, base + len(own)) for word in words)
    lengths = np.array([len(words) for words in words_of], dtype=np.int64)
    ends = np.cumsum(lengths)
    total = len(ids)
    if total < window:
        return [0] * len(words_of)
    word = np.array(ids, dtype=np.int64)
    run, size = word, 1
    while size < window:
        step = min(size, window - size)
        pairs = run[: len(run) - step] * (total + 1) + run[step:]
        _, run = np.unique(pairs, return_inverse=True)
        size += step
    left = np.repeat(ends, lengths) - np.arange(total)
    whole = left[: len(run)] >= window
    counts = np.bincount(run[whole], minlength=int(run.max()) + 1)
    starts = np.flatnonzero(whole & (counts[run] > 1))
    steps = np.zeros(total + 1, dtype=np.int64)
    steps[starts] += 1
    steps[starts + window] -= 1
    inside = np.concatenate(([0], np.cumsum(np.cumsum(steps[:-1]) > 0)))
    return (inside[ends] - inside[ends - lengths]).tolist()


def _counts(text: bytes, words: int, repeated: int) -> tuple[int, ...]:
    codes = np.frombuffer(text, dtype=np.uint8)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        words,
        int(np.count_nonzero(~_SPACE[codes] & ((codes & 0xC0) != 0x80))),
        int(np.count_nonzero(_SYMBOLS[codes])),
        len(lines) - len(set(lines)),
        repeated,
        int(np.count_nonzero((codes >= 65) & (codes <= 90))),
        text.count(b"!"),
    )


def text_counts(text: Column) -> Column:
    """A struct of whole-text counts; null counts as empty.

    ``n_words`` and ``word_chars`` (code points) of words between ASCII white space; ``n_symbols``;
    ``n_dup_lines``, lines with a word that equal an earlier line; ``n_repeat_words``, words in
    five-word windows found twice or more in the text; ``n_upper`` and ``n_marks``, capitals A-Z and
    exclamation marks.
    """

    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for texts in rounds(batch):
                words = [value.split() for value in texts]
                repeats = repeated_words(words)
                rows += [_counts(*x) for x in zip(texts, map(len, words), repeats)]
            columns = list(zip(*rows)) or [()] * len(_COUNTS)
            yield pa.StructArray.from_arrays(
                [pa.array(column, type=pa.int64()) for column in columns], names=_COUNTS
            )

    counted.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(counted, _STRUCT)(text.cast("binary"))


def _share(part: str, whole: str, scale: float = 1.0) -> Column:
    return F.coalesce(F.col(part) * F.lit(scale) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))


def measures() -> dict[str, tuple[Column, list[float]]]:
    """The rules: what is measured and the cutoffs to try, from mild to strict.

    A document is rejected if a measure is above the rule's cutoff.
    """
    shares = [0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02]
    lengths = [40.0, 30.0, 25.0, 20.0, 18.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0]
    return {
        "symbols": (_share("n_symbols", "word_chars"), shares),
        "capitals": (_share("n_upper", "word_chars"), [0.9, 0.8, 0.7, 0.6, *shares]),
        "marks": (_share("n_marks", "word_chars"), shares),
        "repeats": (_share("n_repeat_words", "n_words"), shares),
        "lines": (_share("n_dup_lines", "n_words"), shares),
        "long words": (_share("word_chars", "n_words"), lengths),
    }


def within_bound(rejected: int, total: int, limit: float, error: float) -> bool:
    """Whether the exact upper bound of the rejection rate, at confidence 1 - error, is in the limit.

    The bound is at most ``limit`` if and only if ``rejected`` or fewer of ``total`` have a chance of
    at most ``error`` at the rate ``limit``.
    """
    if rejected > total * limit:
        return False
    tail = 0.0
    for k in range(rejected, -1, -1):
        term = exp(
            lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + k * log(limit) + (total - k) * log1p(-limit)
        )
        tail += term
        if term < 1e-17 * tail:
            break
    return tail <= error


def strictest(counts: list[int], total: int, limit: float, error: float) -> int | None:
    """The last step before the first whose rejections are not within the bound, from mild to strict.

    Testing in this fixed order needs no correction for the number of steps.
    """
    best = None
    for step, rejected in enumerate(counts):
        if not within_bound(rejected, total, limit, error):
            break
        best = step
    return best


def _steps() -> int:
    return max(len(cutoffs) for _, cutoffs in measures().values())


def _cutoff(cutoffs: list[float], step: int) -> float:
    return cutoffs[min(step, len(cutoffs) - 1)]


def first_step() -> Column:
    """The first step at which any rule rejects the document; the number of steps if none does."""
    never = F.lit(_steps())
    first = []
    for measure, cutoffs in measures().values():
        at = never
        for step in range(len(cutoffs) - 1, -1, -1):
            at = F.when(measure > cutoffs[step], F.lit(step)).otherwise(at)
        first.append(at)
    return F.least(*first)


def learn_cutoffs(
    labelled: DataFrame,
    stratum: str,
    false_rejections: float = FALSE_REJECTIONS,
    error: float = ERROR,
) -> DataFrame:
    """``<stratum>, cutoffs`` (map of rule to cutoff) from the counts of good documents.

    Step by step all rules get stricter together.  A step is tested by the good documents that any rule
    rejects there, so the whole of ``false_rejections`` serves one test; in the fixed order of steps a stratum needs
    no correction, and the error is shared by the strata and one test more (Bonferroni).  That one is for the strata
    with too few documents to pass even without a rejection: they are tested together and
    share their cutoffs, so for them the bound holds for all their documents taken together and not for each stratum.

    So with chance ``1 - error``, no large stratum, and not the small ones together, lose more than
    ``false_rejections`` of their good documents.  Where even the first step fails there are no cutoffs.
    """
    steps = _steps()
    rejected = F.array(*(F.sum((F.col("_first") <= step).cast("bigint")) for step in range(steps)))
    counted = stage(
        labelled.withColumn("_first", first_step())
        .groupBy(stratum)
        .agg(F.count(F.lit(1)).alias("_total"), rejected.alias("_rejected")),
        "rule-counts",
    )
    each = error / (counted.count() + 1)

    @F.udf("boolean")
    def enough(total):
        return within_bound(0, total, false_rejections, each)

    @F.udf("int")
    def chosen(rejected, total):
        return strictest(rejected, total, false_rejections, each)

    sized = counted.withColumn("_large", enough("_total"))
    sums = F.array(*(F.sum(F.col("_rejected")[step]) for step in range(steps)))
    pooled = sized.where(~F.col("_large")).agg(sums.alias("_rejected"), F.sum("_total").alias("_total"))
    pooled = pooled.where(F.col("_total") > 0).select(chosen("_rejected", "_total").alias("_pooled"))
    own = F.when(F.col("_large"), chosen("_rejected", "_total"))
    # The pool is one row at most.
    stepped = sized.withColumn("_own", own).join(F.broadcast(pooled), ~F.col("_large"), "left")
    step = F.coalesce("_own", "_pooled")
    entries = [
        F.struct(
            F.lit(name).alias("key"),
            F.element_at(F.array(*(F.lit(_cutoff(cutoffs, at)) for at in range(steps))), step + 1).alias("value"),
        )
        for name, (_, cutoffs) in measures().items()
    ]
    set_ = F.when(step.isNotNull(), F.map_from_entries(F.array(*entries)))
    return stepped.select(stratum, F.coalesce(set_, F.create_map().cast("map<string, double>")).alias("cutoffs"))


def judge(
    documents: DataFrame,
    labels: DataFrame,
    stratum: str = "lang",
    false_rejections: float = FALSE_REJECTIONS,
    error: float = ERROR,
) -> DataFrame:
    """``doc_id``, the counts of ``text_counts``, ``base_failed``, ``broken`` (rules) and ``kept``.

    ``documents`` has ``doc_id, text`` and the stratum's column, ``labels`` has ``doc_id, quality``.
    A document fails the base rules with fewer than 10 words or more than 20 % repeated words;
    it breaks a rule if its measure is above the stratum's cutoff, learnt from all documents labelled
    good (quality 1); see ``learn_cutoffs`` for strata with few of them.  A stratum without any has no cutoffs.  Documents that fail the base rules say nothing about the cutoffs and are left out there.

    A null text is empty and fails the base rules; a null stratum is a stratum; labels of null or unknown
    ids, and null labels, count for nothing; a document labelled good twice counts once per
    document row.  Empty tables give an empty result; without labels only the base rules reject.
    Other columns are ignored.  Numbers are staged, one row per document without its text.
    """
    counted = stage(
        documents.select(
            "doc_id", F.col(stratum).cast("string").alias("_stratum"), text_counts(F.col("text")).alias("_counts")
        ).select("doc_id", "_stratum", "_counts.*"),
        "text-counts",
    )
    base = (F.col("n_words") < LEAST_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(MOST_REPEATED) * F.col("n_words")
    )
    judged = counted.withColumn("base_failed", base)
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("_good")).distinct()
    labelled = judged.where(~F.col("base_failed")).join(good, F.col("doc_id") == F.col("_good"))
    cutoffs = stage(learn_cutoffs(labelled, "_stratum", false_rejections, error), "rule-cutoffs")
    chosen = cutoffs.select(F.col("_stratum").alias("_of"), "cutoffs")
    broken = F.filter(
        F.array(
            *(F.when(measure > F.col("cutoffs")[name], F.lit(name)) for name, (measure, _) in measures().items())
        ),
        lambda name: name.isNotNull(),
    )
    return (
        judged.join(broadcast_if_small(chosen), F.col("_stratum").eqNullSafe(F.col("_of")), "left")
        .withColumn("broken", F.coalesce(broken, F.array().cast("array<string>")))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
        .select("doc_id", *_COUNTS, "base_failed", "broken", "kept")
    )
