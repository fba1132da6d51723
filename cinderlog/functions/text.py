"""Text column functions: trimming, decoding, redaction, labels, keyword counts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed

BYTE_ORDER_MARK = chr(0xFEFF)


def strip(text: Column) -> Column:
    """Remove every kind of whitespace from both ends (SQL ``trim`` knows only the space)."""
    return F.btrim(text, F.lit(fixed.WHITESPACE))


def strip_start(text: Column) -> Column:
    return F.ltrim(text, F.lit(fixed.WHITESPACE))


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(fixed.WHITESPACE))


def unify_line_ends(text: Column) -> Column:
    """Turn every line boundary of a decoded text into ``\\n``."""
    return F.regexp_replace(text, fixed.LINE_BOUNDARY, "\n")


def decode_utf8(content: Column) -> Column:
    """Bytes to text: bad bytes become U+FFFD, a leading byte-order mark is dropped."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.when(
        F.startswith(text, F.lit(BYTE_ORDER_MARK)), F.substr(text, F.lit(2))
    ).otherwise(text)


def contains_any(text: Column, keywords: Iterable[str]) -> Column:
    tests = [F.contains(text, F.lit(keyword)) for keyword in keywords]
    return reduce(lambda left, right: left | right, tests)


def count_occurrences(text: Column, keyword: str) -> Column:
    """Non-overlapping occurrences of an ASCII keyword.

    Byte lengths are constant-time; the keyword is ASCII, so they give the same quotient as
    character lengths.
    """
    removed = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(keyword), F.lit("")))
    return (removed / F.lit(len(keyword))).cast("bigint")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(strip(text), "(?U)" + fixed.WHITESPACE_CLASS + "+", " ")


def needs_log_context(question: Column) -> Column:
    """False for a definition question, which is answered from runbooks alone."""
    return ~F.rlike(
        collapse_whitespace(F.lower(question)), F.lit("|".join(fixed.DEFINITION_QUESTIONS))
    )


def normalize_citations(answer: Column) -> Column:
    """``( L4 )`` becomes ``[L4]``; the case of the letter is kept."""
    return F.regexp_replace(answer, fixed.PARENTHESISED_LABEL, "[$1]")


def cited_labels(answer: Column) -> Column:
    """Array of the distinct ``[L#]``, ``[R#]`` and ``[#]`` labels, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(fixed.CITED_LABEL), F.lit(0)))


def http_statuses(text: Column) -> Column:
    """Array of the distinct stand-alone three-digit numbers from 100 to 599."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(fixed.HTTP_STATUS), F.lit(1)))


def source_name(filename: Column) -> Column:
    """Upload name to ``custom/<name>``; null when no name remains."""
    last = F.regexp_extract(F.regexp_replace(filename, r"/+\z", ""), r"([^/]*)\z", 1)
    name = F.regexp_replace(strip(last), r"[\\/]", "_")
    return F.when((name != "") & (name != "."), F.concat(F.lit(fixed.CUSTOM_PREFIX), name))


def file_suffix(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"[^/](\.[^./]+)\z", 1))
