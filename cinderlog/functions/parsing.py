"""Column functions that turn one raw log line into fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed

_MARK = "\x01"
# A bare number word, and before it all strings and other characters since the last one.
_WORDS = r"""\G((?:[^"NI-]|"(?:[^"\\]|\\.)*+"|-(?!Infinity))*+)(?:NaN|-?Infinity)"""


def normalize_level(level: Column) -> Column:
    """Upper-case level with its alias resolved; null for an unknown level."""
    upper = F.upper(level)
    result = F.when(upper.isin(*fixed.LEVELS), upper)
    for alias, target in fixed.LEVEL_ALIASES.items():
        result = result.when(upper == alias, F.lit(target))
    return result


def marked_groups(line: Column) -> Column:
    """A plain log line rewritten to its timestamp, level, service and message.

    One pass of the pattern; a mark byte stands before each group.  Any other line stays as it
    is.  No line that starts with the mark byte matches the pattern.
    """
    return F.regexp_replace(line, fixed.LOG_LINE, f"{_MARK}$1{_MARK}$2{_MARK}$3{_MARK}$4")


def plain_parts(line: Column, marked: Column) -> Column:
    """Array ``['', timestamp, level, service, message]`` of ``marked_groups``, else null."""
    matched = F.startswith(marked, F.lit(_MARK)) & ~F.startswith(line, F.lit(_MARK))
    return F.when(matched, F.split(marked, _MARK, 5))


def looks_like_json(line: Column) -> Column:
    return F.startswith(F.ltrim(line, F.lit(fixed.WHITESPACE)), F.lit("{"))


def json_pair(line: Column) -> Column:
    """Variant of the array ``[line, hash of the line]``, or null if that is not valid JSON.

    The words ``NaN``, ``Infinity`` and ``-Infinity``, which many writers put for numbers that JSON
    has no form for, are read as null.
    """

    def parsed(value: Column) -> Column:
        return F.try_parse_json(
            F.concat(F.lit("["), value, F.lit(","), F.xxhash64(line).cast("string"), F.lit("]"))
        )

    worded = F.when(F.rlike(line, F.lit("NaN|Infinity")), F.regexp_replace(line, _WORDS, "$1null"))
    return F.coalesce(parsed(line), parsed(worded))


def json_object(line: Column, pair: Column) -> Column:
    """The line as a variant, from ``json_pair``; null unless it is exactly one JSON value.

    The variant parser ignores text behind the first value.  The line is therefore parsed as
    the first of two array elements; the second, its own hash, has to come out again.
    """
    whole = F.try_variant_get(pair, "$[1]", "bigint") == F.xxhash64(line)
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def json_field(payload: Column, field: str) -> Column:
    """The value, of any type, under the first alias that is present."""
    return F.coalesce(
        *(
            F.try_variant_get(payload, f'$["{alias}"]', "variant")
            for alias in fixed.JSON_FIELDS[field]
        )
    )


def json_text(value: Column) -> Column:
    """The value if it is a string, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))
