"""Time column functions for zone-less timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``, followed by six fraction digits when there is a fraction."""
    whole = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def short_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with the fraction's trailing zeros, and a bare dot, dropped."""
    return ts.cast("string")


def second_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def without_zone(text: Column) -> Column:
    """Time text without its trailing ``Z`` and with a decimal point."""
    return F.replace(F.rtrim(text, F.lit("Z")), F.lit(","), F.lit("."))


def parse_log_time(text: Column) -> Column:
    """Time of a plain log line, whose shape the line pattern has already checked.

    The zone letter is dropped, not applied; a lower-case one makes the time invalid.
    """
    return F.replace(without_zone(text), F.lit("t"), F.lit("T")).try_cast("timestamp_ntz")


# ISO date with optional time and offset, in extended or basic form.
_ISO = (
    r"\A([0-9]{4})(-?)([0-9]{2})\2([0-9]{2})"
    r"(?:(?s:.)([0-9]{2})(?:(:?)([0-9]{2})(?:\6([0-9]{2})(?:\.([0-9]+))?)?)?"
    r"(?:[+-][0-9]{2}(?::?[0-9]{2}(?::?[0-9]{2}(?:\.[0-9]+)?)?)?)?)?\z"
)
# ISO week date; Monday where the day is left out.
_WEEK = r"\A([0-9]{4})(-?)W([0-9]{2})(?:\2([0-9]))?(?=\z|[^0-9-])"
_ISO_USUAL = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?\z"


def _with_calendar_date(plain: Column) -> Column:
    """The text with its week date replaced by the calendar date; null if there is none."""
    year, week, day = (F.regexp_extract(plain, _WEEK, group) for group in (1, 3, 4))
    day = F.coalesce(F.nullif(day, F.lit("")), F.lit("1")).cast("int")
    week = week.cast("int")
    # The fourth of January is in the first week, the 28th of December in the last.
    fourth = F.concat(year, F.lit("-01-04")).try_cast("date")
    last = F.weekofyear(F.concat(year, F.lit("-12-28")).try_cast("date"))
    date = F.date_add(fourth, (week - 1) * 7 + day - 1 - F.weekday(fourth))
    dashed = F.concat(F.date_format(date, "yyyy-MM-dd"), F.regexp_replace(plain, _WEEK, ""))
    return F.when(week.between(1, last) & day.between(1, 7), dashed)


def parse_iso_time(plain: Column) -> Column:
    """ISO time of a JSON log line, after ``without_zone``.

    An offset is dropped and the wall clock kept.
    """
    plain = F.when(F.rlike(plain, F.lit(_WEEK)), _with_calendar_date(plain)).otherwise(plain)

    def part(group: int, missing: str) -> Column:
        return F.lpad(F.regexp_extract(plain, _ISO, group), 2, missing)

    rebuilt = F.concat(
        F.concat_ws("-", *(F.regexp_extract(plain, _ISO, group) for group in (1, 3, 4))),
        F.lit(" "),
        F.concat_ws(":", *(part(group, "0") for group in (5, 7, 8))),
        F.lit("."),
        F.rpad(F.regexp_extract(plain, _ISO, 9), 6, "0"),
    )
    return F.when(F.startswith(plain, F.lit("0000")), F.lit(None)).otherwise(
        F.when(F.rlike(plain, F.lit(_ISO_USUAL)), plain)
        .when(F.rlike(plain, F.lit(_ISO)), rebuilt)
        .try_cast("timestamp_ntz")
    )
