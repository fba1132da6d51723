import re
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.operators import events


def parsed(lines, *texts):
    rows = events.parse_lines(lines(a=list(texts))).orderBy("line_number").collect()
    return [row.asDict() for row in rows]


def test_levels_order_and_micros(lines, events_of):
    found = events.in_event_order(
        events_of(
            a=[
                "2025-11-30 23:59:59 ERROR ledger - write refused",
                "2025-11-30T23:59:58.125Z [WARN] [cache] nearly out of slots",
                "2025-12-01 00:00:00 FATAL edge: gone",
            ]
        )
    ).collect()
    assert [row.level for row in found] == ["WARNING", "ERROR", "CRITICAL"]
    assert found[0].service == "cache"
    assert found[0].ts == datetime(2025, 11, 30, 23, 59, 58, 125000)
    assert [row.message for row in found] == ["nearly out of slots", "write refused", "gone"]


def test_rejects_and_blank_lines(lines):
    rows = parsed(
        lines,
        "just some words",
        "",
        " \t　",
        '{"time":"2025-11-30',
        "2025-13-41 25:61:00 ERROR ledger no such time",
        "and more words",
    )
    assert [(row["line_number"], row["status"]) for row in rows] == [
        (1, "rejected"), (4, "rejected"), (5, "rejected"), (6, "rejected"),
    ]


def test_number_words_in_json(lines):
    head = '"time":"2025-11-30 10:00:00","level":"INFO","logger":"s"'
    rows = parsed(
        lines,
        '{%s,"message":"NaN, -Infinity: [NaN]","a":NaN,"b":[-Infinity, Infinity],"c":{"d":NaN}}' % head,
        '{%s,"message":NaN}' % head,
        '{%s,"message":"x","a":Nan}' % head,
        '{%s,"message":"a \\" NaN","a": NaN }' % head,
        '{%s,"message":"x","a":NaN} NaN' % head,
    )
    assert [row["status"] for row in rows] == ["event", "rejected", "rejected", "event", "rejected"]
    assert rows[0]["message"] == "NaN, -Infinity: [NaN]" and rows[3]["message"] == 'a " NaN'


def test_week_dates(lines):
    times = {
        "2026-W01-1T10:00:00": datetime(2025, 12, 29, 10),
        "2026W537": None if not _has_week_53(2026) else datetime(2027, 1, 3),
        "2020-W53-7 01:02:03.5Z": datetime(2021, 1, 3, 1, 2, 3, 500000),
        "2021-W53-1": None,
        "2026-W10": datetime(2026, 3, 2),
        "2026W103T1112": datetime(2026, 3, 4, 11, 12),
        "2026-W10-8": None,
        "2026-W00-1": None,
        "2026-W103": None,
    }
    rows = parsed(lines, *('{"time":"%s","level":"INFO","logger":"s","message":"m"}' % text for text in times))
    assert [row["ts"] for row in rows] == list(times.values())


def _has_week_53(year):
    return datetime(year, 12, 28).isocalendar().week == 53


def test_json_aliases(lines):
    rows = parsed(
        lines,
        '{"@timestamp":"2026-08-06T14:03:12Z","severity":"error","service_name":"checkout","msg":"x"}',
        '  {"time":"2026-08-06 14:03:13","level":"WARN","logger":"cart","message":" y "}',
        '{"datetime":"2026-08-06","log_level":"fatal","component":"c","event":"e"}',
    )
    assert [row["level"] for row in rows] == ["ERROR", "WARNING", "CRITICAL"]
    assert [row["service"] for row in rows] == ["checkout", "cart", "c"]
    assert rows[1]["message"] == " y "
    assert rows[2]["ts"] == datetime(2026, 8, 6)


def test_json_lines_that_are_rejected(lines):
    good = '"timestamp":"2026-08-06 14:03:13","level":"INFO","service":"s","message":"m"'
    assert parsed(lines, "{" + good + "}")[0]["status"] == "event"
    bad = [
        "{" + good + "} trailing",
        "{" + good + "},{}",
        "{" + good + "}] x",
        "[{" + good + "}]",
        '{"timestamp":null,"time":"2026-08-06 14:03:13","level":"INFO","service":"s","message":"m"}',
        '{"timestamp":"2026-08-06 14:03:13","level":30,"service":"s","message":"m"}',
        '{"timestamp":"2026-08-06 14:03:13","level":"INFO","service":"  ","message":"m"}',
        '{"timestamp":"2026-08-06 14:03:13","level":"LOUD","service":"s","message":"m"}',
        '{"timestamp":" 2026-08-06 14:03:13","level":"INFO","service":"s","message":"m"}',
        '{"timestamp":"2026-08","level":"INFO","service":"s","message":"m"}',
        '{"timestamp":"2026-08-06 14:03:13z","level":"INFO","service":"s","message":"m"}',
        '{"level":"INFO","service":"s","message":"m"}',
    ]
    assert {row["status"] for row in parsed(lines, *bad)} == {"rejected"}
    assert len(parsed(lines, *bad)) == len(bad)


def test_repeated_json_key_counts_last(lines):
    row = parsed(
        lines,
        '{"timestamp":"2026-08-06","level":"info","level":"fatal","service":"s","message":"m"}',
    )[0]
    assert row["level"] == "CRITICAL"


def test_json_times_keep_the_wall_clock(lines):
    times = {
        "2026-08-07T10:15:20+03:00": datetime(2026, 8, 7, 10, 15, 20),
        "2026-08-07T10": datetime(2026, 8, 7, 10),
        "2026-08-07 10:15": datetime(2026, 8, 7, 10, 15),
        "20260807T101520": datetime(2026, 8, 7, 10, 15, 20),
        "2026-08-07_10:15:20,1234567": datetime(2026, 8, 7, 10, 15, 20, 123456),
        "2026-08-07T10:15:20.5Z": datetime(2026, 8, 7, 10, 15, 20, 500000),
    }
    rows = parsed(
        lines,
        *(
            '{"time":"%s","level":"INFO","service":"s","message":"m"}' % text
            for text in times
        ),
    )
    assert [row["ts"] for row in rows] == list(times.values())


def test_quirks_of_the_line_pattern(lines):
    rows = parsed(
        lines,
        "2026-08-06 14:03:12 ERROR svc",
        "2026-08-06t14:03:12,25 [warn] [db.x]: hi  ",
        "2026-08-06 14:03:12z ERROR svc message",
        "2026-08-06 25:03:12 ERROR svc message",
        "\x01a\x01b\x01c\x01d",
    )
    assert (rows[0]["service"], rows[0]["message"]) == ("sv", "c")
    assert (rows[1]["level"], rows[1]["service"], rows[1]["message"]) == ("WARNING", "db.x", "hi")
    assert rows[1]["ts"].microsecond == 250000
    assert [row["status"] for row in rows[2:]] == ["rejected"] * 3


def test_blank_message(lines):
    rows = parsed(
        lines,
        "2026-08-06 14:03:12 ERROR svc -   ",
        "2026-08-06 14:03:12 ERROR svc -",
        '{"time":"2026-08-06 14:03:12","level":"INFO","service":"s","message":" "}',
    )
    assert [row["message"] for row in rows] == [" ", "-", None]


# The fixed line pattern in Python's dialect, matched by Python's engine.
FORMAT = re.compile(fixed.LOG_LINE.removeprefix("(?idU)"), re.IGNORECASE)


LINE_PIECES = st.sampled_from(
    ["2026-08-06 14:03:12", "2026-08-06T14:03:12.5Z", " ", "  ", "\t", "ERROR", "[warn]", "[", "]",
     "svc", "[a.b-c]", "-", ":", "x", "message text", "info", "FATAL"]
)
STARTS = st.sampled_from(["2026-08-06 14:03:12 ERROR", "2026-08-06 14:03:12,1 [Warn] ", ""])


@settings(max_examples=6, deadline=None)
@given(
    st.lists(
        st.tuples(STARTS, st.lists(LINE_PIECES, min_size=1, max_size=8)).map(
            lambda parts: parts[0] + "".join(parts[1])
        ),
        min_size=60,
        max_size=80,
    )
)
def test_plain_lines_follow_the_format(spark, texts):
    rows = spark.createDataFrame(
        [("a", number, text) for number, text in enumerate(texts)],
        "incident_id string, line_number long, raw_line string",
    )
    found = {row.line_number: row for row in events.parse_lines(rows).collect()}
    for number, text in enumerate(texts):
        match = FORMAT.fullmatch(text)
        if not text.strip():
            assert number not in found
        elif match is None:
            assert found[number].status == "rejected"
        else:
            assert (found[number].service, found[number].message) == match.group(3, 4)


def test_no_lines(lines, spark):
    empty = spark.createDataFrame([], lines(a=["x"]).schema)
    assert events.parse_lines(empty).count() == 0


def test_require_no_rejects(lines):
    fine = events.parse_lines(lines(a=["2026-08-06 14:03:12 INFO svc - ok"]))
    assert events.require_no_rejects(fine).count() == 1
    bad = events.parse_lines(lines(a=["what"]))
    try:
        events.require_no_rejects(bad).collect()
    except Exception as error:
        assert "rejected log line 1 in a" in str(error)
    else:
        raise AssertionError("a rejected line has to fail the job")


def test_filters_do_not_parse_twice(lines):
    plan = (
        events.serious(events.events_of(events.parse_lines(lines(a=["x"]))))
        ._jdf.queryExecution().optimizedPlan().toString()
    )
    # The pattern begins with the flags; the compiled plan holds it once.
    assert plan.count("TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL") == 1


def test_parsing_runs_on_a_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("2026-08-06 14:03:12 ERROR svc - boom\nnope\n")
    stream = spark.readStream.text(str(folder)).select(
        F.lit("a").alias("incident_id"), F.lit(1).cast("long").alias("line_number"),
        F.col("value").alias("raw_line"),
    )
    job = (
        events.parse_lines(stream).writeStream.format("memory").queryName("parsed_stream").start()
    )
    job.processAllAvailable()
    job.stop()
    assert {row.status for row in spark.table("parsed_stream").collect()} == {"event", "rejected"}


def redact(spark, *texts):
    rows = spark.createDataFrame([(text,) for text in texts], "t string")
    found = events.redact_columns(rows, ["t"], "n").collect()
    return [(row.t, row.n) for row in found]


def test_redaction(spark):
    assert redact(
        spark,
        "Login request email=alice@example.com source_ip=192.168.10.4",
        "Authorization Bearer abcdefghijk12345",
        "token=tok_123456789 password=SuperSecret42 api_key=abcd1234secret",
        "password=[REDACTED]",
        "user a@b.co from 10.0.0.1 api_key=k BEARER abcdefgh1",
        "nothing here. at all: =",
        "token=short PASSWD : x;",
        "Passwd : x; ſecret=1",
    ) == [
        ("Login request email=[REDACTED_EMAIL] source_ip=[REDACTED_IP]", 2),
        ("Authorization Bearer [REDACTED]", 1),
        ("token=[REDACTED] password=[REDACTED] api_key=[REDACTED]", 3),
        ("password=[REDACTED]", 1),
        ("user [REDACTED_EMAIL] from [REDACTED_IP] api_key=[REDACTED] Bearer [REDACTED]", 4),
        ("nothing here. at all: =", 0),
        ("token=short PASSWD=[REDACTED];", 1),
        ("Passwd=[REDACTED]; ſecret=[REDACTED]", 2),
    ]


def expected_redaction(text):
    count = 0
    for pattern, replacement in fixed.REDACTIONS:
        flags = re.IGNORECASE if "(?i" in pattern else 0
        bare = re.sub(r"^\(\?\w+\)", "", pattern)
        text, found = re.subn(bare, replacement.replace("$1", r"\1"), text, flags=flags)
        count += found
    return text, count


PIECES = st.sampled_from(
    ["a@b.com", "1.2.3.4", "999.1.2.3", "Bearer ", "token", "=", ":", " ", "password", "secret",
     "api-key", "APIKEY", "abcdefgh", "é", ",", ";", "[REDACTED]", ".", "x", "\t", "12345678"]
)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=40, max_size=60))
def test_redaction_equals_python_patterns(spark, texts):
    assert redact(spark, *texts) == [expected_redaction(text) for text in texts]


def test_redacted_events_leave_service_and_rejects(lines):
    parsed_rows = events.parse_lines(
        lines(a=["2026-08-06 14:03:12 ERROR 10.0.0.1 - from 10.0.0.2", "10.0.0.3"])
    )
    masked = events.redact_events(events.events_of(parsed_rows))
    row = masked.first()
    assert (row.service, row.message, row.redactions) == ("10.0.0.1", "from [REDACTED_IP]", 2)
    assert row.raw_line == "2026-08-06 14:03:12 ERROR [REDACTED_IP] - from [REDACTED_IP]"
    assert events.redaction_totals(masked).first().redactions == 2
    assert events.rejected_of(parsed_rows).first().raw_line == "10.0.0.3"
    plain = events.redact_events(events.events_of(parsed_rows), enabled=False).first()
    assert (plain.message, plain.redactions) == ("from 10.0.0.2", 0)
