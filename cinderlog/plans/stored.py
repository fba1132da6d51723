"""Registered queries that go through files and tables at rest, with their expected results in SQL.

The given tables are written out as log files, uploads, runbooks and tables in the staging folder and read
back through the sources.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog import fixed_values as fixed
from cinderlog.functions.text import source_name
from cinderlog.functions.vectors import cosine, from_json_text, to_json_text
from cinderlog.operators import (
    embedding,
    evaluation,
    events,
    evidence,
    metrics,
    ordering,
    prompts,
    reports,
    retrieval,
)
from cinderlog.plans import analysis
from cinderlog.plans.driver_tables import DriverTables, answers_sql
from cinderlog.plans.oracle import (
    _DOCUMENTS,
    _MASKED,
    _NORMALIZED,
    _PACKED,
    ANSWERS,
    EVIDENCE,
    INDEX,
    LINES,
    MERGED,
    ORACLES,
    QUESTIONS,
    VECTORS,
    _part_columns,
    _quoted,
    _with,
)
from cinderlog.plans.queries import (
    QUERY_PART_BYTES,
    REPLACED_SOURCE,
    _bigints,
    _incident_evidence,
    _report_tables,
    query,
)
from cinderlog.sources import documents, growing_logs, logs, markdown_files, tables
from cinderlog.sources.staging import stage, staging_root


def _folder(t: DriverTables, name: str) -> str:
    return f"{staging_root(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- log files -------------------------------------------------------------------------------


def _log_files(t: DriverTables) -> str:
    """A folder with one file for each incident, its lines in order."""
    path = _folder(t, "log-files")
    lines = t.log_lines().repartition("incident_id").sortWithinPartitions("incident_id", "line_number")
    lines.select("incident_id", "raw_line").write.partitionBy("incident_id").text(path)
    return path


def _named(lines: DataFrame) -> DataFrame:
    name = F.regexp_extract("incident_id", "incident_id=([^/]+)/", 1)
    return lines.select(name.alias("incident_id"), "line_number", "raw_line")


@query
def read_log_files(t: DriverTables) -> DataFrame:
    return _named(logs.read_log_files(t.spark, f"{_log_files(t)}/*"))


@query
def read_uploaded_logs(t: DriverTables) -> DataFrame:
    """As ``read_log_files``, with the empty line behind the last line feed."""
    return _named(logs.read_uploaded_logs(t.spark, f"{_log_files(t)}/*"))


@query
def growing_metrics(t: DriverTables) -> DataFrame:
    """Metrics after two runs, the second of which finds more files; files without events have zeros."""
    files, state = _log_files(t), _folder(t, "log-state")
    growing_logs.update(t.spark, f"{files}/incident_id=incident-hot", state)
    growing_logs.update(t.spark, f"{files}/*", state)
    name = F.regexp_extract("incident_id", "incident_id=([^/]+)/", 1)
    return growing_logs.read_state(t.spark, state).metrics().withColumn("incident_id", name)


@query
def demo_scenarios(t: DriverTables) -> DataFrame:
    """Lines of incidents whose file is named like one of the demo files."""
    names = F.array(*(F.lit(name) for name in fixed.DEMO_INCIDENTS.values()), F.lit("other.log"))
    picked = F.get(names, (F.col("line_number") % (len(fixed.DEMO_INCIDENTS) + 1)).cast("int"))
    lines = t.log_lines().withColumn("source_name", picked)
    return logs.with_scenario(lines).select("incident_id", "line_number", "source_name", "scenario")


@query
def strict_events(t: DriverTables) -> DataFrame:
    """Events of lines that must all be readable."""
    readable = stage(t.parsed().where(F.col("status") != "rejected"), "readable")
    return events.require_no_rejects(readable).select("incident_id", "line_number", "level", "service")


@query
def all_incident_metrics(t: DriverTables) -> DataFrame:
    """Metrics also of incidents without any event: one for each user."""
    silent = t.table("events").select(F.concat(F.lit("silent-"), F.col("user_id").cast("string")).alias("incident_id"))
    incidents = t.log_lines().select("incident_id").unionByName(silent)
    return metrics.incident_metrics(t.events(), incidents)


# --- documents -------------------------------------------------------------------------------

_EMPTY_PAGE = 10


def _page_files(t: DriverTables) -> str:
    """Each page as a text file and, without its text, as a JSON file; every tenth text is blank."""
    path = _folder(t, "page-files")
    text = F.when(F.col("page_id") % _EMPTY_PAGE == 0, " \t").otherwise(F.col("html"))
    pages = t.spread(t.table("pages").select("page_id", text.alias("text")))
    name = F.concat(F.lit("part-"), F.monotonically_increasing_id().cast("string")).alias("name")
    markdown_files.export_texts(pages.select(name, "text"), f"{path}/text", ".txt")
    ids = pages.select(name, F.to_json(F.struct("page_id")).alias("text"))
    markdown_files.export_texts(ids, f"{path}/json", ".json")
    return path


@query
def read_uploads(t: DriverTables) -> DataFrame:
    """Every page uploaded twice: once as a text and once as a file of a type that is not taken."""
    path = _page_files(t)
    # Folders are listed as a whole; of a pattern Spark looks at every file by itself.
    found = documents.read_uploads(t.spark, [f"{path}/text", f"{path}/json"])
    suffix = F.regexp_extract("source", r"(\.[a-z]+)\z", 1)
    return found.select(suffix.alias("suffix"), F.md5("text").alias("text_md5"), "reason")


@query
def accepted_documents(t: DriverTables) -> DataFrame:
    found = documents.read_uploads(t.spark, f"{_page_files(t)}/text")
    return documents.accepted_documents(found).select(F.md5("text").alias("text_md5"))


@query
def read_runbooks(t: DriverTables) -> DataFrame:
    read = documents.read_runbooks(t.spark, f"{_page_files(t)}/text", "*.txt")
    return read.select(F.startswith("source", F.lit("part-")).alias("named"), F.md5("text").alias("text_md5"))


@query
def source_names(t: DriverTables) -> DataFrame:
    """Names of uploads: with folders, white space, backslashes, and without any name."""
    number = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("../up/ run book "), number, F.lit(".md ")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("x\\"), number, F.lit("\\notes.txt")))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("folder/"), number, F.lit("//")))
        .otherwise(F.repeat(F.lit("/"), F.col("doc_id").cast("int") % 5))
    )
    return t.table("documents").select("doc_id", source_name(path).alias("source"))


# --- tables at rest --------------------------------------------------------------------------


@query
def stored_index(t: DriverTables) -> DataFrame:
    """An index written, extended by the documents, with one source removed, and read."""
    path = _folder(t, "index-table")
    tables.write_chunks(t.vectors(), path, buckets=4)
    tables.replace_in_table(t.documents(), path, embedding.hashed_words(16))
    tables.delete_from_table(t.spark, path, REPLACED_SOURCE)
    return tables.read_chunks(t.spark, path).select("id", "source", "heading", F.md5("content").alias("content_md5"))


def _saved_reports(t: DriverTables) -> str:
    path = _folder(t, "report-table")
    known, rows = _report_tables(t)
    tables.save_reports(known.withColumn("incident_id", F.col("source_name")), path, buckets=4)
    tables.save_reports(rows, path)
    return path


@query
def stored_reports(t: DriverTables) -> DataFrame:
    return tables.read_reports(t.spark, _saved_reports(t))


@query
def exported_reports(t: DriverTables) -> DataFrame:
    """Reports written as Markdown files and read back."""
    path = _folder(t, "markdown")
    markdown_files.export_markdown(tables.read_reports(t.spark, _saved_reports(t)), path)
    read = t.spark.read.option("pathGlobFilter", "*.md").text(path)
    name = F.regexp_extract("_metadata.file_name", r"\A([0-9]+)\.md\z", 1)
    return read.select(name.cast("long").alias("id"), F.col("value").alias("analysis_markdown"))


@query
def report_times(t: DriverTables) -> DataFrame:
    """Reports that are saved now carry a time in whole seconds, not before the job."""
    masked = stage(events.redact_events(t.events()), "masked")
    started = t.spark.range(1).select(reports.utc_now()).first()[0]
    texts = metrics.incident_metrics(masked).select("incident_id", F.lit("text").alias("analysis_markdown"))
    rows = reports.report_rows(masked, texts, reports.utc_now(), F.concat("incident_id", F.lit(".log")))
    form = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\+00:00\z"
    good = F.rlike("created_at", F.lit(form)) & (F.col("created_at") >= F.lit(started))
    return rows.select("source_name", good.alias("in_form"))


# --- vectors, cases and prompts --------------------------------------------------------------


@query
def vector_texts(t: DriverTables) -> DataFrame:
    """Vectors that went through text, and their similarity to their own reversal."""
    read = t.table("embeddings").select("vec_id", from_json_text(to_json_text(F.col("embedding"))).alias("v"))
    return read.select("vec_id", F.round(cosine(F.col("v"), F.reverse("v")), 6).alias("similarity"))


@query
def available_cases(t: DriverTables) -> DataFrame:
    """The cases that an index can be asked, with the optional one's source among its sources."""
    source = F.when(F.col("source") == "custom/src3", fixed.OPTIONAL_EVALUATION_CASE[2]).otherwise(F.col("source"))
    return evaluation.available_cases(t.spark, t.index().withColumn("source", source))


@query
def qa_prompts(t: DriverTables) -> DataFrame:
    """The whole prompt of the first question about each incident."""
    asked = t.question_vectors()
    first = asked.groupBy("incident_id").agg(F.min("question_id").alias("question_id")).select("question_id")
    sent = stage(asked.join(first, "question_id", "left_semi"), "sent-questions")
    found = retrieval.retrieve(sent, t.vectors())
    built = prompts.qa_prompts(sent.drop("embedding"), t.staged_events(), found, part_bytes=QUERY_PART_BYTES)
    return _bigints(built, "part", "parts")


@query
def review_answers(t: DriverTables) -> DataFrame:
    """All answers completed and audited, the events read once."""
    answers = t.answers()
    asked = answers.select("answer_id", F.floor(F.col("answer_id") / 100).alias("query_id"))
    vectors = t.query_vectors().join(asked.select("query_id"), "query_id", "left_semi")
    matched = retrieval.with_chunks(retrieval.search(vectors, t.vectors(), 1), t.vectors())
    reviewed = analysis.review_answers(answers, t.events(), matched.join(asked, "query_id"))
    return reviewed.select(
        "answer_id",
        "answer",
        *(F.array_join(name, ",").alias(name) for name in ("cited", "invalid", "missing", "unsupported")),
        "citations_passed",
        "claims_passed",
        "note",
    )


def _text_rows(frame: DataFrame, kind: str, text: str) -> DataFrame:
    shown = frame.select(F.lit(kind).alias("kind"), "incident_id", "part", "parts", F.md5(text).alias("text_md5"))
    return _bigints(shown, "part", "parts")


@query
def ordered_texts(t: DriverTables) -> DataFrame:
    """Search texts, log evidence and prompts of all incidents, from events that are sorted once."""
    ordered = ordering.sort_once(t.events(), ["incident_id"], events.EVENT_ORDER)
    search = evidence.incident_queries(ordered, QUERY_PART_BYTES)
    logged = evidence.log_evidence(ordered, QUERY_PART_BYTES)
    built = prompts.analysis_prompts(ordered, _incident_evidence(t), QUERY_PART_BYTES)
    return (
        _text_rows(search, "query", "query")
        .unionByName(_text_rows(logged, "evidence", "evidence"))
        .unionByName(_text_rows(built, "prompt", "prompt"))
    )


@query
def ordered_signatures(t: DriverTables) -> DataFrame:
    ordered = ordering.sort_once(events.redact_events(t.events()), ["incident_id"], events.EVENT_ORDER)
    return reports.signatures(ordered, F.concat("incident_id", F.lit(".log")))


# --- expected results ------------------------------------------------------------------------

_FILE_LINES = """file_lines AS (
  SELECT incident_id, row_number() OVER (PARTITION BY incident_id ORDER BY line_number) AS line_number, raw_line
  FROM lines
)"""
_PAGE_TEXTS = f"""page_texts AS (
  SELECT CASE WHEN page_id % {_EMPTY_PAGE} = 0 THEN ' ' || chr(9) ELSE html END || chr(10) AS text FROM pages
), stripped AS (SELECT trim(text, {_quoted(fixed.WHITESPACE)}) AS text FROM page_texts)"""
_DEMO = ", ".join(f"({n}, {_quoted(name)}, {_quoted(scenario)})" for n, (scenario, name) in enumerate(fixed.DEMO_INCIDENTS.items()))
_CASES = ", ".join(
    f"({_quoted(name)}, {_quoted(asked)}, {_quoted(source)}, {str(answerable).lower()})"
    for name, asked, source, answerable in (*fixed.EVALUATION_CASES, fixed.OPTIONAL_EVALUATION_CASE)
)

_ATTACHED = ORACLES["attach_context"].replace(
    ANSWERS, f"answers AS (SELECT * REPLACE ({_NORMALIZED} AS answer) FROM ({answers_sql()}))"
)
_COMPLETED = f"""completed AS (
  SELECT a.* REPLACE (c.answer AS answer) FROM ({answers_sql()}) a JOIN ({_ATTACHED}) c USING (answer_id)
)"""


def _of_completed(name: str) -> str:
    return ORACLES[name].replace(ANSWERS, "answers AS (SELECT * FROM completed)")


STORED_ORACLES: dict[str, str] = {
    "review_answers": _with(
        _COMPLETED,
        f"""SELECT c.answer_id, c.answer, a.cited, a.invalid, a.missing, b.unsupported, a.citations_passed,
              b.claims_passed, a.note
            FROM completed c JOIN ({_of_completed("citation_audit")}) a USING (answer_id)
            JOIN ({_of_completed("claim_audit")}) b USING (answer_id)""",
    ),
    "read_log_files": _with(LINES, _FILE_LINES, "SELECT * FROM file_lines"),
    "read_uploaded_logs": _with(
        LINES,
        _FILE_LINES,
        "SELECT * FROM file_lines UNION ALL SELECT incident_id, count(*) + 1, '' FROM lines GROUP BY incident_id",
    ),
    "demo_scenarios": _with(
        LINES,
        "SELECT incident_id, line_number, source_name, scenario "
        f"FROM lines JOIN (VALUES {_DEMO}) d(n, source_name, scenario) ON line_number % {len(fixed.DEMO_INCIDENTS) + 1} = n",
    ),
    "strict_events": _with(LINES, "SELECT incident_id, line_number, level, service FROM ev"),
    "all_incident_metrics": ORACLES["incident_metrics"]
    + " UNION ALL SELECT DISTINCT 'silent-' || user_id, 0, 0, 0, 0, 0 FROM events"
    + " UNION ALL SELECT DISTINCT incident_id, 0, 0, 0, 0, 0 FROM lines WHERE incident_id NOT IN (SELECT incident_id FROM ev)",
    "growing_metrics": ORACLES["incident_metrics"]
    + " UNION ALL SELECT DISTINCT incident_id, 0, 0, 0, 0, 0 FROM lines WHERE incident_id NOT IN (SELECT incident_id FROM ev)",
    "ordered_texts": " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, incident_id, part, parts, md5({text}) AS text_md5 FROM ({ORACLES[name]})"
        for kind, text, name in (
            ("query", "query", "incident_query"),
            ("evidence", "evidence", "log_evidence"),
            ("prompt", "prompt", "analysis_prompt"),
        )
    ),
    "ordered_signatures": ORACLES["report_signature"],
    "read_uploads": _with(
        _PAGE_TEXTS,
        "SELECT '.txt' AS suffix, CASE WHEN text <> '' THEN md5(text) END AS text_md5, "
        "CASE WHEN text = '' THEN 'No extractable text was found in the document.' END AS reason FROM stripped "
        "UNION ALL SELECT '.json', NULL, 'Unsupported document type: .json' FROM pages",
    ),
    "accepted_documents": _with(_PAGE_TEXTS, "SELECT md5(text) AS text_md5 FROM stripped WHERE text <> ''"),
    "read_runbooks": _with(_PAGE_TEXTS, "SELECT true AS named, md5(text) AS text_md5 FROM page_texts"),
    "source_names": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'custom/run book ' || doc_id || '.md'
        WHEN 1 THEN 'custom/x_' || doc_id || '_notes.txt' WHEN 2 THEN 'custom/' || doc_id END AS source FROM documents""",
    "stored_index": _with(
        VECTORS,
        _DOCUMENTS,
        _PACKED,
        f"""SELECT id, source, heading, md5(content) AS content_md5 FROM vecs WHERE source <> '{REPLACED_SOURCE}'
            UNION ALL SELECT (SELECT max(id) FROM vecs) + row_number() OVER (ORDER BY source, position),
              source, heading, md5(content) FROM doc_chunks""",
    ),
    "stored_reports": _with(LINES, _MASKED, MERGED, "SELECT * FROM merged"),
    "exported_reports": _with(LINES, _MASKED, MERGED, "SELECT id, analysis_markdown FROM merged"),
    "report_times": _with(LINES, "SELECT DISTINCT incident_id || '.log' AS source_name, true AS in_form FROM ev"),
    "vector_texts": """SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]),
        list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings""",
    "available_cases": _with(
        INDEX,
        f"SELECT * FROM (VALUES {_CASES}) c(name, query, expected_source, answerable) "
        f"WHERE name <> {_quoted(fixed.OPTIONAL_EVALUATION_CASE[0])} OR EXISTS (FROM idx WHERE source = 'custom/src3')",
    ),
    "qa_prompts": _with(
        LINES,
        EVIDENCE,
        f"frames AS ({ORACLES['qa_prompt']})",
        QUESTIONS,
        "sent AS (SELECT incident_id, min(question_id) AS question_id FROM asked a "
        "WHERE EXISTS (FROM embeddings WHERE vec_id = a.conv_id) GROUP BY incident_id)",
        f"""SELECT s.question_id, s.incident_id, {_part_columns("e")}, f.system,
              CASE WHEN coalesce(e.part, 1) = 1 THEN f.head ELSE '' END || coalesce(e.lines, f.without_evidence)
              || CASE WHEN coalesce(e.part = e.parts, true) THEN f.tail ELSE '' END AS prompt
            FROM sent s JOIN frames f USING (question_id) LEFT JOIN evidence_parts e ON e.incident_id = f.evidence_of""",
    ),
}
