"""Expected results of the registered queries as DuckDB SQL over the same Parquet tables.

Expected events come from the facts that went into the raw lines, not from parsing the lines
again, so the parser is tested independently.
"""

from __future__ import annotations

import re

from cinderlog import fixed_values as fixed
from cinderlog.plans.driver_tables import (
    answers_sql,
    events_sql,
    incident_number_sql,
    index_sql,
    questions_sql,
)
from cinderlog.plans.queries import (
    CREATED_NOW,
    EMBEDDED_TERMS,
    QUERY_PART_BYTES,
    REPLACED_SOURCE,
)

SERIOUS = "level IN ('WARNING', 'ERROR', 'CRITICAL')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(column: str, pairs: list[tuple[str, str]], default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {column} = {key} THEN {value}" for key, value in pairs)
    return f"CASE {whens} ELSE {default} END"


def _parts(name: str, relation: str, line: str) -> str:
    """CTEs that join an incident's lines in parts of ``QUERY_PART_BYTES``; the last is ``name``."""
    return f"""
{name}_lines AS (
  SELECT incident_id, ts, line_number, {line} AS line FROM {relation}
),
{name}_filled AS (
  SELECT *, coalesce(sum(octet_length(encode(line)) + 1) OVER (PARTITION BY incident_id
    ORDER BY ts, line_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    // {QUERY_PART_BYTES} AS fill
  FROM {name}_lines
),
{name}_numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY incident_id ORDER BY fill) AS part FROM {name}_filled
),
{name} AS (
  SELECT incident_id, part, max(part) OVER (PARTITION BY incident_id) AS parts,
    CASE WHEN part > 1 THEN chr(10) ELSE '' END || lines AS lines
  FROM (SELECT incident_id, part, string_agg(line, chr(10) ORDER BY ts, line_number) AS lines
        FROM {name}_numbered GROUP BY ALL)
)"""


def _part_columns(alias: str) -> str:
    return (
        f"CAST(coalesce({alias}.part, 1) AS BIGINT) AS part, "
        f"CAST(coalesce({alias}.parts, 1) AS BIGINT) AS parts"
    )


# The fixed redaction patterns; DuckDB's dialect writes a group as ``\\1``.
_REDACTIONS = tuple(
    (pattern.replace("(?U)", "").replace("(?iU)", "(?i)"), re.sub(r"\$(\d)", r"\\\1", replacement))
    for pattern, replacement in fixed.REDACTIONS
)


def _redacted(relation: str, columns: list[str], names: list[str]) -> str:
    """CTE chain ``r0 … r5`` that redacts columns and counts in ``<column>_n``."""
    kept = ", ".join(names)
    parts = [
        "r0 AS (SELECT "
        + ", ".join([kept, *columns, *(f"0 AS {c}_n" for c in columns)])
        + f" FROM {relation})"
    ]
    for step, (pattern, replacement) in enumerate(_REDACTIONS, start=1):
        done = ", ".join(
            f"regexp_replace({c}, {_quoted(pattern)}, {_quoted(replacement)}, 'g') AS {c}, "
            f"{c}_n + len(regexp_extract_all({c}, {_quoted(pattern)})) AS {c}_n"
            for c in columns
        )
        parts.append(f"r{step} AS (SELECT {kept}, {done} FROM r{step - 1})")
    return ", ".join(parts)


LINES = f"""
lines AS ({events_sql("duckdb")}),
ev AS (
  SELECT incident_id, line_number, CAST(ts_text AS TIMESTAMP) AS ts, level, service, message,
         raw_line
  FROM lines WHERE kind IN ('json', 'plain')
),
ser AS (SELECT * FROM ev WHERE {SERIOUS})"""

_MASKED = _redacted(
    "ev", ["message", "raw_line"], ["incident_id", "line_number", "ts", "level", "service"]
)
_LEVEL_RANK = _cases(
    "level", [(f"'{name}'", str(rank)) for rank, name in enumerate(fixed.LEVELS, start=1)]
)
_ISO = (
    "CASE WHEN strftime({0}, '%f') = '000000' THEN strftime({0}, '%Y-%m-%d %H:%M:%S')"
    " ELSE strftime({0}, '%Y-%m-%d %H:%M:%S.%f') END"
)

# --- causes ---

_RULES = " UNION ALL ".join(
    f"SELECT {number} AS rule, {_quoted(label)} AS cause, {_quoted(source)} AS source, "
    f"[{', '.join(_quoted(word) for word in keywords)}] AS keywords"
    for number, (label, source, keywords) in enumerate(fixed.CAUSE_RULES)
)


# A rule for every user beside the fixed ones.
_USER_RULES = f"""{_RULES} UNION ALL
  SELECT DISTINCT {len(fixed.CAUSE_RULES)} + user_id, 'Failed sign-ins of user ' || user_id,
    'authentication_failures.md', ['user-' || user_id || '@mail'] FROM events"""


def causes_cte(events: str, rules: str = _RULES) -> str:
    return f"""
rules AS ({rules}),
rule_hits AS (
  SELECT e.incident_id, e.ts, e.line_number, r.rule
  FROM {events} e JOIN rules r
    ON len(list_filter(r.keywords, lambda w: contains(lower(e.message), w))) > 0
),
rule_counts AS (
  SELECT incident_id, rule, count(*) AS matches FROM rule_hits GROUP BY ALL
),
rule_best AS (
  SELECT incident_id, rule, matches FROM rule_counts
  QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY matches DESC, rule) = 1
),
rule_cited AS (
  SELECT incident_id, rule,
    string_agg('[L' || line_number || ']', ' ' ORDER BY ts, line_number) AS citations
  FROM (SELECT * FROM rule_hits QUALIFY row_number() OVER
          (PARTITION BY incident_id, rule ORDER BY ts, line_number) <= 3)
  GROUP BY ALL
),
caused AS (
  SELECT i.incident_id,
    coalesce(r.cause, {_quoted(fixed.UNKNOWN_CAUSE)}) AS cause, r.source,
    coalesce(b.matches, 0) AS matches,
    coalesce(c.citations, {_quoted(fixed.UNKNOWN_CAUSE_CITATION)}) AS citations,
    CASE WHEN b.matches IS NULL THEN 'Low' WHEN b.matches >= 2 THEN 'High'
         ELSE 'Medium' END AS confidence
  FROM (SELECT DISTINCT incident_id FROM {events}) i
  LEFT JOIN rule_best b USING (incident_id)
  LEFT JOIN rules r ON r.rule = b.rule
  LEFT JOIN rule_cited c ON c.incident_id = b.incident_id AND c.rule = b.rule
)"""


# --- domains ---


def _hits(text: str, domain: str) -> str:
    return " + ".join(
        f"(length({text}) - length(replace({text}, {_quoted(word)}, ''))) // {len(word)}"
        for word in fixed.DOMAIN_KEYWORDS[domain]
    )


_DOMAINS = list(fixed.DOMAIN_KEYWORDS)


def _strongest(prefix: str) -> str:
    best = f"greatest({', '.join(f'{prefix}{n}' for n in range(len(_DOMAINS)))})"
    whens = " ".join(
        f"WHEN {prefix}{n} = {best} THEN {_quoted(name)}" for n, name in enumerate(_DOMAINS)
    )
    return f"CASE WHEN {best} = 0 THEN NULL {whens} END"


INCIDENT_DOMAINS = f"""
texts AS (
  SELECT incident_id,
    lower(string_agg(service || ' ' || message, chr(10) ORDER BY ts, line_number)) AS t
  FROM ser GROUP BY incident_id
),
scored AS (
  SELECT incident_id, {", ".join(f"{_hits('t', d)} AS d{n}" for n, d in enumerate(_DOMAINS))}
  FROM texts
),
incident_domains AS (
  SELECT incident_id, {_strongest("d")} AS incident_domain,
    CAST({" + ".join(f"d{n}" for n in range(len(_DOMAINS)))} AS BIGINT) AS domain_hits
  FROM scored
)"""

_NORMAL = "regexp_replace(trim(lower(question), ' ' || chr(10)), '\\s+', ' ', 'g')"
QUESTIONS = f"""
asked AS ({questions_sql()}),
asked_scored AS (
  SELECT question_id, incident_id, question, conv_id,
    NOT ({" OR ".join(f"regexp_matches({_NORMAL}, {_quoted(p)})" for p in fixed.DEFINITION_QUESTIONS)})
      AS needs_logs,
    {", ".join(f"{_hits('lower(question)', d)} AS d{n}" for n, d in enumerate(_DOMAINS))}
  FROM asked
),
scoped AS (
  SELECT question_id, incident_id, question, conv_id, needs_logs,
    CASE WHEN needs_logs THEN {_strongest("d")} END AS question_domain
  FROM asked_scored
)"""

ALIGNED = f"""{QUESTIONS},
aligned AS (
  SELECT s.question_id, s.incident_id, s.needs_logs, s.question_domain,
    CASE WHEN s.needs_logs THEN d.incident_domain END AS incident_domain,
    NOT s.needs_logs OR s.question_domain IS NULL OR d.incident_domain IS NULL
      OR s.question_domain = d.incident_domain AS aligned
  FROM scoped s LEFT JOIN incident_domains d USING (incident_id)
)"""

# --- documents ---

_DOCUMENTS = """
docs AS (
  SELECT 'doc-' || doc_id AS source, doc_id,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
      CASE WHEN i % 5 = 0 THEN '# Step ' || (length(x) % 3) || chr(10) || x ELSE x END),
      chr(10) || chr(10)) AS text
  FROM documents
),
doc_lines AS (
  SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line,
    generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM docs
),
marked AS (
  SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END)
    OVER (PARTITION BY source ORDER BY pos) AS part
  FROM doc_lines
),
raw_sections AS (
  SELECT source, doc_id, part,
    coalesce(max(CASE WHEN starts_with(line, '#') THEN trim(ltrim(line, '#')) END), 'Overview')
      AS heading,
    regexp_replace(coalesce(string_agg(CASE WHEN NOT starts_with(line, '#') THEN line END,
      chr(10) ORDER BY pos), ''), '^\\s+|\\s+$', '', 'g') AS content
  FROM marked GROUP BY ALL
),
sections AS (
  SELECT source, doc_id, heading, content,
    row_number() OVER (PARTITION BY source ORDER BY part) AS section
  FROM raw_sections WHERE content <> ''
)"""

_LIMIT = fixed.CHUNK_CHARACTERS
_PACKED = f"""
paragraphs AS (
  SELECT source, section, heading,
    list_filter(list_transform(string_split(content, chr(10) || chr(10)),
      lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps
  FROM sections
),
folded AS (
  SELECT source, section, heading, list_reduce(list_prepend('', ps), lambda a, p:
    CASE
      WHEN length(p) > {_LIMIT} THEN
        a || CASE WHEN a = '' OR ends_with(a, chr(1)) THEN '' ELSE chr(1) END
          || array_to_string(list_transform(range(0, (length(p) + {_LIMIT - 1}) // {_LIMIT}),
               lambda i: substring(p, i * {_LIMIT} + 1, {_LIMIT})), chr(1)) || chr(1)
      WHEN a = '' OR ends_with(a, chr(1)) THEN a || p
      WHEN length(string_split(a, chr(1))[-1]) + 2 + length(p) > {_LIMIT} THEN a || chr(1) || p
      ELSE a || chr(10) || chr(10) || p
    END) AS joined
  FROM paragraphs
),
pieces AS (
  SELECT source, section, heading, list_filter(string_split(joined, chr(1)), lambda c: c <> '') AS cs
  FROM folded
),
labelled AS (
  SELECT source, section, unnest(cs) AS content, generate_subscripts(cs, 1) AS part,
    CASE WHEN len(cs) = 1 THEN heading
         ELSE heading || ' (part ' || generate_subscripts(cs, 1) || ')' END AS label
  FROM pieces
),
numbered_chunks AS (
  SELECT source, section, part, label, content,
    row_number() OVER (PARTITION BY source ORDER BY section, part) AS position
  FROM labelled
),
doc_chunks AS (
  SELECT source, position, content,
    label || CASE WHEN row_number() OVER (PARTITION BY source, label ORDER BY position) = 1
      THEN '' ELSE ' (' || row_number() OVER (PARTITION BY source, label ORDER BY position) || ')'
      END AS heading
  FROM numbered_chunks
)"""

INDEX = f"idx AS ({index_sql()})"

# --- vectors ---

VECTORS = """
vecs AS (
  SELECT CAST(vec_id + 1 AS BIGINT) AS id, 'label-' || label AS source,
    'Section ' || vec_id AS heading, 'Guidance for case ' || vec_id AS content,
    CAST(embedding AS DOUBLE[]) AS v
  FROM embeddings
),
qs AS (
  SELECT CAST(vec_id AS BIGINT) AS query_id, label,
    list_transform(list_zip(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))),
      lambda p: p[1] * ((vec_id % 5) / 4.0::DOUBLE) + p[2]) AS q
  FROM embeddings
),
pairs AS (
  SELECT query_id, id, list_cosine_similarity(q, v) AS score FROM qs, vecs
),
ranked AS (
  SELECT query_id, id, score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
  FROM pairs
),
top3 AS (
  SELECT r.query_id, r.rank, r.id, r.score, v.source, v.heading, v.content
  FROM ranked r JOIN vecs v USING (id) WHERE r.rank <= 3
)"""

GATED = f"""
gated AS (
  SELECT s.question_id, CASE WHEN trim(s.question) = '' THEN 0 ELSE t.score END AS best_score,
    trim(s.question) <> '' AND t.score >= {fixed.RELEVANCE_THRESHOLD} AS accepted
  FROM asked s JOIN top3 t ON t.query_id = s.conv_id AND t.rank = 1
)"""

EVALUATED = f"""
judged AS (
  SELECT q.query_id AS case_id, 'case-' || q.query_id AS name, 'label-' || q.label AS expected_source,
    q.query_id % 4 <> 0 AS answerable, CAST(q.query_id % 9 AS DOUBLE) / 4 AS latency_seconds,
    t.source, t.heading, t.score,
    t.score >= {fixed.RELEVANCE_THRESHOLD} AS accepted
  FROM qs q JOIN top3 t USING (query_id) WHERE t.rank = 1
),
evaluated AS (
  SELECT case_id, name, expected_source, answerable, latency_seconds,
    CASE WHEN accepted THEN source ELSE 'REJECT' END AS retrieved_source,
    heading AS retrieved_heading, round(score, 6) AS score, accepted,
    CASE WHEN answerable THEN accepted AND source = expected_source ELSE NOT accepted END AS passed
  FROM judged
)"""

# --- evidence and prompts ---

EVIDENCE = _parts(
    "evidence_parts",
    "ser",
    f"'[L' || line_number || '] ' || {_ISO.format('ts')} || ' ' || level || ' ' || service || ': ' "
    "|| message",
)
RUNBOOKS = """
runbooks AS (
  SELECT query_id, string_agg('[R' || rank || '] Source: ' || source || ', section: ' || heading
    || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS runbook_evidence,
    count(*) AS chunks
  FROM top3 GROUP BY query_id
)"""

# --- answers ---

ANSWERS = f"answers AS ({answers_sql()})"
_NORMALIZED = "regexp_replace(answer, '(?i)\\(\\s*([LR]\\d+)\\s*\\)', '[\\1]', 'g')"
CITED = f"""{ANSWERS},
normal AS (SELECT * REPLACE ({_NORMALIZED} AS answer) FROM answers),
label_lists AS (
  SELECT answer_id, incident_id, include_logs, chunk_count,
    regexp_extract_all(answer, '\\[(?:[LR]?\\d+)\\]') AS ls
  FROM normal
),
labels_flat AS (
  SELECT answer_id, incident_id, include_logs, chunk_count, label, min(pos) AS pos
  FROM (SELECT *, unnest(ls) AS label, generate_subscripts(ls, 1) AS pos FROM label_lists)
  GROUP BY answer_id, incident_id, include_logs, chunk_count, label
),
labels_checked AS (
  SELECT l.*, (l.include_logs AND s.line_number IS NOT NULL)
      OR list_contains(list_transform(range(1, l.chunk_count + 1), lambda i: '[R' || i || ']'),
                       l.label) AS valid
  FROM labels_flat l LEFT JOIN ser s
    ON s.incident_id = l.incident_id AND l.label = '[L' || s.line_number || ']'
),
label_sums AS (
  SELECT answer_id, string_agg(label, ',' ORDER BY pos) AS cited,
    string_agg(CASE WHEN NOT valid THEN label END, ',' ORDER BY pos) AS invalid,
    bool_or(starts_with(label, '[L')) AS has_l, bool_or(starts_with(label, '[R')) AS has_r
  FROM labels_checked GROUP BY answer_id
),
audited AS (
  SELECT a.answer_id, coalesce(s.cited, '') AS cited, coalesce(s.invalid, '') AS invalid,
    concat_ws(',', CASE WHEN a.include_logs AND NOT coalesce(s.has_l, false) THEN '[L#]' END,
      CASE WHEN a.chunk_count > 0 AND NOT coalesce(s.has_r, false) THEN '[R#]' END) AS missing
  FROM answers a LEFT JOIN label_sums s USING (answer_id)
)"""

_CODES = "list_filter(string_split_regex({0}, '\\D+'), lambda x: length(x) = 3 AND x[1] BETWEEN '1' AND '5')"
STATUSES = f"""
statuses AS (
  SELECT DISTINCT incident_id, status FROM
    (SELECT incident_id, unnest({_CODES.format("message")}) AS status FROM ev)
)"""
CLAIMS = f"""{ANSWERS}, {STATUSES},
answer_lines AS (
  SELECT answer_id, incident_id, include_logs, unnest(string_split(answer, chr(10))) AS line,
    generate_subscripts(string_split(answer, chr(10)), 1) AS pos
  FROM answers
),
headed AS (
  SELECT *, min(CASE WHEN regexp_matches(line,
      '(?i)^\\s*(?:#{{1,6}}\\s*)?\\*{{0,2}}evidence\\*{{0,2}}\\s*$') THEN pos END)
    OVER (PARTITION BY answer_id) AS heading
  FROM answer_lines
),
claimed AS (
  SELECT DISTINCT answer_id, incident_id, include_logs, unnest({_CODES.format("line")}) AS status
  FROM headed
  WHERE heading IS NULL OR pos < heading OR regexp_matches(line, '^\\s*\\[L\\d+\\]')
),
unbacked AS (
  SELECT c.answer_id, string_agg(c.status, ',' ORDER BY c.status) AS unsupported
  FROM claimed c
  WHERE NOT EXISTS (SELECT 1 FROM statuses s WHERE c.include_logs
                    AND s.incident_id = c.incident_id AND s.status = c.status)
  GROUP BY c.answer_id
)"""

# --- reports ---

FIRST_SEEN = """
seen AS (
  SELECT incident_id, service, ts, line_number, message FROM ser
  QUALIFY row_number() OVER (PARTITION BY incident_id, service ORDER BY ts, line_number) = 1
)"""
ACTIONS = """
chosen AS (
  SELECT *, bool_or(lower(heading) IN ('immediate response', 'prevention'))
      OVER (PARTITION BY source) AS has_actions,
    row_number() OVER (PARTITION BY source ORDER BY id) AS place
  FROM idx
),
placed AS (
  SELECT source, heading, content, row_number() OVER (PARTITION BY source ORDER BY id) AS rank
  FROM chosen
  WHERE lower(heading) IN ('immediate response', 'prevention') OR (NOT has_actions AND place <= 2)
),
actions AS (
  SELECT source, string_agg('- **' || heading || ':** ' || content || ' [R' || rank || ']',
    chr(10) ORDER BY rank) AS actions
  FROM placed GROUP BY source
)"""


def _filled(template: str, *values: str) -> str:
    """SQL concatenation of a ``%s`` template with SQL expressions."""
    pieces = [_quoted(piece) for piece in template.split("%s")]
    joined = [pieces[0]]
    for value, piece in zip(values, pieces[1:]):
        joined += [value, piece]
    return " || ".join(joined)


_SEEN_LINE = (
    "'- **' || strftime(ts, '%H:%M:%S') || ' — ' || service || ':** ' || message "
    "|| ' [L' || line_number || ']'"
)
_PROPAGATION = _parts("propagation", "seen", _SEEN_LINE)
_REPORT = f"""
SELECT c.incident_id, {_part_columns("p")},
  CASE WHEN coalesce(p.part, 1) = 1 THEN
    {_filled(fixed.REPORT_HEAD, _quoted(fixed.ASSISTANT_NAME), "c.cause", "c.citations",
             "c.cause", "c.citations")} ELSE '' END
  || coalesce(p.lines, '')
  || CASE WHEN coalesce(p.part = p.parts, true) THEN
    {_quoted(fixed.REPORT_ACTIONS)} || coalesce(a.actions, {_quoted(fixed.REPORT_NO_ACTIONS)})
    || {_filled(fixed.REPORT_TAIL, "c.confidence")} ELSE '' END AS analysis_markdown
FROM caused c LEFT JOIN propagation p USING (incident_id) LEFT JOIN actions a USING (source)"""

SIGNED = """
masked AS (SELECT * FROM r5),
line_blocks AS (
  SELECT incident_id, place // 1000 AS block,
    sha256(string_agg(raw_line, chr(10) ORDER BY place)) AS digest
  FROM (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY ts, line_number) - 1 AS place
        FROM masked)
  GROUP BY ALL
),
digest_blocks AS (
  SELECT incident_id, block // 1000 AS block,
    sha256(string_agg(digest, chr(10) ORDER BY block)) AS digest
  FROM line_blocks GROUP BY incident_id, block // 1000
),
signed AS (
  SELECT incident_id, incident_id || '.log' AS source_name,
    sha256(incident_id || '.log' || chr(10) || string_agg(digest, chr(10) ORDER BY block)) AS signature
  FROM digest_blocks GROUP BY incident_id
)"""
MERGED = f"""{SIGNED}, {causes_cte("masked")},
facts AS (
  SELECT s.signature, s.source_name, w.event_count, w.started_at, w.ended_at, c.cause,
    w.critical * 4 > w.errors AS known
  FROM signed s JOIN caused c USING (incident_id) JOIN (
    SELECT incident_id, count(*) AS event_count, {_ISO.format("min(ts)")} AS started_at,
      {_ISO.format("max(ts)")} AS ended_at,
      count(*) FILTER (level = 'CRITICAL') AS critical, count(*) FILTER (level = 'ERROR') AS errors
    FROM masked GROUP BY incident_id) w USING (incident_id)
),
merged AS (
  SELECT CAST(row_number() OVER (ORDER BY known DESC, source_name) AS BIGINT) AS id,
    signature, CAST(1 AS INTEGER) AS part, source_name, {_quoted(CREATED_NOW)} AS created_at, event_count, started_at, ended_at,
    cause AS analysis_markdown
  FROM facts
)"""

_AUDIT_NOTE = f"""
CASE WHEN cited <> '' AND invalid = '' AND missing = ''
  THEN {_quoted(fixed.CITATION_PASSED)} || replace(cited, ',', ', ')
  ELSE {_quoted(fixed.CITATION_REVIEW)} || concat_ws('; ',
    CASE WHEN invalid <> '' THEN {_quoted(fixed.CITATION_INVALID)} || replace(invalid, ',', ', ') END,
    CASE WHEN missing <> '' THEN {_quoted(fixed.CITATION_MISSING)} || replace(missing, ',', ', ') END,
    CASE WHEN cited = '' THEN {_quoted(fixed.CITATION_NONE)} END) || '.' END"""

_TOTALS = """
svc AS (
  SELECT incident_id, count(*) FILTER (level IN ('WARNING', 'ERROR', 'CRITICAL')) AS serious,
    count(DISTINCT CASE WHEN level IN ('WARNING', 'ERROR', 'CRITICAL') THEN service END) AS affected,
    sum(CASE level WHEN 'WARNING' THEN 3 WHEN 'ERROR' THEN 8 WHEN 'CRITICAL' THEN 18 ELSE 0 END)
      AS severity
  FROM ev GROUP BY incident_id
),
points AS (
  SELECT incident_id, serious, affected, severity, greatest(affected - 1, 0) * 6 AS spread,
    least(severity + greatest(affected - 1, 0) * 6, 100) AS score
  FROM svc
)"""


def _with(*parts: str) -> str:
    """``WITH`` clause of all but the last part, followed by the last."""
    return "WITH " + ",".join(parts[:-1]) + " " + parts[-1]


def _redacted_table(table: str, key: str, column: str) -> str:
    return _with(
        _redacted(table, [column], [key]),
        f"SELECT {key}, md5({column}) AS {column}_md5, CAST({column}_n AS BIGINT) AS redactions FROM r5",
    )


ORACLES: dict[str, str] = {
    "parse_events": _with(
        LINES,
        "SELECT incident_id, line_number, ts, level, service, message, raw_line FROM ev",
    ),
    "rejected_lines": _with(
        LINES,
        "SELECT incident_id, line_number, raw_line FROM lines "
        "WHERE kind IN ('junk', 'bad_time', 'bad_json')",
    ),
    "rejected_counts": _with(
        LINES,
        "SELECT incident_id, count(*) FILTER (kind IN ('junk', 'bad_time', 'bad_json')) AS rejected "
        "FROM lines WHERE kind <> 'blank' GROUP BY incident_id",
    ),
    "redact_events": _with(
        LINES,
        _MASKED,
        "SELECT incident_id, line_number, message, raw_line, "
        "CAST(greatest(message_n, raw_line_n) AS BIGINT) AS redactions FROM r5",
    ),
    "redaction_totals": _with(
        LINES,
        _MASKED,
        "SELECT incident_id, CAST(sum(greatest(message_n, raw_line_n)) AS BIGINT) AS redactions "
        "FROM r5 GROUP BY incident_id",
    ),
    "redact_documents": _redacted_table("documents", "doc_id", "text"),
    "redact_pages": _redacted_table("pages", "page_id", "html"),
    "event_order": _with(
        LINES, "SELECT incident_id, line_number, ts FROM ev ORDER BY incident_id, ts, line_number"
    ),
    "incident_metrics": _with(
        LINES,
        "SELECT incident_id, count(*) AS events, count(*) FILTER (level = 'ERROR') AS errors, "
        "count(*) FILTER (level = 'CRITICAL') AS critical, count(DISTINCT service) AS services, "
        "CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS duration_seconds "
        "FROM ev GROUP BY incident_id",
    ),
    "impact_score": _with(
        LINES,
        _TOTALS,
        """SELECT incident_id, CAST(score AS BIGINT) AS score,
             CASE WHEN score >= 70 THEN 'Severe' WHEN score >= 45 THEN 'High'
                  WHEN score >= 20 THEN 'Moderate' ELSE 'Low' END AS label,
             serious || ' serious events across ' || affected || ' services; severity points '
               || severity || ', propagation points ' || spread || '.' AS explanation,
             CAST(serious AS BIGINT) AS serious, CAST(affected AS BIGINT) AS affected_services,
             CAST(severity AS BIGINT) AS severity_points, CAST(spread AS BIGINT) AS spread_points
           FROM points""",
    ),
    "level_counts": _with(
        LINES,
        f"SELECT incident_id, level, count(*) AS events, CAST({_LEVEL_RANK} AS BIGINT) AS severity "
        "FROM ev GROUP BY ALL",
    ),
    "levels_present": _with(
        LINES,
        f"SELECT DISTINCT incident_id, level, CAST({_LEVEL_RANK} AS BIGINT) AS severity FROM ev",
    ),
    "service_counts": _with(
        LINES, "SELECT incident_id, service, count(*) AS events FROM ev GROUP BY ALL"
    ),
    "event_frame": _with(
        LINES,
        'SELECT incident_id, ts AS "Time", level AS "Level", service AS "Service", '
        'message AS "Message", line_number AS "Line" FROM ev',
    ),
    "timeline": _with(
        LINES,
        "SELECT incident_id, rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') AS \"Time\", "
        'level AS "Level", service AS "Service", message AS "Message", line_number AS "Line" '
        "FROM ev WHERE level IN ('INFO', 'ERROR', 'CRITICAL')",
    ),
    "verified_evidence": _with(
        LINES,
        "SELECT incident_id, 'L' || line_number AS \"Evidence\", "
        "strftime(ts, '%Y-%m-%d %H:%M:%S') AS \"Time\", "
        'level AS "Level", service AS "Service", message AS "Message" FROM ser',
    ),
    "failure_chain": _with(
        LINES,
        "SELECT incident_id, row_number() OVER w AS step, strftime(ts, '%H:%M:%S') AS time, service, "
        "level, message, line_number, "
        "CASE WHEN lead(1) OVER w IS NULL THEN 'END' ELSE '->' END AS marker "
        "FROM ser WINDOW w AS (PARTITION BY incident_id ORDER BY ts, line_number)",
    ),
    "first_seen_by_service": _with(LINES, FIRST_SEEN, "SELECT * FROM seen"),
    "first_serious_event": _with(
        LINES,
        "SELECT incident_id, line_number, service FROM ser QUALIFY row_number() OVER "
        "(PARTITION BY incident_id ORDER BY ts, line_number) = 1",
    ),
    "event_window": _with(
        LINES,
        f"SELECT incident_id, count(*) AS event_count, {_ISO.format('min(ts)')} AS started_at, "
        f"{_ISO.format('max(ts)')} AS ended_at FROM ev GROUP BY incident_id",
    ),
    "cause_matches": _with(
        LINES,
        causes_cte("ev"),
        "SELECT incident_id, line_number, CAST(rule AS BIGINT) AS rule FROM rule_hits",
    ),
    "detect_cause": _with(LINES, causes_cte("ev"), "SELECT * FROM caused"),
    "cause_matches_by_table": _with(
        LINES,
        causes_cte("ev", _USER_RULES),
        "SELECT incident_id, line_number, CAST(rule AS BIGINT) AS rule FROM rule_hits",
    ),
    "detect_cause_by_table": _with(LINES, causes_cte("ev", _USER_RULES), "SELECT * FROM caused"),
    "detect_domain_by_table": _with(LINES, INCIDENT_DOMAINS, "SELECT * FROM incident_domains"),
    "detect_domain": _with(LINES, INCIDENT_DOMAINS, "SELECT * FROM incident_domains"),
    "question_scope": _with(
        QUESTIONS, "SELECT question_id, needs_logs, question_domain FROM scoped"
    ),
    "alignment": _with(
        LINES, INCIDENT_DOMAINS, ALIGNED, "SELECT * EXCLUDE (incident_id) FROM aligned"
    ),
    "split_sections": _with(
        _DOCUMENTS, "SELECT source, section, heading, md5(content) AS content_md5 FROM sections"
    ),
    "chunk_documents": _with(
        _DOCUMENTS,
        _PACKED,
        "SELECT source, position, heading, length(content) AS characters, "
        "md5(content) AS content_md5 FROM doc_chunks",
    ),
    "chunk_document_lines": _with(
        _DOCUMENTS,
        _PACKED,
        "SELECT source, position, heading, length(content) AS characters, "
        "md5(content) AS content_md5 FROM doc_chunks",
    ),
    "build_index": _with(
        _DOCUMENTS,
        _PACKED,
        "SELECT row_number() OVER (ORDER BY source, position) AS id, source, heading, "
        "CAST(256 AS INTEGER) AS dimensions FROM doc_chunks",
    ),
    "build_index_values": _with(
        _DOCUMENTS,
        _PACKED,
        "SELECT row_number() OVER (ORDER BY source, position) AS id, source, heading, "
        + " || ',' || ".join(
            f"CAST((length(t) - length(replace(t, {_quoted(term)}, ''))) // {len(term)} AS STRING)"
            for term in EMBEDDED_TERMS
        )
        + " AS embedding FROM (SELECT *, heading || chr(10) || content AS t FROM doc_chunks)",
    ),
    "reused_vectors": _with(
        _DOCUMENTS,
        _PACKED,
        "known AS (SELECT DISTINCT heading || chr(10) || content AS t FROM doc_chunks WHERE position % 2 = 0)",
        "SELECT source, position, heading, CASE WHEN t IN (FROM known) THEN '"
        + ",".join("-1" for _ in EMBEDDED_TERMS)
        + "' ELSE "
        + " || ',' || ".join(
            f"CAST((length(t) - length(replace(t, {_quoted(term)}, ''))) // {len(term)} AS STRING)"
            for term in EMBEDDED_TERMS
        )
        + " END AS embedding FROM (SELECT *, heading || chr(10) || content AS t FROM doc_chunks)",
    ),
    "chunk_count": _with(INDEX, "SELECT count(*) AS chunk_count FROM idx"),
    "chunk_sources": _with(
        INDEX,
        "SELECT source, count(*) AS chunk_count, CASE WHEN starts_with(source, 'custom/') "
        "THEN 'Custom' ELSE 'Built-in' END AS kind FROM idx GROUP BY source ORDER BY source",
    ),
    "source_chunks": _with(
        VECTORS,
        "SELECT id, source, heading, content, CAST(1 AS DOUBLE) AS score FROM vecs "
        f"WHERE source = '{REPLACED_SOURCE}' ORDER BY id",
    ),
    "duplicate_keys": _with(
        INDEX,
        "SELECT source, heading, count(*) AS chunks FROM idx GROUP BY ALL HAVING count(*) > 1",
    ),
    "replace_source": _with(
        VECTORS,
        f"""SELECT id, source, heading, content FROM vecs WHERE source <> '{REPLACED_SOURCE}'
            UNION ALL SELECT id + 1000000, source, 'New ' || lower(heading), content FROM vecs
            WHERE source = '{REPLACED_SOURCE}'""",
    ),
    "delete_source": _with(
        VECTORS,
        f"SELECT id, source, heading, content FROM vecs WHERE source <> '{REPLACED_SOURCE}'",
    ),
    "removed_chunks": _with(
        VECTORS,
        f"SELECT source, count(*) AS chunk_count FROM vecs WHERE source = '{REPLACED_SOURCE}' "
        "GROUP BY source",
    ),
    "top_k": _with(VECTORS, "SELECT query_id, rank, id, round(score, 6) AS score FROM top3"),
    "top_k_clustered": _with(
        VECTORS, "SELECT query_id, rank, id, round(score, 6) AS score FROM top3"
    ),
    "top_k_in_blocks": _with(
        VECTORS, "SELECT query_id, rank, id, round(score, 6) AS score FROM top3"
    ),
    "matched_chunks": _with(
        VECTORS, "SELECT query_id, 'R' || rank AS label, source, heading, content FROM top3"
    ),
    "relevance_gate": _with(
        VECTORS,
        QUESTIONS,
        GATED,
        f"SELECT question_id, round(best_score, 6) AS best_score, "
        f"CAST({fixed.RELEVANCE_THRESHOLD} AS DOUBLE) AS threshold, accepted FROM gated",
    ),
    "answer_status": _with(
        LINES,
        INCIDENT_DOMAINS,
        ALIGNED,
        VECTORS,
        GATED,
        f"""SELECT question_id,
              CASE WHEN NOT aligned THEN 'mismatch' WHEN NOT accepted THEN 'rejected'
                   ELSE 'answer' END AS status,
              CASE WHEN NOT aligned THEN {_filled(fixed.MISMATCH_ANSWER, "question_domain",
                                                  "incident_domain")}
                   WHEN NOT accepted THEN {_quoted(fixed.REJECTED_ANSWER)} END AS reply
            FROM aligned JOIN gated USING (question_id)""",
    ),
    "evaluate_retrieval": _with(VECTORS, EVALUATED, "SELECT * FROM evaluated"),
    "evaluation_summary": _with(
        VECTORS,
        EVALUATED,
        "SELECT count(*) FILTER (passed) AS passed, count(*) AS cases, "
        "round(count(*) FILTER (passed) / count(*) * 100, 6) AS accuracy_percent, "
        "avg(latency_seconds) AS mean_latency_seconds FROM evaluated",
    ),
    "evaluation_table": _with(
        VECTORS,
        EVALUATED,
        "SELECT CASE WHEN passed THEN 'PASS' ELSE 'FAIL' END AS \"Result\", name AS \"Case\", "
        "CASE WHEN answerable THEN 'Answer' ELSE 'Reject' END AS \"Expected behavior\", "
        'expected_source AS "Expected", retrieved_source AS "Retrieved", '
        'retrieved_heading AS "Section", CAST(round(CAST(score AS DECIMAL(18, 6)), 3) AS DOUBLE) AS "Similarity", '
        'round(latency_seconds, 2) AS "Latency (sec)" FROM evaluated',
    ),
    "optional_cases": _with(
        VECTORS,
        INDEX,
        "SELECT 'case-' || query_id AS name, 'label-' || label AS expected_source FROM qs "
        "WHERE 'label-' || label IN (SELECT regexp_replace(source, '^custom/src', 'label-') FROM idx)",
    ),
    "incident_query": _with(
        LINES,
        _parts("searched", "ser", "service || ': ' || message"),
        f"SELECT s.incident_id, {_part_columns('s')}, lines AS query FROM searched s",
    ),
    "log_evidence": _with(
        LINES,
        EVIDENCE,
        f"SELECT e.incident_id, {_part_columns('e')}, lines AS evidence FROM evidence_parts e",
    ),
    "runbook_evidence": _with(VECTORS, RUNBOOKS, "SELECT * FROM runbooks"),
    "analysis_prompt": _with(
        LINES,
        EVIDENCE,
        VECTORS,
        RUNBOOKS,
        f"""SELECT i.incident_id, {_part_columns("e")},
              {_quoted(fixed.ANALYSIS_SYSTEM_PROMPT)} AS system,
              CASE WHEN coalesce(e.part, 1) = 1 THEN {_quoted(fixed.ANALYSIS_PROMPT_HEAD)}
                ELSE '' END || coalesce(e.lines, '')
              || CASE WHEN coalesce(e.part = e.parts, true) THEN
                {_quoted(fixed.ANALYSIS_PROMPT_MIDDLE)} || coalesce(r.runbook_evidence, '')
                || {_quoted(fixed.ANALYSIS_PROMPT_TAIL)} ELSE '' END AS prompt
            FROM (SELECT DISTINCT incident_id FROM ev) i
            LEFT JOIN evidence_parts e USING (incident_id)
            CROSS JOIN ({incident_number_sql()}) n
            LEFT JOIN runbooks r ON i.incident_id = CASE WHEN r.query_id = n.incidents
              THEN 'incident-hot' WHEN r.query_id < n.incidents THEN 'incident-' || r.query_id END""",
    ),
    "qa_prompt": _with(
        VECTORS,
        RUNBOOKS,
        QUESTIONS,
        f"""SELECT s.question_id, {_quoted(fixed.QA_SYSTEM_PROMPT % fixed.ASSISTANT_NAME)} AS system,
              {_quoted(fixed.QA_PROMPT_QUESTION)}
              || regexp_replace(s.question, '^\\s+|\\s+$', '', 'g')
              || {_quoted(fixed.QA_PROMPT_SCOPE)}
              || CASE WHEN s.needs_logs THEN {_quoted(fixed.QA_INCIDENT_SCOPE)}
                      ELSE {_quoted(fixed.QA_DEFINITION_SCOPE)} END
              || {_quoted(fixed.QA_PROMPT_LOGS)} AS head,
              CASE WHEN s.needs_logs THEN s.incident_id END AS evidence_of,
              CASE WHEN s.needs_logs THEN {_quoted(fixed.QA_NO_SERIOUS_EVENTS)}
                   ELSE {_quoted(fixed.QA_NO_LOGS)} END AS without_evidence,
              {_quoted(fixed.QA_PROMPT_RUNBOOKS)}
              || CASE WHEN trim(s.question) = '' THEN '' ELSE coalesce(r.runbook_evidence, '') END
              || {_quoted(fixed.QA_PROMPT_TAIL)} AS tail
            FROM scoped s LEFT JOIN runbooks r ON r.query_id = s.conv_id""",
    ),
    "normalize_citations": _with(ANSWERS, f"SELECT answer_id, {_NORMALIZED} AS answer FROM answers"),
    "attach_context": _with(
        LINES,
        VECTORS,
        ANSWERS,
        f"""first_ser AS (
              SELECT incident_id, {_filled("Active log context: [L%s] %s", "line_number", "service")}
                AS log_line
              FROM ser QUALIFY row_number() OVER
                (PARTITION BY incident_id ORDER BY ts, line_number) = 1),
            additions AS (
              SELECT a.answer_id, a.answer, concat_ws({_quoted(fixed.SOURCE_CONTEXT_JOIN)},
                CASE WHEN NOT regexp_matches(a.answer, '\\[R\\d+\\]')
                  THEN {_filled(fixed.RUNBOOK_CONTEXT, "t.source", "t.heading")} END,
                CASE WHEN a.include_logs AND NOT regexp_matches(a.answer, '\\[L\\d+\\]')
                  THEN f.log_line END) AS added
              FROM answers a
              LEFT JOIN top3 t ON t.query_id = a.answer_id // 100 AND t.rank = 1
              LEFT JOIN first_ser f USING (incident_id))""",
        f"""SELECT answer_id, CASE WHEN added = '' THEN answer
              ELSE regexp_replace(answer, '\\s+$', '') || {_quoted(fixed.SOURCE_CONTEXT_HEAD)} || added
              END AS answer FROM additions""",
    ),
    "citation_audit": _with(
        LINES,
        CITED,
        f"""SELECT answer_id, cited, invalid, missing,
              cited <> '' AND invalid = '' AND missing = '' AS citations_passed, {_AUDIT_NOTE} AS note
            FROM audited""",
    ),
    "incident_statuses": _with(LINES, STATUSES, "SELECT * FROM statuses"),
    "claim_audit": _with(
        LINES,
        CLAIMS,
        """SELECT a.answer_id, coalesce(u.unsupported, '') AS unsupported,
             u.unsupported IS NULL AS claims_passed
           FROM answers a LEFT JOIN unbacked u USING (answer_id)""",
    ),
    "action_texts": _with(INDEX, ACTIONS, "SELECT source, md5(actions) AS actions_md5 FROM actions"),
    "quick_report": _with(
        LINES, causes_cte("ev"), FIRST_SEEN, INDEX, ACTIONS, _PROPAGATION, _REPORT
    ),
    "report_signature": _with(LINES, _MASKED, SIGNED, "SELECT * FROM signed"),
    "upsert_reports": _with(LINES, _MASKED, MERGED, "SELECT * FROM merged"),
    "upsert_repeated_reports": _with(
        LINES,
        _MASKED,
        MERGED,
        """SELECT * REPLACE (CASE WHEN ends_with(source_name, '1.log') THEN 'copy of ' ELSE '' END
             || analysis_markdown AS analysis_markdown) FROM merged""",
    ),
    "recent_reports": _with(
        LINES,
        _MASKED,
        MERGED,
        "SELECT * EXCLUDE (signature) FROM merged ORDER BY created_at DESC, id DESC LIMIT 10",
    ),
}
