"""Fixed values of the incident-analysis rules.

Everything in this module is a value that has to be exactly this for results to be right:
word lists, patterns, weights, thresholds and text templates.  No logic lives here.
"""

from __future__ import annotations

# --- characters ------------------------------------------------------------------------------

# Characters that count as whitespace when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a (Java) regex class; needs the (?U) flag.
WHITESPACE_CLASS = r"[\s\x1C-\x1F]"
# Every line boundary of a decoded text (not of a text *file*, which only knows \n, \r, \r\n).
LINE_BOUNDARY = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"

# --- log lines -------------------------------------------------------------------------------

# timestamp, level, service, message of a plain log line (groups 1-4).
LOG_LINE = (
    r"(?idU)^[\s\x1C-\x1F]*"
    r"(\d{4}-\d{2}-\d{2}[T ][0-2]\d:[0-5]\d:[0-5]\d(?:[.,]\d{1,6})?Z?)"
    r"[\s\x1C-\x1F]+\[?(TRACE|DEBUG|INFO|WARN|WARNING|ERROR|CRITICAL|FATAL)\]?"
    r"[\s\x1C-\x1F]+\[?([A-Za-z0-9_.-]+)\]?"
    # The message runs to the last character that is not whitespace, if there is one.
    r"[\s\x1C-\x1F]*[-:]?[\s\x1C-\x1F]*(.*[^\s\x1C-\x1F]|.)[\s\x1C-\x1F]*$"
)

LEVELS = ("TRACE", "DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
LEVEL_ALIASES = {"WARN": "WARNING", "FATAL": "CRITICAL"}
SERIOUS_LEVELS = ("WARNING", "ERROR", "CRITICAL")

# Field names accepted in a JSON log line; the first one present is used.
JSON_FIELDS = {
    "timestamp": ("timestamp", "time", "@timestamp", "datetime"),
    "level": ("level", "severity", "log_level"),
    "service": ("service", "service_name", "logger", "component"),
    "message": ("message", "msg", "event"),
}

# --- redaction -------------------------------------------------------------------------------

# (pattern, replacement), applied in this order, each to the output of the one before.
REDACTIONS = (
    (r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED_IP]"),
    (r"(?iU)\bbearer[\s\x1C-\x1F]+[A-Za-z0-9._~+/=-]{8,}", "Bearer [REDACTED]"),
    (
        r"(?iU)\btoken[\s\x1C-\x1F]*[=:][\s\x1C-\x1F]*[A-Za-z0-9._~+/=-]{8,}",
        "token=[REDACTED]",
    ),
    (
        r"(?iU)\b(password|passwd|api[_-]?key|secret)[\s\x1C-\x1F]*[=:][\s\x1C-\x1F]*"
        r"[^\s\x1C-\x1F,;]+",
        "$1=[REDACTED]",
    ),
)
# Per pattern: groups of lower-case literals, of each of which a matching text holds at least
# one.  Literals avoid "s" and "i", which also match letters outside ASCII when case is ignored.
REDACTION_LITERALS = (
    (("@",),),
    ((".",),),
    (("bearer",),),
    (("token",), ("=", ":")),
    (("word", "wd", "key", "ecret"), ("=", ":")),
)
# Literal that occurs in every replacement above.
REDACTION_MARK = "[REDACTED"

# --- impact score ----------------------------------------------------------------------------

LEVEL_WEIGHTS = {
    "TRACE": 0,
    "DEBUG": 0,
    "INFO": 0,
    "WARNING": 3,
    "ERROR": 8,
    "CRITICAL": 18,
}
SPREAD_WEIGHT = 6
SCORE_CEILING = 100
# (lowest score, label), highest first.
IMPACT_LABELS = ((70, "Severe"), (45, "High"), (20, "Moderate"), (0, "Low"))
NO_EVENTS_LABEL = "None"
NO_EVENTS_EXPLANATION = "No parsed events."
# serious events, affected services, severity points, spread points
IMPACT_EXPLANATION = (
    "%d serious events across %d services; severity points %d, propagation points %d."
)

# --- causes and domains ----------------------------------------------------------------------

# (label, runbook source, keywords); on equal evidence the earlier rule is chosen.
CAUSE_RULES = (
    (
        "Database connection pool exhaustion",
        "database_connection_pool.md",
        ("connection pool exhausted", "active=50", "database connection timeout"),
    ),
    (
        "Authentication signing-key synchronization failure",
        "authentication_failures.md",
        ("jwt signature", "signing key", "returned 401", "token validation"),
    ),
    (
        "CPU saturation and thread-pool starvation",
        "high_cpu.md",
        ("cpu utilization", "thread-pool-starvation", "returned 504", "worker queue"),
    ),
)
UNKNOWN_CAUSE = "Insufficient evidence for a known root-cause pattern"
UNKNOWN_CAUSE_CITATION = "No matching rule"

# On equal counts the earlier domain is chosen.
DOMAIN_KEYWORDS = {
    "message queue": (
        "message queue", "queue", "backlog", "consumer", "acknowledg", "dead-letter"
    ),
    "authentication": (
        "authentication", "auth-service", "jwt", "token", "signing key", "401"
    ),
    "database": ("database", "connection pool", "db connection", "sql", "503"),
    "CPU": ("cpu", "processor", "thread pool", "thread-pool", "saturation"),
}

# A question matching one of these asks for a definition and needs no log context.
DEFINITION_QUESTIONS = (
    r"^what is (?:a|an) ",
    r"^define ",
    r"^what does .+ mean\??$",
    r"^explain (?:the )?(?:concept|definition) of ",
)

# --- documents -------------------------------------------------------------------------------

DOCUMENT_TYPES = (".txt", ".md")
DOCUMENT_BYTES = 10 * 1024 * 1024
CHUNK_CHARACTERS = 1400
DEFAULT_HEADING = "Overview"
CUSTOM_PREFIX = "custom/"
ACTION_HEADINGS = ("immediate response", "prevention")

# --- answers ---------------------------------------------------------------------------------

RELEVANCE_THRESHOLD = 0.48
EVIDENCE_LIMIT = 3
PARENTHESISED_LABEL = r"(?iU)\([\s\x1C-\x1F]*([LR]\d+)[\s\x1C-\x1F]*\)"
CITED_LABEL = r"(?U)\[(?:[LR]?\d+)\]"
HTTP_STATUS = r"(?U)(?<!\d)([1-5]\d{2})(?!\d)"
EVIDENCE_HEADING = (
    r"(?idU)^[\s\x1C-\x1F]*(?:#{1,6}[\s\x1C-\x1F]*)?\*{0,2}evidence\*{0,2}[\s\x1C-\x1F]*$"
)
LOG_LABELLED_LINE = r"(?U)^[\s\x1C-\x1F]*\[L\d+\]"

MISMATCH_ANSWER = (
    "This question appears to concern **%s**, "
    "but the active logs appear to concern **%s**. "
    "Select or upload the matching incident log before asking this question."
)
EMPTY_INDEX_ANSWER = "The knowledge base is empty. Index a runbook before asking a question."
REJECTED_ANSWER = (
    "I don't have enough relevant local evidence to answer this "
    "question safely. Add a related runbook or ask a question about "
    "the active software incident."
)
CITATION_PASSED = "Citation audit passed: "
CITATION_REVIEW = "Citation audit needs review: "
CITATION_INVALID = "invalid labels: "
CITATION_MISSING = "missing required citation type(s): "
CITATION_NONE = "no evidence labels were cited"

# --- evaluation ------------------------------------------------------------------------------

# (name, query, expected source, answerable)
EVALUATION_CASES = (
    (
        "Incident definition",
        "What is a software incident and how is it different from an alert?",
        "incident_response_basics.md",
        True,
    ),
    (
        "Database pool exhaustion",
        "Database connections reached their maximum, payment requests time out, "
        "and the API returns HTTP 503.",
        "database_connection_pool.md",
        True,
    ),
    (
        "Authentication key failure",
        "JWT signature verification fails because the new signing key is missing, "
        "causing HTTP 401 responses.",
        "authentication_failures.md",
        True,
    ),
    (
        "CPU saturation",
        "CPU remains near 98 percent, the worker queue grows, requests return 504, "
        "and the thread pool is starved.",
        "high_cpu.md",
        True,
    ),
    (
        "Unanswerable HR policy question",
        "How many annual vacation days do employees receive and what is the "
        "company parental leave policy?",
        "REJECT",
        False,
    ),
)
# Added only when its expected source is indexed.
OPTIONAL_EVALUATION_CASE = (
    "Message queue consumer failure",
    "Queue depth is growing, active consumers decreased, messages are "
    "not acknowledged, and the oldest message age is increasing.",
    "custom/message_queue_runbook.txt",
    True,
)
REJECTED_SOURCE = "REJECT"
NO_RESULT_SOURCE = "No result"
NO_RESULT_HEADING = "-"

# --- demo incidents --------------------------------------------------------------------------

DEMO_INCIDENTS = {
    "Database pool exhaustion": "sample_incident.log",
    "Authentication outage": "sample_auth_incident.log",
    "High CPU and timeouts": "sample_cpu_incident.log",
}

# --- text templates --------------------------------------------------------------------------

# Name under which reports and prompts speak; callers may pass another one.
ASSISTANT_NAME = "Cinderlog"

ANALYSIS_SYSTEM_PROMPT = """You are a software site reliability engineer reviewing a production incident.
Use only the LOG EVIDENCE and RUNBOOK EVIDENCE supplied by the user.
Never interpret the event as a legal, criminal, medical, or physical incident.
Do not invent metrics, causes, services, actions, or events.
Treat a root cause as probable unless the evidence proves it conclusively.
Every factual claim about the incident must cite one or more log line labels such as [L5].
Runbook guidance must cite its source label such as [R1].
The service name after each log label is authoritative. Never attribute that event to a different service.
In chronological lists, cite the exact log line for every listed event.
If evidence is insufficient, say so explicitly.
Write concise technical English in Markdown.
"""

# log evidence goes between head and middle, runbook evidence between middle and tail
ANALYSIS_PROMPT_HEAD = """Analyze this SOFTWARE SYSTEM incident.

LOG EVIDENCE
"""
ANALYSIS_PROMPT_MIDDLE = """

RUNBOOK EVIDENCE
"""
ANALYSIS_PROMPT_TAIL = """

Return exactly these sections:
## Executive summary
Two sentences maximum.

## Probable root cause
State one probable root cause and cite the strongest log evidence.

## Impact and propagation
Explain the affected services in chronological order. Preserve the exact service name from each log line and cite that line.

## Recommended actions
Give 3-5 concrete actions grounded in the runbook evidence, with runbook citations.

## Confidence
Write High, Medium, or Low and explain the main uncertainty in one sentence.
"""

# %s is the assistant's name
QA_SYSTEM_PROMPT = """You are %s, an offline software incident assistant.
Answer only from the supplied LOG EVIDENCE and RUNBOOK EVIDENCE.
Do not use outside knowledge or invent facts, causes, commands, or metrics.
Never state or infer an HTTP status code unless that exact code occurs in LOG EVIDENCE.
A timeout does not prove an HTTP 500 response. Do not convert one into a status code.
Factual incident claims must cite log labels such as [L4].
Operational guidance must cite runbook labels such as [R1].
Citation labels must use square brackets exactly. Write [L4], never (L4) or L4.
If the evidence does not establish the answer, explicitly say what is missing.
Write concise technical English in Markdown.
"""

QA_NO_SERIOUS_EVENTS = "No WARNING, ERROR, or CRITICAL log evidence was supplied."
QA_NO_LOGS = (
    "Not included because this is a general definition question. "
    "Do not use or cite any [L#] labels."
)
QA_INCIDENT_SCOPE = (
    "This question concerns the active incident. Use [L#] for incident facts "
    "and [R#] for runbook guidance. The answer is invalid unless it contains "
    "at least one [L#] citation and at least one [R#] citation."
)
QA_DEFINITION_SCOPE = (
    "This is a general definition question. Answer from RUNBOOK EVIDENCE "
    "and include at least one [R#] citation. Do not discuss the active "
    "incident or cite logs."
)
# question, scope, log evidence and runbook evidence go between these five pieces
QA_PROMPT_QUESTION = """Answer the user's question about the active SOFTWARE SYSTEM incident.

QUESTION
"""
QA_PROMPT_SCOPE = """

QUESTION SCOPE
"""
QA_PROMPT_LOGS = """

LOG EVIDENCE
"""
QA_PROMPT_RUNBOOKS = """

RUNBOOK EVIDENCE
"""
QA_PROMPT_TAIL = """

Return a complete answer of at most 120 words.
Give the direct answer first and cite claims inline.
Do not reproduce raw evidence lines or copy whole runbook passages.
If an **Evidence** list is useful, include at most 3 short bullets.
Use at most 5 total citations and only [L#]/[R#] labels that appear above.
Never end with an unfinished sentence.
"""

# name, cause, citations / cause, citations
REPORT_HEAD = """## Executive summary
%s detected **%s** as the probable software incident pattern %s.

## Probable root cause
%s. This conclusion is rule-based and derived directly from matching log evidence: %s.

## Impact and propagation
"""
REPORT_ACTIONS = """

## Recommended actions
"""
REPORT_NO_ACTIONS = "- No matching local runbook guidance was found."
# confidence
REPORT_TAIL = """

## Confidence
**%s.** The quick report uses deterministic patterns and does not invoke the language model.
"""

RUNBOOK_CONTEXT = "Runbook context: [R1] %s — %s"
LOG_CONTEXT = "Active log context: [L%d] %s"
SOURCE_CONTEXT_HEAD = "\n\n**Source context**\n"
SOURCE_CONTEXT_JOIN = "  \n"
