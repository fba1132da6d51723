"""Log lines, documents, vectors, questions and answers derived from the given tables.

The given tables hold events, texts and vectors but no log files, runbooks or model answers.
The SQL here turns every row of them into such inputs.  ``events_sql`` is written once for both
SQL dialects, because it defines data: the raw line that Spark parses, and the facts that went
into the line, which are the expected result of parsing it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.stages import pinned
from cinderlog.operators import events as event_ops
from cinderlog.sources.staging import stage


def events_sql(dialect: str) -> str:
    """``(incident_id, line_number, raw_line, kind, ts_text, level, service, message)``.

    A third of all lines belong to one incident, the others to incidents of up to 500 lines.
    ``kind`` is blank, junk, bad_time, bad_json, json or plain.
    """
    spark = dialect == "spark"
    micros = (
        "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        if spark
        else "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
    )
    div = "{0} div {1}" if spark else "{0} // {1}"
    shifted = "CASE WHEN n % 13 = 0 THEN ts - INTERVAL 90 SECOND ELSE ts END"
    return f"""
    WITH numbered AS (
      SELECT event_id AS n, ts, user_id, event_type,
             CAST(round(value * 100) AS BIGINT) AS k
      FROM events
    ), shaped AS (
      SELECT n, k, user_id, event_type,
        CASE WHEN n % 3 = 0 THEN 'incident-hot'
             ELSE 'incident-' || CAST({div.format("n", 500)} AS STRING) END AS incident_id,
        CAST(CASE WHEN n % 3 = 0 THEN {div.format("n", 3)} + 1
                  ELSE n % 500 + 1 END AS BIGINT) AS line_number,
        CASE WHEN n % 101 = 7 THEN 'blank' WHEN n % 97 = 5 THEN 'junk'
             WHEN n % 103 = 9 THEN 'bad_time' WHEN n % 89 = 3 THEN 'bad_json'
             WHEN n % 5 = 1 THEN 'json' ELSE 'plain' END AS kind,
        {micros.format(shifted)} AS micros,
        CASE WHEN event_type = 'error'
               THEN CASE WHEN user_id % 5 = 0 THEN 'FATAL' ELSE 'ERROR' END
             WHEN event_type = 'purchase'
               THEN CASE WHEN n % 2 = 0 THEN 'WARN' ELSE 'Warning' END
             WHEN event_type = 'signup' THEN 'DEBUG'
             WHEN event_type = 'click' THEN 'info'
             ELSE CASE WHEN n % 10 = 7 THEN 'TRACE' ELSE 'INFO' END END AS level_word,
        CASE user_id % 6 WHEN 0 THEN 'api-gateway' WHEN 1 THEN 'auth-service'
             WHEN 2 THEN 'payment.service' WHEN 3 THEN 'queue-consumer'
             WHEN 4 THEN 'db_pool' ELSE 'worker-7' END AS service,
        CASE WHEN n % 7 = 0 THEN n % 4 ELSE ({div.format("n", 500)}) % 4 END AS theme
      FROM numbered
    ), worded AS (
      SELECT n, k, incident_id, line_number, kind, level_word, service,
        CASE n % 4 WHEN 0 THEN substr(micros, 1, 19) WHEN 3 THEN micros
                   ELSE substr(micros, 1, 23) END AS ts_text,
        CASE WHEN upper(level_word) IN ('WARN', 'WARNING') THEN 'WARNING'
             WHEN level_word = 'FATAL' THEN 'CRITICAL'
             ELSE upper(level_word) END AS level,
        CASE WHEN event_type IN ('view', 'click')
               THEN 'Request served in ' || CAST(k AS STRING) || ' ms status '
                    || CAST(200 + k % 5 AS STRING)
             WHEN theme = 0
               THEN 'Connection pool exhausted active=50 waiting=' || CAST(k AS STRING)
                    || '; request returned 503'
             WHEN theme = 1
               THEN 'JWT signature check failed for user-' || CAST(user_id AS STRING)
                    || '@mail.example.com from 10.' || CAST(k % 256 AS STRING)
                    || '.3.7, call returned 401'
             WHEN theme = 2
               THEN 'CPU utilization at ' || CAST(k % 100 AS STRING)
                    || ' percent, worker queue depth=' || CAST(k AS STRING)
             ELSE 'Consumer stopped acknowledging, queue backlog ' || CAST(k AS STRING)
                    || ' password=pw' || CAST(k AS STRING) END
        || CASE WHEN n % 11 = 0
             THEN ' Authorization: Bearer abc' || CAST(k AS STRING) || 'defgh123' ELSE '' END
        || CASE WHEN n % 17 = 0
             THEN ' token: tok_' || CAST(k AS STRING) || '_12345678' ELSE '' END AS message
      FROM shaped
    ), timed AS (
      SELECT *, CASE n % 4 WHEN 1 THEN replace(ts_text, ' ', 'T') || 'Z'
                           WHEN 2 THEN replace(ts_text, '.', ',') ELSE ts_text END AS ts_word
      FROM worded
    )
    SELECT incident_id, line_number, kind, ts_text, level, service, message,
      CASE kind
        WHEN 'blank' THEN '   '
        WHEN 'junk' THEN 'unparsed output ' || CAST(k AS STRING)
        WHEN 'bad_time' THEN '2024-99-99 10:00:00 ' || level_word || ' ' || service || ' - ' || message
        WHEN 'bad_json' THEN '{{"time":"' || ts_word || '","level":30,"logger":"' || service
                             || '","message":"' || message || '"}}'
        WHEN 'json' THEN CASE WHEN n % 2 = 0
          THEN '{{"@timestamp":"' || ts_word || '","severity":"' || level_word
               || '","service_name":"' || service || '","msg":"' || message || '"}}'
          ELSE '{{"time":"' || ts_word || '", "level":"' || level_word
               || '", "logger":"' || service || '", "message":"' || message || '"}}' END
        ELSE CASE WHEN n % 2 = 0
          THEN ts_word || ' ' || level_word || ' ' || service || ' - ' || message
          ELSE ts_word || ' [' || level_word || '] [' || service || ']: ' || message END
      END AS raw_line
    FROM timed
    """


def index_sql() -> str:
    """Every document as one chunk ``(id, source, heading, content)`` of a runbook index."""
    return """
    SELECT CAST(doc_id + 1 AS BIGINT) AS id,
      CASE source WHEN 'src0' THEN 'database_connection_pool.md'
                  WHEN 'src1' THEN 'authentication_failures.md'
                  WHEN 'src2' THEN 'high_cpu.md' ELSE 'custom/' || source END AS source,
      CASE WHEN source <> 'src2' AND doc_id < 40 AND doc_id % 2 = 0 THEN 'Immediate response'
           WHEN source <> 'src2' AND doc_id < 40 THEN 'PREVENTION'
           ELSE 'Section ' || CAST(doc_id AS STRING) END AS heading,
      text AS content
    FROM documents
    """


# Incidents other than the hot one, and lines of the hot one, in ``events_sql``.
_INCIDENTS = "(SELECT CAST(floor(max(event_id) / 500) AS BIGINT) + 1 FROM events)"
_HOT_LINES = "(SELECT CAST(floor(max(event_id) / 3) AS BIGINT) + 1 FROM events)"
_ASKED = f"""CASE WHEN conv_id % 5 = 0 THEN 'incident-hot'
           ELSE 'incident-' || CAST((conv_id * 7) % {_INCIDENTS} AS STRING) END"""


def incident_number_sql() -> str:
    """``(incidents)``: how many incidents there are besides the hot one."""
    return f"SELECT {_INCIDENTS} AS incidents"


def questions_sql() -> str:
    """Every user turn as a question about one of the incidents."""
    return f"""
    SELECT CAST(conv_id * 100 + turn AS BIGINT) AS question_id,
      conv_id,
      {_ASKED} AS incident_id,
      CASE conv_id % 7 WHEN 0 THEN 'What is  a ' || text
        WHEN 1 THEN 'Why is the message queue backlog growing? ' || text
        WHEN 2 THEN 'Which JWT token was rejected with 401? ' || text
        WHEN 3 THEN 'Is the database connection pool exhausted? ' || text
        WHEN 4 THEN 'Where does the CPU saturation come from? ' || text
        WHEN 5 THEN text ELSE '   ' END AS question
    FROM conversations WHERE role = 'user'
    """


def answers_sql() -> str:
    """Every assistant turn as an answer with labels and statuses in it."""
    label = (
        "CAST((conv_id * 1013 + turn * 7) % "
        f"(CASE WHEN conv_id % 5 = 0 THEN {_HOT_LINES} ELSE 500 END) + 1 AS STRING)"
    )
    return f"""
    SELECT CAST(conv_id * 100 + turn AS BIGINT) AS answer_id,
      {_ASKED} AS incident_id,
      conv_id % 7 <> 0 AS include_logs,
      CAST(conv_id % 4 AS BIGINT) AS chunk_count,
      CASE (conv_id + turn) % 6
        WHEN 0 THEN text || ' Observed [L' || {label} || '] and [R1]; status 503.'
        WHEN 1 THEN text || ' Observed ( L' || {label} || ' ), follow (R2), returned 404.'
        WHEN 2 THEN text || ' Unsupported [3], [L' || {label} || '] and [L' || {label} || '].'
        WHEN 3 THEN text
        WHEN 4 THEN text || ' Returned 401.' || chr(10) || '**Evidence**' || chr(10) || '[L'
                    || {label} || '] returned 402' || chr(10) || '[R1] commonly 403 or 418'
        ELSE 'Returned 500: ' || text || chr(10) || '## Evidence' || chr(10) || 'seen 502'
             || chr(10) || ' [L' || {label} || '] 599 of x1234  ' END AS answer
    FROM conversations WHERE role = 'assistant'
    """


class DriverTables:
    """The derived inputs as Spark frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, frame: DataFrame) -> DataFrame:
        """Use all cores on a table that is stored in fewer pieces than there are cores.

        A large table already comes in more pieces and is left as it is.
        """
        cores = self.spark.sparkContext.defaultParallelism
        return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)

    def sql(self, text: str, *names: str) -> DataFrame:
        """Run SQL straight over the Parquet files of the named tables."""
        for name in names:
            text = text.replace(f"FROM {name}", f"FROM parquet.`{self.folder}/{name}.parquet`")
        return self.spark.sql(text)

    def log_lines(self) -> DataFrame:
        lines = self.sql(events_sql("spark"), "events").select(
            "incident_id", "line_number", "raw_line"
        )
        return self.spread(pinned(lines, {"raw_line": F.col("raw_line")}))

    def parsed(self) -> DataFrame:
        return event_ops.parse_lines(self.log_lines())

    def events(self) -> DataFrame:
        return event_ops.events_of(self.parsed())

    def staged_events(self) -> DataFrame:
        """The events as a table, for queries that read them more than once."""
        return stage(self.events(), "events")

    def texts(self) -> DataFrame:
        return self.spread(self.table("documents").select("doc_id", "text"))

    def documents(self) -> DataFrame:
        """Documents with blank lines between their lines and a heading at every fifth."""
        lines = F.transform(
            F.split("text", "\n"),
            lambda line, number: F.when(
                number % 5 == 4,
                F.concat(
                    F.lit("# Step "), (F.length(line) % 3).cast("string"), F.lit("\n"), line
                ),
            ).otherwise(line),
        )
        return self.texts().select(
            F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("source"),
            F.array_join(lines, "\n\n").alias("text"),
        )

    def index(self) -> DataFrame:
        return self.sql(index_sql(), "documents")

    def vectors(self) -> DataFrame:
        """Every vector as a chunk of the source named by its label."""
        number = F.col("vec_id").cast("string")
        return self.table("embeddings").select(
            (F.col("vec_id") + 1).alias("id"),
            F.concat(F.lit("label-"), F.col("label").cast("string")).alias("source"),
            F.concat(F.lit("Section "), number).alias("heading"),
            F.concat(F.lit("Guidance for case "), number).alias("content"),
            "embedding",
        )

    def query_vectors(self) -> DataFrame:
        """Every vector, weighted and added to its own reversal, as a query."""
        weight = (F.col("vec_id") % 5) / F.lit(4.0)
        return self.table("embeddings").select(
            F.col("vec_id").alias("query_id"),
            "label",
            F.zip_with(
                "embedding",
                F.reverse("embedding"),
                lambda value, other: value.cast("double") * weight + other.cast("double"),
            ).alias("embedding"),
        )

    def cases(self) -> DataFrame:
        number = F.col("query_id").cast("string")
        return self.query_vectors().select(
            F.col("query_id").alias("case_id"),
            F.concat(F.lit("case-"), number).alias("name"),
            F.concat(F.lit("label-"), F.col("label").cast("string")).alias("expected_source"),
            (F.col("query_id") % 4 != 0).alias("answerable"),
            (F.col("query_id") % 9 / F.lit(4.0)).alias("latency_seconds"),
            "embedding",
        )

    def questions(self) -> DataFrame:
        return self.sql(questions_sql(), "conversations", "events").drop("conv_id")

    def question_vectors(self) -> DataFrame:
        """Questions with the query vector of their conversation's number."""
        asked = self.sql(questions_sql(), "conversations", "events")
        return asked.join(
            self.query_vectors().select(F.col("query_id").alias("conv_id"), "embedding"), "conv_id"
        ).drop("conv_id")

    def answers(self) -> DataFrame:
        return self.sql(answers_sql(), "conversations", "events")
