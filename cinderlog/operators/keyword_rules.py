"""Cause rules and domains as tables, with any number of keywords.

``causes`` and ``domains`` hold a few fixed rules as column expressions.  Here rules are rows, so that they
can be kept and changed as data.  All keywords are looked for in one pass over a text, by an
Aho-Corasick automaton that each Python worker builds once; overlapping keywords are all found.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog import fixed_values as fixed
from cinderlog.operators.causes import CITATIONS, cause_confidence
from cinderlog.operators.events import EVENT_ORDER, serious
from cinderlog.sources.staging import broadcast_if_small, stage

# Keyword bytes of one automaton; more keywords are looked for in several passes.
BLOCK_BYTES = 16 * 1024 * 1024

# The automaton a Python worker built last, by the name of its block.
_built: dict[str, ahocorasick.Automaton] = {}


def cause_rules(spark: SparkSession, rules: Sequence[tuple[str, str, Sequence[str]]] = fixed.CAUSE_RULES) -> DataFrame:
    """``(rule, cause, source, keyword)``; of rules with equal evidence the one with the least number is chosen."""
    rows = [(number, cause, source, word) for number, (cause, source, words) in enumerate(rules) for word in words]
    return spark.createDataFrame(rows, "rule long, cause string, source string, keyword string")


def domain_rules(spark: SparkSession) -> DataFrame:
    """``(rule, domain, keyword)``."""
    rows = [(n, name, word) for n, (name, words) in enumerate(fixed.DOMAIN_KEYWORDS.items()) for word in words]
    return spark.createDataFrame(rows, "rule long, domain string, keyword string")


def _automaton(name: str, shared) -> ahocorasick.Automaton:
    if name not in _built:
        automaton = ahocorasick.Automaton()
        for number, (word, rules) in enumerate(shared.value):
            automaton.add_word(word, (number, len(word), rules))
        if len(automaton):
            automaton.make_automaton()
        _built.clear()
        _built[name] = automaton
    return _built[name]


def _hits(automaton: ahocorasick.Automaton, text: str) -> Counter[int]:
    """Occurrences by rule: of each keyword those that do not overlap, from the left."""
    found: Counter[int] = Counter()
    free: dict[int, int] = {}
    for last, (number, size, rules) in automaton.iter(text):
        if last + 1 - size >= free.get(number, 0):
            free[number] = last + 1
            found.update(rules)
    return found


def keyword_hits(texts: DataFrame, text: Column, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of ``texts`` with ``rule`` and ``hits``, for every rule whose keywords occur in the text.

    ``rules`` has ``rule`` and ``keyword``.  Keywords are compared as they are, so lower-case keywords ask
    for a lower-cased text.  ``hits`` adds up the occurrences of a rule's keywords; a keyword does not overlap
    itself, others may overlap it.  A keyword that several rules have counts for each, a repeated row once.
    Null and empty keywords and null texts match nothing.

    Keywords go to the tasks in blocks of ``block_bytes``; the texts are read once for each block.
    """
    spark = texts.sparkSession
    words = stage(
        rules.where("rule IS NOT NULL AND keyword <> ''")
        .groupBy("keyword")
        .agg(F.collect_set(F.col("rule").cast("long")).alias("rules")),
        "keywords",
    )
    size = words.agg(F.sum(F.octet_length("keyword") + 8 * F.size("rules"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks > 1:
        # The parts of a row's hits are added up; rows that repeat stay apart.
        texts = stage(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    names = texts.columns
    given = texts.withColumn("_text", text)
    schema = T.StructType([*texts.schema.fields]).add("rule", T.LongType()).add("hits", T.LongType())
    found = []
    for number in range(blocks):
        own = words.where(F.pmod(F.xxhash64("keyword"), F.lit(blocks)) == number)
        shared = spark.sparkContext.broadcast([(row["keyword"], row["rules"]) for row in own.toLocalIterator()])

        def find(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(name, shared)
            for batch in batches:
                row, rule, hits = [], [], []
                for place, value in enumerate(batch.column(len(names)).to_pylist() if len(automaton) else ()):
                    for key, count in _hits(automaton, value).items() if value else ():
                        row.append(place)
                        rule.append(key)
                        hits.append(count)
                kept = batch.select(names).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*kept.columns, pa.array(rule, pa.int64()), pa.array(hits, pa.int64())], names=[*names, "rule", "hits"]
                )

        found.append(given.mapInArrow(find, schema))
    if not found:
        return spark.createDataFrame([], schema)
    if len(found) == 1:
        return found[0]
    # A rule's keywords may lie in several blocks.
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy(*names, "rule").agg(F.sum("hits").alias("hits")).drop("_row")


def rule_matches(events: DataFrame, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per event and rule whose keywords occur in its message, at any level; as ``causes.rule_matches``."""
    narrow = events.select("incident_id", *EVENT_ORDER, F.lower("message").alias("_message"))
    hits = keyword_hits(narrow, F.col("_message"), rules, block_bytes)
    return hits.select("incident_id", *EVENT_ORDER, "rule")


def detect_causes(events: DataFrame, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rule with most matching events per incident, with up to three citations; as ``causes.detect_causes``.

    ``rules`` is a table like ``cause_rules``.  The matches are staged as rows of a few numbers; counting and
    citing reads those, not the events.
    """
    matches = stage(rule_matches(events, rules, block_bytes), "rule-matches")
    counts = matches.groupBy("incident_id", "rule").agg(F.count(F.lit(1)).alias("matches"))
    chosen = F.max(F.struct("matches", (-F.col("rule")).alias("_order"))).alias("_best")
    best = counts.groupBy("incident_id").agg(chosen).select(
        "incident_id", F.col("_best.matches").alias("matches"), (-F.col("_best._order")).alias("rule")
    )
    best = stage(best, "best-rules")
    early = Window.partitionBy("incident_id").orderBy(*EVENT_ORDER)
    label = F.transform(
        F.array_sort(F.collect_list(F.struct("_rank", "line_number"))),
        lambda item: F.format_string("[L%d]", item["line_number"]),
    )
    citations = (
        matches.join(broadcast_if_small(best.select("incident_id", "rule")), ["incident_id", "rule"])
        .withColumn("_rank", F.row_number().over(early))
        .filter(F.col("_rank") <= CITATIONS)
        .groupBy("incident_id")
        .agg(F.array_join(label, " ").alias("citations"))
    )
    named = rules.groupBy("rule").agg(F.min(F.struct("cause", "source")).alias("_name"))
    found = (
        events.select("incident_id").distinct()
        .join(best, "incident_id", "left")
        .join(citations, "incident_id", "left")
        .join(broadcast_if_small(stage(named, "rule-names")), "rule", "left")
    )
    number = F.coalesce("matches", F.lit(0))
    return found.select(
        "incident_id",
        F.coalesce("_name.cause", F.lit(fixed.UNKNOWN_CAUSE)).alias("cause"),
        F.col("_name.source").alias("source"),
        number.alias("matches"),
        F.coalesce("citations", F.lit(fixed.UNKNOWN_CAUSE_CITATION)).alias("citations"),
        cause_confidence(number).alias("confidence"),
    )


def _strongest(hits: DataFrame, key: str, rules: DataFrame, block_bytes: int) -> DataFrame:
    """``key, domain, hits`` (all domains together) of the texts in which any keyword occurs."""
    sums = hits.groupBy(key, "rule").agg(F.sum("hits").alias("hits"))
    chosen = F.max(F.struct("hits", (-F.col("rule")).alias("_order")))
    best = sums.groupBy(key).agg((-chosen["_order"]).alias("rule"), F.sum("hits").alias("hits"))
    names = rules.groupBy("rule").agg(F.min("domain").alias("domain"))
    return best.join(broadcast_if_small(stage(names, "domain-names")), "rule").select(key, "domain", "hits")


def incident_domains(events: DataFrame, rules: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Domain of every incident's serious events, as ``domains.incident_domains``, by a table like ``domain_rules``."""
    grave = serious(events).select("incident_id", F.lower(F.concat_ws(" ", "service", "message")).alias("_words"))
    found = _strongest(keyword_hits(grave, F.col("_words"), rules, block_bytes), "incident_id", rules, block_bytes)
    incidents = grave.select("incident_id").distinct().join(found, "incident_id", "left")
    return incidents.select(
        "incident_id", F.col("domain").alias("incident_domain"), F.coalesce("hits", F.lit(0)).alias("domain_hits")
    )
