"""URL filters: host and path rules first, then a weighted vocabulary."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import add

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf

# (verdict, host, path): a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "viagra", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "farm", "free", "loan", "pills", "poker", "sexy", "spam", "track", "win")
# Soft terms weigh one each unless a vocabulary says otherwise; several that weigh so much together reject.
SOFT_LIMIT = 2
# Bytes of terms of one automaton; a larger vocabulary takes several.
VOCABULARY_BYTES = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INNER = frozenset(_LOWER + "0123456789")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null and without ``://``."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return tuple(
        F.coalesce(part, F.lit("")) for part in (F.translate(host, _UPPER, _LOWER), path)
    )


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest fitting rule, or null."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda rule: len(rule[1] + rule[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(
            path, F.lit(rule_path)
        )
        named = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, named).otherwise(found)
    return found


Term = tuple[str, bool, float]


def default_vocabulary() -> list[Term]:
    """Terms, whether one of them rejects alone, and weights."""
    return [(term, True, 1.0) for term in STRICT] + [(term, False, 1.0) for term in SOFT]


def vocabulary_blocks(vocabulary: DataFrame | None, block_bytes: int = VOCABULARY_BYTES) -> list[list[Term]]:
    """Terms of a table ``term, strict, weight`` in blocks of bounded size.

    Terms are lower-cased (A-Z); null and empty ones are left out.  A repeated term counts once: as strict if any
    row says so, with the largest weight.  A null ``strict`` is false, a null weight is one.
    """
    if vocabulary is None:
        return [default_vocabulary()]
    terms = (
        vocabulary.select(
            F.translate("term", _UPPER, _LOWER).alias("term"),
            F.coalesce("strict", F.lit(False)).alias("strict"),
            F.coalesce(F.col("weight").cast("double"), F.lit(1.0)).alias("weight"),
        )
        .where("term <> ''")
        .groupBy("term")
        .agg(F.max("strict").alias("strict"), F.max("weight").alias("weight"))
    )
    blocks: list[list[Term]] = []
    size = block_bytes
    for row in terms.sort("term").toLocalIterator():
        if size >= block_bytes:
            blocks.append([])
            size = 0
        blocks[-1].append((row["term"], row["strict"], row["weight"]))
        size += len(row["term"].encode()) + 16
    return blocks


def vocabulary_hits(url: Column, vocabulary: Sequence[Term]) -> Column:
    """Struct of the distinct ``strict`` and ``soft`` terms in a URL, sorted, and the ``weight`` of the soft ones.

    A term counts where no letter or digit (ASCII) stands next to it.  One automaton finds all terms,
    also overlapping ones, in one pass over the URL, lower-cased.
    """

    def hits(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = ahocorasick.Automaton()
        for term, strict, weight in vocabulary:
            automaton.add_word(term, (term, strict, weight))
        if vocabulary:
            automaton.make_automaton()
        lower = str.maketrans(_UPPER, _LOWER)
        for batch in batches:
            out = []
            for value in batch:
                text = (value.as_py() or "").translate(lower)
                found: dict[str, tuple[bool, float]] = {}
                for last, (term, strict, weight) in automaton.iter(text) if vocabulary else ():
                    before, after = last - len(term), last + 1
                    if (before >= 0 and text[before] in _INNER) or text[after : after + 1] in _INNER:
                        continue
                    found[term] = strict, weight
                named = sorted(found)
                soft = [term for term in named if not found[term][0]]
                out.append(
                    {
                        "strict": [term for term in named if found[term][0]],
                        "soft": soft,
                        "weight": float(sum(found[term][1] for term in soft)),
                    }
                )
            text_list = pa.list_(pa.string())
            kind = pa.struct([("strict", text_list), ("soft", text_list), ("weight", pa.float64())])
            yield pa.array(out, type=kind)

    hits.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(hits, "struct<strict: array<string>, soft: array<string>, weight: double>")(url)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: DataFrame | None = None,
    soft_limit: float = SOFT_LIMIT,
    block_bytes: int = VOCABULARY_BYTES,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, strict_terms, soft_terms`` of every page.

    The longest fitting rule decides.  Without one, a URL is blocked by one strict term, or by two or more distinct
    soft ones that weigh ``soft_limit`` together.  ``vocabulary`` is a table ``term, strict, weight`` of any
    number of terms, see ``vocabulary_blocks``; by default the terms of this module, of weight one.

    A null or empty URL, or one without ``://``, has an empty host and path, so no rule fits it; its
    vocabulary is judged all the same.  Repeated rows are judged alike.  Only ``page_id`` and ``url`` are read.
    """
    host, path = host_and_path(F.col("url"))
    blocks = vocabulary_blocks(vocabulary, block_bytes)
    hits = [vocabulary_hits(F.col("url"), terms).alias(f"_hits_{number}") for number, terms in enumerate(blocks)]
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), *hits).withColumn(
        "_rule", longest_rule(F.col("host"), F.col("path"), rules)
    )
    names = [f"_hits_{number}" for number in range(len(blocks))]
    none = F.array().cast("array<string>")
    # Blocks follow the order of terms, so the hits of all of them are in order.
    strict, soft = (F.concat(none, *(F.col(name)[kind] for name in names)) for kind in ("strict", "soft"))
    weight = reduce(add, (F.col(name)["weight"] for name in names), F.lit(0.0))
    bad = (F.size(strict) > 0) | ((F.size(soft) > 1) & (weight >= soft_limit))
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        strict.alias("strict_terms"),
        soft.alias("soft_terms"),
    )
