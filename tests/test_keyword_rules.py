import random

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import causes, domains, keyword_rules

RULE = "rule long, keyword string"


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [keyword_rules.BLOCK_BYTES, 60_000])
def test_ten_thousand_rules(frame, block_bytes):
    """Against counting each keyword by itself; keywords overlap, nest, repeat and belong to several rules."""
    draw = random.Random(6)
    words = {"".join(draw.choices("abc", k=draw.randint(1, 9))) for _ in range(9000)}
    rules = [(draw.randrange(10_000), word) for word in sorted(words) for _ in range(draw.randint(1, 2))]
    rules += [(k, f"key-{k}") for k in range(10_000)] + [(1, ""), (2, None), (None, "abc"), rules[0]]
    texts = [(k, "".join(draw.choices("abc x", k=60)) + f" key-{draw.randrange(10_000)}") for k in range(12)]
    texts += [(20, None), (21, ""), (22, "zzz"), texts[0]]
    found = keyword_rules.keyword_hits(
        frame("id long, text string", *texts), F.col("text"), frame(RULE, *rules), block_bytes
    )
    own = {(rule, word) for rule, word in rules if rule is not None and word}
    want = []
    for key, text in texts:
        hits = {}
        for rule, word in own:
            count = (text or "").count(word)
            if count:
                hits[rule] = hits.get(rule, 0) + count
        want += [(key, text, rule, count) for rule, count in hits.items()]
    assert rows(found) == sorted(want, key=repr)


def test_fixed_rules_as_tables(spark, events_of):
    draw = random.Random(2)
    words = [word for _, _, keywords in causes.fixed.CAUSE_RULES for word in keywords]
    words += [word for keywords in domains.fixed.DOMAIN_KEYWORDS.values() for word in keywords] + ["queue depth", "nothing"]
    lines = {
        f"i{k}": [f"2026-01-01 10:00:{n:02d} {draw.choice(('INFO', 'ERROR'))} svc - {' '.join(draw.choices(words, k=3)).upper()}" for n in range(9)]
        for k in range(8)
    }
    events = events_of(none=["2026-01-01 10:00:00 ERROR svc - quiet"], fine=["2026-01-01 10:00:00 INFO svc - sql"], **lines)
    table = keyword_rules.cause_rules(spark)
    assert rows(keyword_rules.rule_matches(events, table)) == rows(causes.rule_matches(events))
    assert rows(keyword_rules.detect_causes(events, table)) == rows(causes.detect_causes(events))
    by_table = keyword_rules.incident_domains(events, keyword_rules.domain_rules(spark))
    assert rows(by_table) == rows(domains.incident_domains(events))
    quiet = keyword_rules.detect_causes(events, table.where("false"))
    assert {row.cause for row in quiet.collect()} == {causes.fixed.UNKNOWN_CAUSE} and quiet.count() == 10
    assert keyword_rules.detect_causes(events.where("false"), table).count() == 0
