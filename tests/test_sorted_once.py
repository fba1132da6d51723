from pyspark.sql import functions as F

from cinderlog.operators import evidence, metrics, ordering, reports
from cinderlog.operators.events import EVENT_ORDER


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_one_sort_for_all_texts(spark, events_of, monkeypatch):
    lines = {
        name: [f"2026-01-01 10:{n % 60:02d}:{n % 7:02d} {('ERROR', 'INFO', 'FATAL')[n % 3]} svc{n % 4} - message {n}" for n in range(size)]
        for name, size in (("hot", 150), ("b", 20), ("c", 1))
    }
    events = events_of(**lines)
    name = F.concat("incident_id", F.lit(".log"))
    want = [rows(evidence.incident_queries(events, 200)), rows(evidence.log_evidence(events, 200)), rows(reports.signatures(events, name))]
    chain = rows(metrics.failure_chain(events))
    ordered = ordering.sort_once(events, ["incident_id"], EVENT_ORDER)
    sorts = []
    sort = ordering._in_order
    monkeypatch.setattr(ordering, "_in_order", lambda *given: sorts.append(1) or sort(*given))
    got = [rows(evidence.incident_queries(ordered, 200)), rows(evidence.log_evidence(ordered, 200)), rows(reports.signatures(ordered, name))]
    assert got == want and not sorts
    # The failure chain numbers some of the events, which is a sort of its own.
    assert rows(metrics.failure_chain(ordered)) == chain and sorts
    plan = evidence.log_evidence(ordered, 200)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
