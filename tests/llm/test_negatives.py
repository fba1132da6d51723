import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import negatives

SCHEMA = "vec_id long, label int, vector array<double>, score string, window int"


def by_hand(rows, positives=5, limit=10, window=(30, 90)):
    sound = {}
    for vec_id, label, vector, *_ in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not np.isfinite(x) for x in vector):
            continue
        held = (label, vector)
        sound[vec_id] = min(sound.get(vec_id, held), held)
    width = max((len(v) for _, v in sound.values()), default=0)
    full = {k: (label, [int(x) for x in v] + [0] * (width - len(v))) for k, (label, v) in sound.items()}
    out = set()
    for a, (label, vector) in full.items():
        if a % 10:
            continue
        scores = {k: sum(x * y for x, y in zip(vector, v)) for k, (_, v) in full.items() if k != a}
        order = sorted(scores, key=lambda k: (-scores[k], k))
        for p in [k for k in order if full[k][0] == label][:positives]:
            fits = [
                k
                for k in order
                if full[k][0] != label and window[0] * scores[p] <= 100 * scores[k] <= window[1] * scores[p]
            ]
            out |= {(a, p, r, k, scores[p], scores[k]) for r, k in enumerate(fits[:limit], 1)}
    return out


def mined(frame, **options):
    rows = negatives.mine_negatives(frame, F.col("vec_id") % 10 == 0, **options).collect()
    got = {tuple(row) for row in rows}
    assert len(got) == len(rows)
    return got


def vectors(chosen, count, width, spread):
    rows = []
    for vec_id in range(count):
        vector = [float(chosen.randint(-spread, spread)) for _ in range(chosen.choice((width, width, width - 3)))]
        rows.append((vec_id, chosen.randint(0, 3), vector, "x", 1))
    return rows


@pytest.mark.parametrize("width, spread", [(20, 30), (40, 2), (5, 100)])
def test_all_rounds_and_blocks(frame, monkeypatch, width, spread):
    """Thresholds go down over several rounds; anchors come in blocks; many scores are equal."""
    rows = vectors(random.Random(width), 160, width, spread)
    # One vector with half of the rows, and rows that repeat.
    rows += [(1000 + k, k % 4, rows[0][2], None, 2) for k in range(80)] + rows[:20]
    given = frame(SCHEMA, *rows)
    monkeypatch.setattr(negatives, "_FIRST", 8)
    monkeypatch.setattr(negatives, "_ANCHORS", 4)
    monkeypatch.setattr(negatives, "_ROWS", 32)
    want = by_hand(rows)
    assert len(want) > 200
    assert mined(given, block_bytes=2000) == want


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, 1, [3.0, 4.0], "a", 1),
        (1, 1, [2.0, 4.0], None, None),
        (2, 2, [1.0, 1.0], "b", 1),
        (3, 2, [1.0, None], "b", 1),
        (4, 2, [1.0, nan], "b", 1),
        (5, 2, [inf, 1.0], "b", 1),
        (6, None, [2.0, 1.0], "b", 1),
        (7, 3, None, "b", 1),
        (None, 3, [2.0, 1.0], "b", 1),
        (8, 3, [2.0], "b", 1),
        (8, 3, [2.0, 0.0, 1.0], "b", 1),
        (9, 3, [], "b", 1),
        (10, 4, [-5.0, 1.0], "alone", 1),
        (20, 5, [-5.0, 1.0], "below zero", 1),
        (21, 5, [5.0, 1.0], "below zero", 1),
        (30, 6, [0.0], "zero", 1),
        (31, 6, [9.0], "zero", 1),
    ]
    got = mined(frame(SCHEMA, *rows))
    assert got == by_hand(rows)
    assert {row[0] for row in got} == {0, 30}
    assert mined(frame(SCHEMA, *rows).where("false")) == set()
    assert mined(frame(SCHEMA, rows[1], rows[2])) == set()


def test_reach_finds_all_pairs():
    chosen = np.random.default_rng(5)
    for decay in (0.0, 0.1, 0.5):
        shape = np.exp(-decay * np.arange(50))
        rows = np.round(chosen.normal(size=(300, 50)) * 60 * shape)
        anchors = np.round(chosen.normal(size=(40, 50)) * 60 * shape)
        scores = rows @ anchors.T
        norms = negatives.suffix_norms(anchors)
        for share in (0.5, 0.9, 0.999, 1.0):
            least = np.quantile(scores, share, axis=0) if share < 1 else np.full(40, np.inf)
            i, a, found = negatives.in_reach(rows, anchors, norms, least)
            want = {(int(x), int(y)) for x, y in zip(*np.nonzero(scores >= least))}
            assert len(i) == len(want)
            assert set(zip(i.tolist(), a.tolist())) == want
            assert (found == scores[i, a]).all()


def test_index_leaves_out_what_cannot_reach(monkeypatch):
    """With fast falling components only the first lists are ever added up."""
    rows = np.round(np.random.default_rng(1).normal(size=(500, 64)) * 200 * np.exp(-0.3 * np.arange(64)))
    norms = negatives.suffix_norms(rows)
    least = np.full(10, 0.5 * np.linalg.norm(rows, axis=1).max() * np.linalg.norm(rows[:10], axis=1).min())
    need = (least[:, None] / np.maximum(norms[:10], 1e-12)).min(axis=0)
    indexed = (norms[:, :-1] >= need[None, :-1]).sum(axis=1)
    assert indexed.max() < norms.shape[1] - 1
