"""Preference formatting and mixing."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cinderlog.llm import chat, mixing

TURNS = "pair_id long, side string, turn long, role string, text string, part string"


def expected_pairs(rows, part_turns):
    """One row per (pair, part), by walking the turns of both sides."""
    pairs = defaultdict(lambda: {"chosen": {}, "rejected": {}})
    for pair, side, turn, role, text in rows:
        if pair is None or turn is None or side not in ("chosen", "rejected"):
            continue
        said = (role or "unknown" if role is None else role, text or "")
        held = pairs[pair][side]
        held[turn] = min(held[turn], said) if turn in held else said
    out = {}
    for pair, sides in pairs.items():
        turns = sorted({*sides["chosen"], *sides["rejected"]})
        shared = []
        for turn in turns:
            if sides["chosen"].get(turn) != sides["rejected"].get(turn):
                break
            shared.append(turn)
        for part in sorted({turn // part_turns for turn in turns}):
            own = [turn for turn in turns if turn // part_turns == part]
            row = []
            for name, side, inside in (
                ("prompt", "chosen", lambda t: t in shared),
                ("chosen", "chosen", lambda t: t not in shared),
                ("rejected", "rejected", lambda t: t not in shared),
            ):
                text, spans = "", []
                for turn in own:
                    if not inside(turn) or turn not in sides[side]:
                        continue
                    role, body = sides[side][turn]
                    text += f"<|{role}|>\n"
                    start = len(text)
                    text += f"{body}<|end|>\n"
                    if role == "assistant":
                        spans.append(f"{start}:{len(text)}")
                row.append((text, "" if name == "prompt" else ",".join(spans)))
            out[pair, part] = row
    return out


def test_preferences_by_walking_turns(frame):
    rows = [
        (1, "chosen", 0, "user", "Hé?"), (1, "rejected", 0, "user", "Hé?"),
        (1, "chosen", 1, "assistant", "yes"), (1, "rejected", 1, "assistant", "no"),
        (1, "chosen", 2, "user", "thanks"), (1, "chosen", 5, "assistant", None),
        (2, "chosen", 0, "system", "a"), (2, "rejected", 0, "system", "b"),
        (3, "chosen", 0, "user", "same"), (3, "rejected", 0, "user", "same"),
        (4, "chosen", 0, None, "only one side"),
        (5, "chosen", 0, "user", "b"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"),
        (None, "chosen", 0, "user", "x"), (6, "chosen", None, "user", "x"), (6, "other", 0, "user", "x"),
    ]
    rows += [(7, side, turn, "user", f"t{turn}" + side * (turn == 7)) for side in ("chosen", "rejected") for turn in range(10)]
    turns = frame(TURNS, *(row + ("clash",) for row in rows))
    got = {
        (r.pair_id, r.part): [(r.prompt, ""), (r.chosen, r.chosen_spans), (r.rejected, r.rejected_spans)]
        for r in chat.format_preferences(turns, part_turns=4).collect()
    }
    assert got == expected_pairs(rows, 4)
    assert chat.format_preferences(turns.limit(0)).count() == 0


def test_alternative_replies_share_all_but_the_last_reply(frame):
    talks = frame(
        "conv_id long, turn long, role string, text string",
        (0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "more"),
        (1, 0, "user", "r"), (1, 1, "assistant", "a1"),
        (2, 0, "user", "alone"),
    )
    rows = {r.pair_id: r for r in chat.format_preferences(chat.alternative_replies(talks)).collect()}
    assert rows[0].prompt == "<|user|>\nq<|end|>\n"
    assert rows[0].chosen == "<|assistant|>\na0<|end|>\n<|user|>\nmore<|end|>\n"
    assert rows[0].rejected == "<|assistant|>\na1<|end|>\n"
    assert rows[0].chosen_spans == "14:24"
    assert rows[1].rejected == "<|assistant|>\na0<|end|>\n"
    assert rows[2].chosen == rows[2].rejected == ""


def water_level(sizes, weights, share, most):
    """Targets by refilling the open sources until none is above its cap."""
    names = sorted(sizes, key=lambda name: (name is None, name or ""))
    weight = {name: weights[k % len(weights)] for k, name in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        open_ = [name for name in names if name not in full]
        each = {name: left * weight[name] / sum(weight[o] for o in open_) for name in open_}
        above = [name for name in open_ if each[name] > most * sizes[name]]
        if not above:
            return each | {name: most * sizes[name] for name in full}
        full.update(above)
        left -= sum(most * sizes[name] for name in above)


DOCUMENTS = "doc_id long, text string, source string, shard string, size int"


@pytest.fixture(scope="module")
def sources(spark):
    rows = []
    for k in range(3000):
        source = "big" if k % 3 == 0 else [None, "", "é", "b", "c"][k % 5]
        text = None if k % 97 == 0 else " ".join(["word"] * (k * 7919 % 90))
        rows.append((k, text, source, "clash", 1))
    return spark.createDataFrame(rows + rows[:5] + [(None, "a b", "b", None, None)] * 3, DOCUMENTS)


def test_mix_meets_targets(sources):
    plan = mixing.plan_mix(sources, shard_words=1 << 12, block_words=1 << 8)
    rows = plan.join(sources.select("doc_id", "source").distinct(), "doc_id").collect()
    assert plan.count() == sources.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for row in rows:
        sizes[row.source] += row["size"]
        taken[row.source] += row.taken
        target[row.source] = row.target
        assert row.taken <= 2 * row["size"] and len(row.shards) == row.copies
    expected = water_level(
        {r.source: r.s for r in sources.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("s")).collect()},
        mixing.WEIGHTS, 1.5, 2,
    )
    for source, value in expected.items():
        assert math.isclose(target[source], value, rel_tol=1e-9)
        assert abs(taken[source] - value) <= 90
    assert sorted(map(tuple, plan.drop("shards").collect()), key=repr) == sorted(
        map(tuple, mixing.plan_mix(sources, shard_words=1 << 12, block_words=1 << 8).drop("shards").collect()), key=repr
    )


def test_mix_rows_are_the_planned_copies(sources):
    options = {"shard_words": 1 << 12, "block_words": 1 << 8}
    mixed = mixing.mix(sources, **options)
    assert set(mixed.columns) == {*sources.columns, "place"}
    planned = mixing.plan_mix(sources, **options)
    shards = planned.select(F.explode("shards").alias("shard"), "size").groupBy("shard").agg(F.count("*").alias("n"))
    assert {r.shard: r["count"] for r in mixed.groupBy("shard").count().collect()} == {r.shard: r.n for r in shards.collect()}
    counts = [r.n for r in shards.collect()]
    assert len(counts) == 64 and max(counts) < 3 * min(counts)


def test_mix_of_nothing(sources):
    assert mixing.plan_mix(sources.limit(0)).count() == 0
    assert mixing.mix(sources.where("text is null")).count() == 0


def test_hypergeometric_draws_have_the_right_shape(spark):
    chance = (F.col("id") + 0.5) / 1000
    total, marked, drawn = (F.lit(x).cast("long") for x in (60, 25, 20))
    draws = spark.range(1000).select(mixing.hypergeometric(total, marked, drawn, chance).alias("x"))
    got = {r.x: r["count"] for r in draws.groupBy("x").count().collect()}
    ways = {k: math.comb(25, k) * math.comb(35, 20 - k) / math.comb(60, 20) for k in range(21)}
    assert all(abs(got.get(k, 0) / 1000 - p) <= 0.0021 for k, p in ways.items())
    edge = spark.range(1).select(
        mixing.hypergeometric(*(F.lit(x).cast("long") for x in (5, 5, 3)), F.lit(0.9)).alias("all"),
        mixing.hypergeometric(*(F.lit(x).cast("long") for x in (0, 0, 0)), F.lit(0.0)).alias("none"),
    ).first()
    assert (edge["all"], edge["none"]) == (3, 0)
