"""Mixing sources to target weights: exact block quotas split down a tree of shards.

Documents of a source stand in the order of a seeded hash, so any stretch of it is a random
draw without replacement.  Equal stretches are the source's blocks.  A tree over the output shards
splits every source's block count by multivariate hypergeometric draws; a shard then owns a
disjoint run of every source's blocks and shuffles what is in them locally.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.sources.staging import broadcast_if_small, stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST_COPIES = 2
SHARD_WORDS = 1 << 22
BLOCK_WORDS = 1 << 16
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"
# Bits of the hash that one step of the cut search settles.
_DIGIT = 10


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _top(bits: int, skip: int = 0) -> Column:
    """``bits`` bits of the place after the first ``skip``; places are unsigned."""
    return F.shiftrightunsigned("_place", 64 - skip - bits).bitwiseAND(F.lit((1 << bits) - 1))


def hypergeometric(total: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """Marked ones among ``drawn`` of ``total`` with ``marked`` in all, by inverse distribution.

    Tails beyond eight standard deviations, of a chance below 1e-14, are left out.
    """
    lowest = F.greatest(F.lit(0), drawn - (total - marked))
    highest = F.least(drawn, marked)
    size = F.greatest(total, F.lit(1)).cast("double")
    mean = drawn * marked / size
    spread = F.sqrt(
        mean * ((total - marked) / size) * ((total - drawn) / F.greatest(size - 1, F.lit(1.0)))
    )
    first = F.greatest(lowest, F.floor(mean - 8 * spread).cast("long") - 10)
    last = F.least(highest, F.ceil(mean + 8 * spread).cast("long") + 10)

    def next_weight(weight: Column, k: Column) -> Column:
        return (
            weight
            * (marked - k)
            * (drawn - k)
            / ((k + 1).cast("double") * (total - marked - drawn + k + 1))
        )

    def add(state: Column, k: Column) -> Column:
        return F.struct(
            next_weight(state["w"], k).alias("w"), (state["sum"] + state["w"]).alias("sum")
        )

    def seek(goal: Column) -> Callable[[Column, Column], Column]:
        return lambda state, k: F.struct(
            next_weight(state["w"], k).alias("w"),
            (state["sum"] + state["w"]).alias("sum"),
            F.when(state["sum"] <= goal, k).otherwise(state["k"]).alias("k"),
        )

    w, zero = F.lit(1.0).alias("w"), F.lit(0.0).alias("sum")
    return _let(
        F.sequence(first, last),
        lambda ks: _let(
            F.aggregate(ks, F.struct(w, zero), add)["sum"] * chance,
            lambda goal: F.aggregate(
                ks, F.struct(w, zero, F.element_at(ks, 1).alias("k")), seek(goal)
            )["k"],
        ),
    )


def _chance(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the parts only."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") * F.lit(2.0**-53)


def source_targets(
    sources: DataFrame, weights: Sequence[float], share: float, most: int
) -> DataFrame:
    """Add ``_rank, target`` to rows of ``(source, source_size)``.

    Weights go round over the sources by code point, null last.  A target stops at ``most`` times
    its source's size, and what is above goes to the others by weight: all targets are
    ``least(level * weight, cap)`` with the one level that makes them sum up.
    """
    # One row per source; the windows see nothing else.
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("_rank", F.row_number().over(by_name) - 1).withColumns(
        {
            "_weight": F.element_at(
                F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")
            ),
            "_cap": F.col("source_size") * F.lit(float(most)),
        }
    )
    everything = Window.partitionBy(F.lit(0))
    fullest_first = everything.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    earlier = fullest_first.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda name: F.coalesce(F.sum(name).over(earlier), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(share) - before("_cap")) / (
        F.sum("_weight").over(everything) - before("_weight")
    )
    levels = ranked.withColumn("_level", level).withColumn(
        "_fits", F.col("_level") * F.col("_weight") <= F.col("_cap")
    )
    # From the first source that the level does not fill, in this order, no source is full.
    common = F.min_by(
        F.when(F.col("_fits"), F.col("_level")), F.when(F.col("_fits"), F.col("_cap") / F.col("_weight"))
    ).over(everything)
    return levels.withColumn("_common", common).select(
        "source",
        "source_size",
        "_rank",
        F.least(F.coalesce(F.col("_common") * F.col("_weight"), "_cap"), "_cap").alias("target"),
    )


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``_rank, _cut``: last place that the begun copy of a source takes; none if it is empty.

    The place is found digit by digit: each step sums sizes by the next bits of the places that
    are still in question, so that no task meets a source's rows, and the last step has the
    rows that share two digits.  Rows with equal ids and texts share a place and go together.
    """
    rest = F.col("target") - F.col("_whole") * F.col("source_size")
    open_rows = sized.join(
        broadcast_if_small(
            stage(
                plan.where(rest > 0).select(
                    F.col("source").alias("_source"), "_rank", rest.alias("_rest")
                ),
                "mix-rest",
            )
        ),
        F.col("source").eqNullSafe(F.col("_source")),
    ).select("_rank", "_place", "size", "_rest")
    for step in range(2):
        digits = (
            open_rows.withColumn("_digit", _top(_DIGIT, step * _DIGIT))
            .groupBy("_rank", "_rest", "_digit")
            .agg(F.sum("size").alias("_size"))
        )
        upto = Window.partitionBy("_rank").orderBy("_digit")
        found = (
            digits.withColumn("_upto", F.sum("_size").over(upto))
            .where(F.col("_upto") >= F.col("_rest") - F.lit(1e-6))
            .groupBy("_rank")
            .agg(F.min(F.struct("_digit", (F.col("_rest") - F.col("_upto") + F.col("_size")).alias("_left"))).alias("_at"))
        )
        found = broadcast_if_small(
            stage(found.select(F.col("_rank").alias("_of"), "_at._digit", "_at._left"), "mix-digit")
        )
        open_rows = (
            open_rows.withColumn("_own", _top(_DIGIT, step * _DIGIT))
            .join(found, (F.col("_rank") == F.col("_of")) & (F.col("_own") == F.col("_digit")))
            .select("_rank", "_place", "size", F.col("_left").alias("_rest"))
        )
    places = open_rows.groupBy("_rank", "_rest", "_place").agg(F.sum("size").alias("_size"))
    in_order = Window.partitionBy("_rank").orderBy(_unsigned(F.col("_place")))
    taken = places.withColumn("_upto", F.sum("_size").over(in_order)).where(
        F.col("_upto") - F.col("_size") / 2 <= F.col("_rest")
    )
    # Two digits are known to hold the cut; where none of their rows is taken it lies before them.
    cut = taken.groupBy("_rank").agg(F.max_by("_place", _unsigned(F.col("_place"))).alias("_last"))
    floor = F.shiftleft(F.shiftrightunsigned(F.min("_place"), 64 - 2 * _DIGIT), 64 - 2 * _DIGIT) - 1
    return (
        open_rows.groupBy("_rank")
        .agg(F.nullif(floor, F.lit(-1).cast("long")).alias("_floor"))
        .join(cut, "_rank", "left")
        .select("_rank", F.coalesce("_last", "_floor").alias("_cut"))
    )


def _unsigned(place: Column) -> Column:
    """A long that sorts as the place does when taken as unsigned."""
    return place.bitwiseXOR(F.lit(-(1 << 63)))


def _draws(seed: int, level: int) -> Callable[[Column, Column], Column]:
    """A step over a node's sources: how many of a source's blocks go left."""

    def draw(state: Column, item: Column) -> Column:
        count, source = item["count"], item["source"]
        chance = _chance(F.lit(seed), F.lit(level), F.col("_node"), source)
        return _let(
            hypergeometric(state["all"], count, state["open"], chance),
            lambda got: F.struct(
                (state["all"] - count).alias("all"),
                (state["open"] - got).alias("open"),
                F.array_append(state["left"], got).alias("left"),
            ),
        )

    return draw


def _tree(quotas: DataFrame, depth: int, seed: int) -> DataFrame:
    """``shard, _rank, _first, _blocks``: each source's run of blocks in each shard."""
    root = quotas.groupBy().agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_rank", "_blocks"))), lambda item: item["_blocks"]
        ).alias("_counts")
    )
    nodes = root.select(
        F.lit(0).cast("long").alias("_node"),
        "_counts",
        F.transform("_counts", lambda _: F.lit(0).cast("long")).alias("_starts"),
    )
    plus = lambda left, right: F.zip_with(left, right, lambda x, y: x + y)
    minus = lambda left, right: F.zip_with(left, right, lambda x, y: x - y)
    for level in range(depth):
        total = F.aggregate("_counts", F.lit(0).cast("long"), lambda sum_, x: sum_ + x)

        items = F.transform("_counts", lambda x, i: F.struct(x.alias("count"), i.alias("source")))
        start = F.struct(
            F.col("_total").alias("all"),
            F.floor((F.col("_total") + F.col("_node") % 2) / 2).cast("long").alias("open"),
            F.array().cast("array<bigint>").alias("left"),
        )
        split = nodes.withColumn("_total", total).withColumn(
            "_left", F.aggregate(items, start, _draws(seed, level))["left"]
        )
        children = F.array(
            F.struct((F.col("_node") * 2).alias("_node"), F.col("_left").alias("_counts"), F.col("_starts").alias("_starts")),
            F.struct(
                (F.col("_node") * 2 + 1).alias("_node"),
                minus(F.col("_counts"), F.col("_left")).alias("_counts"),
                plus(F.col("_starts"), F.col("_left")).alias("_starts"),
            ),
        )
        nodes = split.select(F.inline(children))
        if level % 6 == 5:
            nodes = nodes.repartition("_node")
    runs = F.arrays_zip(F.col("_counts").alias("blocks"), F.col("_starts").alias("first"))
    return nodes.select(F.col("_node").alias("shard"), F.posexplode(runs).alias("_rank", "_run")).select(
        "shard", "_rank", F.col("_run")["first"].alias("_first"), F.col("_run")["blocks"].alias("_blocks")
    )


def _placed(documents: DataFrame, seed: int, *kept: Column | str) -> DataFrame:
    return documents.select(
        *kept,
        F.col("source").cast("string").alias("_of"),
        n_words(F.col("text")).alias("_size"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), "text").alias("_place"),
    )


def _recipe(
    sized: DataFrame,
    weights: Sequence[float],
    share: float,
    most: int,
    shard_words: int,
    block_words: int,
    seed: int,
) -> tuple[DataFrame, DataFrame]:
    """The plan per source and the shard of every drawn block; both staged."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    plan = stage(
        source_targets(sources, weights, share, most).withColumn("_whole", whole.cast("long")),
        "mix-targets",
    )
    fullness = F.greatest(F.col("source_size"), F.lit(1)) / F.lit(block_words)
    bits = F.least(F.lit(30), F.greatest(F.lit(0), F.ceil(F.log2(fullness)))).cast("int")
    plan = plan.withColumn("_bits", bits).join(_cuts(sized, plan), "_rank", "left")
    begun = F.when(F.col("_cut").isNotNull(), _block("_cut") + 1).otherwise(0)
    blocks = F.col("_whole") * _block_count() + begun
    plan = stage(plan.withColumn("_blocks", blocks), "mix-plan")
    words = plan.agg(F.sum("target")).first()[0] or 0
    depth = max(0, math.ceil(math.log2(max(words, 1) / shard_words)))
    runs = _tree(plan.select("_rank", "_blocks"), depth, seed)
    drawn = runs.where(F.col("_blocks") > 0).select(
        "shard",
        "_rank",
        F.explode(F.sequence("_first", F.col("_first") + F.col("_blocks") - 1)).alias("_block"),
    )
    return plan, stage(drawn, "mix-blocks")


def _block_count() -> Column:
    return F.expr("shiftleft(1L, _bits)")


def _block(place: str) -> Column:
    """Number of the block, from 0, that a place of a source falls into."""
    return F.expr(f"shiftrightunsigned({place}, 33) div shiftleft(1L, 31 - _bits)")


def _drawn(placed: DataFrame, plan: DataFrame, blocks: DataFrame, most: int) -> DataFrame:
    """Add ``source_size, target, _copies, _shards``; a document's copies are in different blocks."""
    sources = plan.withColumnRenamed("source", "_source")
    rows = placed.join(
        broadcast_if_small(sources), F.col("_of").eqNullSafe(F.col("_source"))
    ).withColumn(
        "_copies",
        F.col("_whole")
        + F.when(_unsigned(F.col("_place")) <= _unsigned(F.col("_cut")), F.lit(1)).otherwise(0),
    )
    names = [f"_shard{copy}" for copy in range(most)]
    for copy, name in enumerate(names):
        at = F.when(F.col("_copies") > copy, _block("_place") + F.lit(copy) * _block_count())
        of = broadcast_if_small(blocks).select(
            F.col("_rank").alias("_owner"), F.col("_block").alias("_at"), F.col("shard").alias(name)
        )
        rows = rows.join(of, (F.col("_rank") == F.col("_owner")) & (at == F.col("_at")), "left")
        rows = rows.drop("_owner", "_at")
    return rows.withColumn("_shards", F.filter(F.array(*names), lambda shard: shard.isNotNull()))


def plan_mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """What the mix takes of every document: ``doc_id, size, source_size, target, taken, copies,
    shards``.

    ``documents`` has ``doc_id, text, source``; other columns are ignored.  Sizes are words.
    Sources share ``share`` times all words by weight, up to ``most`` times their own.  A source
    gives whole copies of itself and, of one more copy, the documents up to its cut, the last one if
    that comes nearer to the target: a source misses its target by half a document at most.
    ``shards`` names the output shard of each copy.

    Null texts are empty.  Documents of empty sources are not taken, they have no words.  A null source
    is a source, the last one.  Rows with equal id and text are taken alike.  An empty table
    gives an empty plan.  Only numbers are staged: one row per document without its text.
    Arrays with one number per source are held in a row, so sources are expected to be listable.
    """
    sized = stage(_placed(documents, seed, "doc_id"), "mix-sizes")
    recipe = _recipe(_named(sized), weights, share, most, shard_words, block_words, seed)
    return _drawn(sized, *recipe, most).select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        (F.col("_size") * F.col("_copies")).alias("taken"),
        F.col("_copies").alias("copies"),
        F.col("_shards").alias("shards"),
    )


def _named(placed: DataFrame) -> DataFrame:
    return placed.select(F.col("_of").alias("source"), F.col("_size").alias("size"), "_place")


def mix(
    documents: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    shard_words: int = SHARD_WORDS,
    block_words: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """The mix itself: the documents' columns, ``shard`` and ``place``, a row for each copy.

    Rows are grouped by shard and shuffled inside it by a seeded hash.  Input columns named
    ``shard`` or ``place`` are replaced.  See ``plan_mix`` for what is taken.  Documents are read
    twice, first for their sizes, and their texts move once, to their shards.
    """
    sized = stage(_named(_placed(documents, seed)), "mix-sizes")
    recipe = _recipe(sized, weights, share, most, shard_words, block_words, seed)
    kept = [name for name in documents.columns if name not in ("shard", "place")]
    whole = _placed(documents, seed, F.struct(*kept).alias("_document"))
    copies = _drawn(whole, *recipe, most).select(
        "_document", "_place", F.posexplode("_shards").alias("_copy", "shard")
    )
    place = F.xxhash64(F.lit(seed), "_place", "_copy", "shard").alias("place")
    return (
        copies.select("_document.*", "shard", place)
        .repartition("shard")
        .sortWithinPartitions("shard", "place")
    )
