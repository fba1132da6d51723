"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf, rounds
from cinderlog.sources.staging import broadcast_if_small, join_unique, stage

SHINGLE = 3
MOST_BITS = 3
SEED = 42
# Members of two segment values that one task row compares at most, on either side.
BLOCK = 1024
# Words hashed at once.
_STRETCH = 1 << 16

_FOLD = bytes(code + 32 if 65 <= code <= 90 else code for code in range(256))


def _hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    if len(words) < size:
        if words:
            yield np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
        return
    last = len(words) - size + 1
    for start in range(0, last, _STRETCH):
        stop = min(start + _STRETCH, last)
        shingles = map(b" ".join, zip(*(words[start + k : stop + k] for k in range(size))))
        yield np.fromiter(
            map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=stop - start
        )


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """Bits that over half of the shingles' hashes have; a text without words has none."""
    ones, total = np.zeros(64, dtype=np.int64), 0
    for hashes in _hashes(text.translate(_FOLD).split(), size):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def fingerprints(text: Column, size: int = SHINGLE) -> Column:
    """The SimHash of whole texts as a long with the same bits; null is an empty text."""

    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            prints = [fingerprint(text, size) for texts in rounds(batch) for text in texts]
            yield pa.array(np.array(prints, dtype=np.uint64).view(np.int64))

    hashed.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(hashed, "bigint")(text.cast("binary"))


def _forest(lefts: np.ndarray, rights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (member, root) that join what links of ``most`` bits between the sides join."""
    near = np.bitwise_count(lefts[:, None] ^ rights[None, :]) <= most
    links: list[tuple[int, int]] = []
    waiting_left, waiting_right = np.ones(len(lefts), bool), np.ones(len(rights), bool)
    for start in range(len(lefts)):
        if not waiting_left[start]:
            continue
        waiting_left[start] = False
        members = {int(lefts[start])}
        new_left = np.array([start])
        while len(new_left):
            new_right = np.flatnonzero(near[new_left].any(axis=0) & waiting_right)
            waiting_right[new_right] = False
            members.update(rights[new_right].tolist())
            new_left = np.flatnonzero(near[:, new_right].any(axis=1) & waiting_left)
            waiting_left[new_left] = False
            members.update(lefts[new_left].tolist())
        root = min(members)
        links += [(member, root) for member in members if member != root]
    return links


def _verified(lefts: Column, rights: Column, most: int) -> Column:
    def verified(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for left, right in batches:
            out = []
            for a, b in zip(left, right):
                sides = [np.array(side.as_py(), dtype=np.int64).view(np.uint64) for side in (a, b)]
                links = np.array(_forest(*sides, most), dtype=np.uint64).reshape(-1, 2).view(np.int64)
                out.append([{"a": x, "b": y} for x, y in links.tolist()])
            yield pa.array(out, type=kind)

    verified.__annotations__ = {
        "batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]
    }
    return arrow_udf(verified, "array<struct<a: bigint, b: bigint>>")(lefts, rights)


def near_links(prints: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints ``_print`` as all pairs within ``most`` bits do.

    A fingerprint has two segments of 32 bits.  Of up to three differing bits one segment has one at
    most, so every segment value looks up its ball of radius one in the table of values, and complete
    distances are verified between the members of two matching values.  Members are
    compared in blocks of bounded size, and a block gives links to one root instead of pairs,
    so a value that many fingerprints share makes no quadratic output and no large task.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    parts = F.array(
        F.struct(F.lit(0).alias("_segment"), F.shiftrightunsigned("_print", 32).alias("_value")),
        F.struct(F.lit(1).alias("_segment"), F.col("_print").bitwiseAND(F.lit(0xFFFFFFFF)).alias("_value")),
    )
    members = prints.select("_print", F.inline(parts))
    table = stage(
        members.groupBy("_segment", "_value").agg(F.count(F.lit(1)).alias("_members")), "simhash-table"
    )
    ball = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda bit: F.col("_value").bitwiseXOR(F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), bit).cast("long")),
    )
    probes = table.select(
        F.col("_segment").alias("_s"), F.col("_value").alias("_low"), F.col("_members").alias("_n_low"), F.explode(ball).alias("_high")
    ).where(F.col("_high") > F.col("_low"))
    apart = probes.join(
        table, (F.col("_s") == F.col("_segment")) & (F.col("_high") == F.col("_value"))
    ).select("_segment", "_low", "_high", "_n_low", F.col("_members").alias("_n_high"))
    same = table.where(F.col("_members") > 1).select(
        "_segment", F.col("_value").alias("_low"), F.col("_value").alias("_high"), F.col("_members").alias("_n_low"), F.col("_members").alias("_n_high")
    )
    matches = stage(
        apart.unionByName(same)
        .withColumn("_blocks_low", F.ceil(F.col("_n_low") / BLOCK).cast("int"))
        .withColumn("_blocks_high", F.ceil(F.col("_n_high") / BLOCK).cast("int")),
        "simhash-matches",
    )
    side = lambda name: members.join(
        matches.withColumnRenamed("_segment", "_s"),
        (F.col("_segment") == F.col("_s")) & (F.col("_value") == F.col(name)),
    )
    block = lambda count: F.pmod(F.xxhash64(F.lit(7), "_print"), F.col(count)).cast("int")
    other = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    key = ["_segment", "_low", "_high", "_i", "_j"]
    own = F.col("_low") == F.col("_high")
    lows = side("_low").select("*", block("_blocks_low").alias("_i")).select("*", other("_blocks_high").alias("_j"))
    highs = side("_high").select("*", block("_blocks_high").alias("_j")).select("*", other("_blocks_low").alias("_i"))
    placed = (
        lows.where(~own | (F.col("_i") <= F.col("_j"))).select(*key, F.col("_print").alias("_left"), F.lit(None).cast("long").alias("_right"))
    ).unionByName(
        highs.where(~own | (F.col("_i") <= F.col("_j"))).select(*key, F.lit(None).cast("long").alias("_left"), F.col("_print").alias("_right"))
    )
    blocks = placed.groupBy(*key).agg(
        F.collect_list("_left").alias("_lefts"), F.collect_list("_right").alias("_rights")
    )
    return blocks.select(F.inline(_verified(F.col("_lefts"), F.col("_rights"), most))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, root``: the least node of each connected component, for every node of a link.

    Large-star and small-star steps replace links by links to smaller neighbours until every component
    is a star.  Only minima are gathered per node, and each step is staged, so a component
    or a node may be of any size and a lost executor costs one step.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stage(edges, "links")
    while True:
        turned = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        around = edges.unionByName(turned)
        least = stage(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least-neighbours")
        large = (
            join_unique(around, least, ["u"], ["v"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).where("u <> v").distinct()
        large = stage(large, "large-star")
        lowest = stage(large.groupBy("u").agg(F.min("v").alias("m")), "least-neighbours")
        small = join_unique(large, lowest, ["u"], ["v"]).select(
            F.inline(
                F.array(
                    F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                    F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                )
            )
        ).where("u <> v").distinct()
        small = stage(small, "small-star")
        # A star has each node once on the left, and no node on both sides.
        many = small.groupBy("u").count().where("count > 1").isEmpty()
        if many and small.join(small.select(F.col("v").alias("_v")), F.col("u") == F.col("_v"), "left_semi").isEmpty():
            roots = small.select("v").distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                roots.select(F.col("v").alias("node"), F.col("v").alias("root"))
            )
        edges = small


def near_duplicates(
    documents: DataFrame, size: int = SHINGLE, most: int = MOST_BITS
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document.

    Texts are lower-cased (A-Z), cut into words at ASCII white space and hashed in shingles of ``size`` words,
    repeats included; a shorter text is one shingle, and one without words (also null) has fingerprint
    zero and links like any other.  Fingerprints link at ``most`` or fewer differing bits (up
    to three); ``component_id`` is the least id that links lead to.

    Equal fingerprints are one from the start, so copies cost nothing.  A row with a null id is part of a
    component, but names it only if no other row does, as null.  Repeated rows stay.  Columns
    other than ``doc_id`` and ``text`` are ignored; an empty table gives an empty result.
    """
    hashed = stage(
        documents.select("doc_id", fingerprints(F.col("text"), size).alias("_print")), "simhash-prints"
    )
    linked = _linked(hashed, most)
    rooted = join_unique(hashed, linked.withColumnRenamed("node", "_print"), ["_print"], ["doc_id"])
    least = stage(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")), "simhash-least")
    named = join_unique(linked, least, ["root"], ["node"]).select(F.col("node").alias("_node"), "component_id")
    own = hashed.groupBy("_print").agg(F.min("doc_id").alias("_first"))
    names = stage(
        own.join(named, F.col("_print") == F.col("_node"), "left").select(
            "_print", F.coalesce("component_id", "_first").alias("component_id")
        ),
        "simhash-named",
    )
    hexed = F.lower(F.lpad(F.hex("_print"), 16, "0"))
    return join_unique(hashed, names, ["_print"], ["doc_id"]).select(
        "doc_id", hexed.alias("fingerprint"), "component_id"
    )


def _linked(hashed: DataFrame, most: int) -> DataFrame:
    prints = stage(hashed.select("_print").distinct(), "simhash-distinct")
    return stage(components(near_links(prints, most)), "simhash-linked")


def keep_one(documents: DataFrame, size: int = SHINGLE, most: int = MOST_BITS) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Groups are the components of ``near_duplicates``.  A null id comes last, and of rows with the
    same id exactly one stays, so repeated rows go too.  All columns are kept.  The documents are
    staged once with their fingerprints, which gives rows a name that stays the same.
    """
    marked = stage(
        documents.select(F.struct("*").alias("_document"), fingerprints(F.col("text"), size).alias("_print"))
        .withColumn("_row", F.monotonically_increasing_id()),
        "simhash-documents",
    )
    hashed = marked.select(F.col("_document.doc_id").alias("doc_id"), "_print", "_row")
    linked = _linked(hashed, most).withColumnRenamed("node", "_print")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    rooted = join_unique(hashed, linked, ["_print"], ["_row"], "left").withColumn(
        "_root", F.coalesce("root", "_print")
    )
    first = rooted.groupBy("_root").agg(F.min(order).alias("_first"))
    # Most documents stay, so the few that go are the side that is sent.
    others = stage(
        rooted.select("_row").join(
            first.select(F.col("_first._row").alias("_kept")), F.col("_row") == F.col("_kept"), "left_anti"
        ).select(F.col("_row").alias("_gone")),
        "simhash-gone",
    )
    return marked.join(
        broadcast_if_small(others), F.col("_row") == F.col("_gone"), "left_anti"
    ).select("_document.*")
