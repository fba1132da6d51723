"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf, rounds
from cinderlog.sources.staging import broadcast_if_small, stage

UNKNOWN = "und"
# Hashed counts of two- and three-byte runs.
FEATURES = 4096
# Documents that the classifiers learn from at most: of one language, and of all together.
SAMPLE = 600
SAMPLE_ALL = 6000
# Every so many of them are held out, to see how far each bit can be trusted.
_HELD_OUT = 5
# Classifiers per language beyond the exhaustive code of up to five languages.
BITS_PER_LANGUAGE = 4
# Losses closer than this make a prediction ambiguous.
MARGIN = 0.5

# Letters in lower case and non-ASCII bytes; all else is one kind of gap.
_FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)],
    dtype=np.uint32,
)


def code_matrix(languages: int, seed: int = 10) -> np.ndarray:
    """A codeword of +1 and -1 for each language; every column splits the languages in two.

    Up to five languages take all different splits.  More take random halves.
    """
    if languages < 2:
        return np.ones((languages, 1), dtype=np.int8)
    if languages <= 5:
        splits = [(1, *rest) for rest in product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(splits, dtype=np.int8).T
    random = np.random.default_rng(seed)
    columns = []
    while len(columns) < BITS_PER_LANGUAGE * languages or len(
        np.unique(np.array(columns).T, axis=0)
    ) < languages:
        column = np.ones(languages, dtype=np.int8)
        column[random.permutation(languages)[: languages // 2]] = -1
        columns.append(column)
    return np.array(columns).T


def ngram_features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the relative frequencies of hashed n-grams, one row per text."""
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    for row, text in enumerate(texts):
        if not text:
            continue
        codes = _FOLD[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
        pairs = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F)
        shift = np.uint32(32 - FEATURES.bit_length() + 2)
        counts = np.bincount(pairs >> shift, minlength=FEATURES // 2)
        more = np.bincount(triples >> shift, minlength=FEATURES // 2)
        out[row, : FEATURES // 2] = np.sqrt(counts / len(pairs))
        out[row, FEATURES // 2 :] = np.sqrt(more / max(1, len(triples)))
    return out


@dataclass
class LanguageModel:
    """Languages, their codewords, a linear classifier and a weight for each bit."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, texts: list[bytes]) -> np.ndarray:
        """Loss-weighted distance of each text to each language's codeword."""
        margins = ngram_features(texts) @ self.weights + self.bias
        agreement = margins[:, None, :] * self.codes[None, :, :]
        return (np.logaddexp(0, -agreement) * self.trust).sum(axis=2)


def fit(x: np.ndarray, languages: list[str], rounds_: int = 300) -> LanguageModel:
    """Train the bits' logistic classifiers together by full-batch Adam on ``ngram_features``.

    Every fifth row is left out of the training; a bit weighs by its share of right answers there.
    """
    names = sorted(set(languages))
    codes = code_matrix(len(names))
    at = {name: k for k, name in enumerate(names)}
    truth = (codes[[at[name] for name in languages]] > 0).astype(np.float32)
    held = np.arange(len(x)) % _HELD_OUT == _HELD_OUT - 1
    held_x, held_truth = (x[held], truth[held]) if held.any() else (x, truth)
    x, truth = x[~held], truth[~held]
    weights = np.zeros((FEATURES, codes.shape[1]), dtype=np.float32)
    bias = np.zeros(codes.shape[1], dtype=np.float32)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, bias)]
    for step in range(1, rounds_ + 1):
        wrong = (1 / (1 + np.exp(-(x @ weights + bias))) - truth) / len(x)
        grads = (x.T @ wrong + 1e-5 * weights, wrong.sum(axis=0))
        for p, (m, v), g in zip((weights, bias), moments, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    # The usual weight of a classifier in a vote, from its right answers, with one more of either kind.
    right = ((held_x @ weights + bias > 0) == (held_truth > 0)).sum(axis=0)
    trust = np.clip(0.5 * np.log((right + 1) / (len(held_x) - right + 1)), 0.05, None)
    return LanguageModel(names, codes.astype(np.float32), weights, bias, (trust / trust.mean()).astype(np.float32))


def learn(documents: DataFrame, sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> LanguageModel | None:
    """A model from at most ``sample`` documents of each language, chosen by a hash of the text.

    Rows without a text or language teach nothing; without any row there is no model.  A text
    that repeats counts once.  Whole texts are learnt from; what comes to the driver is 16 KB of n-gram
    frequencies for each of at most ``sample_all`` of them.  Languages are a list that fits the driver.
    """
    known = documents.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).where(
        F.col("text").rlike(r"\p{L}")
    )
    keyed = known.select("lang", F.xxhash64("text").alias("_key"), F.col("text").cast("binary").alias("_text"))
    # Roughly three times the sample by the hash alone, so that no task ranks a whole language.
    counts = stage(
        keyed.groupBy("lang").agg(F.approx_count_distinct("_key").alias("_texts")), "language-counts"
    )
    sample = max(1, min(sample, sample_all // max(1, counts.count())))
    chance = F.shiftrightunsigned("_key", 11).cast("double") * F.lit(2.0**-53)
    few = (
        keyed.join(broadcast_if_small(counts), "lang")
        .where(chance * F.col("_texts") < F.lit(3.0 * sample + 30))
        .groupBy("lang", "_key")
        .agg(F.min("_text").alias("_text"))
    )
    first = Window.partitionBy("lang").orderBy("_key")
    rows = (
        few.withColumn("_place", F.row_number().over(first))
        .where(F.col("_place") <= sample)
        .select("lang", "_key", _featured(F.col("_text")).alias("_x"))
        .sort("_key", "lang")
        .collect()
    )
    if not rows:
        return None
    x = np.concatenate([np.frombuffer(row["_x"], dtype=np.float32) for row in rows])
    return fit(x.reshape(-1, FEATURES), [row["lang"] for row in rows])


def _featured(text: Column) -> Column:
    def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [row.tobytes() for texts in rounds(batch) for row in ngram_features(texts)]
            yield pa.array(rows, type=pa.binary())

    featured.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(featured, "binary")(text)


def _decoded(model: LanguageModel, text: Column, margin: float) -> Column:
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names: list[str] = []
            scores: list[float] = []
            close: list[bool] = []
            for texts in rounds(batch):
                losses = model.losses(texts)
                order = np.sort(losses, axis=1)
                best = losses.argmin(axis=1)
                names += [model.languages[k] for k in best]
                odds = np.exp(order[:, :1] - losses).sum(axis=1)
                scores += (1 / odds).tolist()
                close += (order[:, 1] - order[:, 0] < margin).tolist() if losses.shape[1] > 1 else [False] * len(best)
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())],
                names=["lang_pred", "score", "ambiguous"],
            )

    decoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(decoded, "struct<lang_pred: string, score: double, ambiguous: boolean>")(text.cast("binary"))


def identify(
    documents: DataFrame, model: LanguageModel | None, margin: float = MARGIN, result: str = "language"
) -> DataFrame:
    """Add the struct column ``result``: ``lang_pred, score, ambiguous``.

    The nearest codeword wins by summed classifier losses, each weighted by how far its bit can be
    trusted; ties go to the language that sorts first.  ``score`` is the winner's share of exp(-loss) over all
    languages; ``ambiguous`` tells that the second one is closer than ``margin``.  The whole text
    is read, and nothing but the text.

    A null text, one without a letter, and any text without a model is ``und`` with score 0, not
    ambiguous.  A column with the name of ``result`` is replaced.
    """
    text = F.col("text")
    unknown = F.struct(
        F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("ambiguous")
    )
    if model is None:
        return documents.withColumn(result, unknown)
    lettered = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    return documents.withColumn(
        result, F.when(lettered, _decoded(model, text, margin)).otherwise(unknown)
    )
