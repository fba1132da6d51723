"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.llm.batches import arrow_udf, rounds

THRESHOLD = 0.7
# Labelled documents that the classifier learns from at most, with all their passages.
SAMPLE = 3000
PASSAGE_BYTES = 512
HIDDEN, ATTENTION = 24, 16

# Byte classes: each ASCII character for itself, controls and non-ASCII bytes together.
_CLASS = np.array([0 if c < 32 and c != 10 else 1 if c >= 128 else 2 if c == 10 else c - 29 for c in range(256)])
_CLASSES = int(_CLASS.max()) + 1
_EXTRA = 8
FEATURES = _CLASSES + _EXTRA


def passages(text: bytes) -> list[bytes]:
    """The whole text in passages of nearly equal length, 512 bytes at most; an empty text is one."""
    count = max(1, -(-len(text) // PASSAGE_BYTES))
    cuts = [len(text) * k // count for k in range(count + 1)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def encode(pieces: list[bytes]) -> np.ndarray:
    """One row of numbers for each passage: byte classes, repetition, words."""
    lengths = np.array([len(piece) for piece in pieces])
    owner = np.repeat(np.arange(len(pieces)), lengths)
    codes = _CLASS[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    counts = np.bincount(owner * _CLASSES + codes, minlength=len(pieces) * _CLASSES)
    counts = counts.reshape(len(pieces), _CLASSES)
    size = np.maximum(lengths, 1)[:, None]
    out = np.zeros((len(pieces), FEATURES), dtype=np.float32)
    out[:, :_CLASSES] = np.sqrt(counts / size)
    upper = counts[:, 65 - 29 : 91 - 29].sum(axis=1)
    lower = counts[:, 97 - 29 : 123 - 29].sum(axis=1)
    for row, piece in enumerate(pieces):
        words = piece.split()
        distinct = set(words)
        out[row, _CLASSES:] = (
            len(zlib.compress(piece, 1)) / (len(piece) + 12),
            len(distinct) / max(1, len(words)),
            sum(map(bytes.__eq__, words, words[1:])) / max(1, len(words)),
            len(piece) / max(1, len(words)) / 10,
            upper[row] / max(1, upper[row] + lower[row]),
            (upper[row] + lower[row]) / size[row, 0],
            len(piece) / PASSAGE_BYTES,
            sum(map(len, distinct)) / max(1, len(piece)),
        )
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class QualityModel:
    """Encoder (``mean, scale, w, b``), gated attention (``v, u, a``) and output (``c, d``)."""

    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of documents whose passages are consecutive rows from ``starts`` on."""
        p = self.parts
        z = (x - self.mean) * self.scale
        h = np.maximum(z @ p["w"] + p["b"], 0)
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        counts = np.diff(np.append(starts, len(x)))
        top = np.repeat(np.maximum.reduceat(e, starts), counts)
        weight = np.exp(e - top)
        weight /= np.repeat(np.add.reduceat(weight, starts), counts)
        bag = np.add.reduceat(h * weight[:, None], starts, axis=0)
        score = _sigmoid(bag @ p["c"] + p["d"])
        return {"z": z, "h": h, "t": t, "g": g, "weight": weight, "bag": bag, "score": score, "counts": counts}

    def score(self, texts: list[bytes]) -> tuple[list[float], list[float]]:
        """The score of each text and the attention of its most telling passage."""
        split = [passages(text) for text in texts]
        starts = np.cumsum([0] + [len(pieces) for pieces in split[:-1]])
        state = self.forward(encode([piece for pieces in split for piece in pieces]), starts)
        return state["score"].tolist(), np.maximum.reduceat(state["weight"], starts).tolist()


def gradients(
    model: QualityModel, x: np.ndarray, starts: np.ndarray, labels: np.ndarray, weights: np.ndarray
) -> dict[str, np.ndarray]:
    """Gradient of the weighted log loss of the documents by each part of the model."""
    s, parts = model.forward(x, starts), model.parts
    wide = lambda value: np.repeat(value, s["counts"], axis=0)
    wrong = (s["score"] - labels) * weights
    bag = wrong[:, None] * parts["c"]
    h = s["weight"][:, None] * wide(bag)
    pull = (s["h"] * wide(bag)).sum(axis=1) - wide((s["bag"] * bag).sum(axis=1))
    e = s["weight"] * pull
    gate = e[:, None] * parts["a"]
    t, g = gate * s["g"] * (1 - s["t"] ** 2), gate * s["t"] * s["g"] * (1 - s["g"])
    h = (h + t @ parts["v"].T + g @ parts["u"].T) * (s["h"] > 0)
    return {
        "c": s["bag"].T @ wrong, "d": wrong.sum(), "a": (s["t"] * s["g"]).T @ e,
        "v": s["h"].T @ t, "u": s["h"].T @ g, "w": s["z"].T @ h, "b": h.sum(axis=0),
    }


def fit(x: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 400, seed: int = 3) -> QualityModel:
    """Train by full-batch Adam on document labels; classes weigh the same."""
    random = np.random.default_rng(seed)
    shapes = {
        "w": (FEATURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION),
        "a": (ATTENTION,), "c": (HIDDEN,), "d": (),
    }
    parts = {
        name: np.asarray(random.normal(0, 1 / np.sqrt(shape[0]), shape) if name in "wvuac" else np.zeros(shape))
        for name, shape in shapes.items()
    }
    model = QualityModel(x.mean(axis=0), 1 / (x.std(axis=0) + 0.02), parts)
    moments = {name: [np.zeros_like(value), np.zeros_like(value)] for name, value in parts.items()}
    good = max(1.0, labels.sum())
    weights = np.where(labels > 0, 0.5 / good, 0.5 / max(1.0, len(labels) - good))
    for step in range(1, steps + 1):
        grads = gradients(model, x, starts, labels, weights)
        for name, value in parts.items():
            m, v = moments[name]
            grad = grads[name] + 1e-5 * value
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            value -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel | None:
    """A model from at most ``sample`` labelled documents, half of either label at most.

    The sample is chosen by a hash of the ids before any text is read; whole texts are learnt from, and
    come to the driver as numbers for each passage.  Rows with a null id, label or text teach nothing; of
    several labels the lowest counts, of several documents with one id the least text.  There is no
    model unless both labels occur.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.min("quality").alias("_label"))
        .withColumn("_key", F.xxhash64("_id"))
    )
    # A bounded list of ids, so the texts are picked in one pass without a shuffle.
    chosen = [known.where(F.col("_label") == label).sort("_key", "_id").limit(sample // 2) for label in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = (
        documents.where(F.col("text").isNotNull())
        .join(ids, F.col("doc_id") == F.col("_id"))
        .groupBy("_id", "_label", "_key")
        .agg(F.min("text").alias("_text"))
        .select("_label", "_key", "_id", _encoded(F.col("_text")).alias("_x"))
        .sort("_key", "_id")
        .collect()
    )
    bags = [np.frombuffer(row["_x"], dtype=np.float32).reshape(-1, FEATURES) for row in rows]
    truth = np.array([row["_label"] for row in rows], dtype=np.float64)
    if len(set(truth.tolist())) < 2:
        return None
    starts = np.cumsum([0] + [len(bag) for bag in bags[:-1]])
    return fit(np.concatenate(bags).astype(np.float64), starts, truth)


def _encoded(text: Column) -> Column:
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for value in batch:
                out.append(encode(passages(value.as_py() or b"")).tobytes())
            yield pa.array(out, type=pa.binary())

    encoded.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(encoded, "binary")(text.cast("binary"))


def _scored(model: QualityModel, text: Column) -> Column:
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores: list[float] = []
            attention: list[float] = []
            for texts in rounds(batch):
                more = model.score(texts)
                scores += more[0]
                attention += more[1]
            yield pa.StructArray.from_arrays(
                [pa.array(scores, pa.float64()), pa.array(attention, pa.float64())], names=["score", "attention"]
            )

    scored.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return arrow_udf(scored, "struct<score: double, attention: double>")(text.cast("binary"))


def score_quality(
    documents: DataFrame, model: QualityModel | None, threshold: float = THRESHOLD, result: str = "quality"
) -> DataFrame:
    """Add the struct column ``result``: ``score, attention, predicted``.

    Every passage of the whole text is encoded; gated attention weighs the passages, and the weighted
    representation gives the score, the chance of label 1.  ``attention`` is the weight of the passage
    that tells most; ``predicted`` is 1 from ``threshold`` on.  Only the text is looked at.

    A null or empty text is one empty passage.  Without a model every score is 1, as nothing can
    be held against a document.  Repeated rows score alike.  A column with the name of ``result`` is replaced.
    """
    if model is None:
        scored = F.struct(F.lit(1.0).alias("score"), F.lit(1.0).alias("attention"))
    else:
        scored = _scored(model, F.col("text"))
    judged = documents.withColumn(result, scored)
    predicted = (F.col(result)["score"] >= threshold).cast("int")
    return judged.withColumn(
        result,
        F.struct(
            F.col(result)["score"].alias("score"),
            F.col(result)["attention"].alias("attention"),
            predicted.alias("predicted"),
        ),
    )
