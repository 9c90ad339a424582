"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three letters or word borders (``FEATURES`` of them). Document frequencies cover all
learnable documents. The weights are trained by follow-the-regularised-leader with an elastic net (McMahan et al., KDD
2013) on a bounded sample: the ``per_language`` distinct texts with the smallest hash of each language. Every fifth of
them is left out of training and sets the temperature of the softmax, so that the score is a calibrated probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from hirelake.session import trimmed

UNKNOWN = "und"
FEATURE_BITS = 16
FEATURES = 1 << FEATURE_BITS
# Distinct texts per language that the weights are fitted on.
PER_LANGUAGE = 2000
# Code points handled at a time.
BLOCK = 1 << 20
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.01
EPOCHS = 3

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """How often each feature occurs in the whole text; None if it has no letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # one border after each word
    line = np.concatenate([[32], np.where(letter, points, 32)[kept], [32]]).astype(np.uint32)
    counts = np.zeros(FEATURES, dtype=np.int64)
    shift = np.uint32(32 - FEATURE_BITS)
    for at in range(0, len(line), BLOCK):
        part = line[at:at + BLOCK + 2]
        one = part[:BLOCK] * np.uint32(0x9E3779B1)
        two = (part[:-1] * np.uint32(0x85EBCA77) + part[1:] * np.uint32(0xC2B2AE3D))[:BLOCK]
        three = (part[:-2] * np.uint32(0x27D4EB2F) + part[1:-1] * np.uint32(0x165667B1)
                 + part[2:] * np.uint32(0xD3A2646D))[:BLOCK]
        for hashes in (one, two, three):
            spread = (hashes ^ hashes >> np.uint32(15)) * np.uint32(0x2C1B3C6D)
            counts += np.bincount(spread >> shift, minlength=FEATURES)
    return counts


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's TF-IDF vector of length one."""
    at = np.flatnonzero(counts)
    values = (1 + np.log(counts[at])) * idf[at]
    return at, values / np.sqrt((values * values).sum())


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, classes: int) -> np.ndarray:
    """Weights (``FEATURES`` x ``classes``) after ``EPOCHS`` passes of per-coordinate FTRL-proximal."""
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(at):
        pull = np.maximum(0, np.abs(z[at]) - L1) * -np.sign(z[at])
        return pull / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for (at, values), target in zip(examples, targets, strict=True):
            w = weights(at)
            error = _softmax(values @ w)
            error[target] -= 1
            gradient = values[:, None] * error
            squares = gradient * gradient
            z[at] += gradient - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / ALPHA * w
            n[at] += squares
    return weights(slice(None))


def temperature(logits: np.ndarray, targets: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, between 1/32 and 32, by golden-section search."""
    if not len(targets):
        return 1.0

    def loss(power: float) -> float:
        chance = _softmax(logits / 2.0**power)[np.arange(len(targets)), targets]
        return float(-np.log(np.maximum(chance, 1e-300)).mean())

    low, high, golden = -5.0, 5.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return 2.0 ** ((low + high) / 2)


@dataclass
class Model:
    """``idf`` per feature, ``weights`` of features by languages, ``temperature``; without languages all is unknown."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if self.languages else None
        if counts is None:
            return UNKNOWN, 0.0
        at, values = features(counts, self.idf)
        chances = _softmax(values @ self.weights[at] / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(chances[best])


def held_out(doc_id: Column) -> Column:
    """Ids that are kept for measuring: CRC-32 of the id as text leaves 2 when divided by 4. Null: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, documents = np.zeros(FEATURES, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                total += counts > 0
                documents += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1]), pa.array([*total[at].tolist(), documents])],
                                     names=["feature", "n"])


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = []
        for lang, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts = ngram_counts(text)
            if counts is not None:
                at = np.flatnonzero(counts)
                kept.append({"lang": lang, "mark": mark, "at": at.astype(np.uint32).tobytes(),
                             "counts": counts[at].astype(np.uint32).tobytes()})
        yield pa.RecordBatch.from_pylist(kept, pa.schema([("lang", pa.string()), ("mark", pa.int64()),
                                                          ("at", pa.binary()), ("counts", pa.binary())]))


def _fit(languages: list[str], idf: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("mark")  # by hash of the text, so languages are mixed
        examples = []
        for at, counts in zip(group["at"], group["counts"], strict=True):
            at = np.frombuffer(at, dtype=np.uint32).astype(np.int64)
            values = (1 + np.log(np.frombuffer(counts, dtype=np.uint32))) * idf[at]
            examples.append((at, values / np.sqrt((values * values).sum())))
        targets = group["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64)
        aside = np.arange(len(targets)) % 5 == 4
        weights = train([e for e, a in zip(examples, aside, strict=True) if not a], targets[~aside], len(languages))
        logits = np.array([values @ weights[at] for (at, values), a in zip(examples, aside, strict=True) if a])
        heat = temperature(logits, targets[aside])
        # The texts' features are many small blocks, which the worker would keep for all later tasks.
        del group, examples, at, counts, values
        trimmed()
        return pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "temperature": [heat]})

    return run


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from all rows of ``docs`` with a language and a letter; pass only rows that may be learnt from.

    What reaches the driver is bounded: the languages, one frequency per feature and the weights. Training is one task
    over at most ``per_language`` texts per language, each of at most ``FEATURES`` numbers.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = rows.select("text").mapInArrow(_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, counted.collect()))
    total = found.pop(-1, 0)
    frequency = np.zeros(FEATURES)
    frequency[list(found)] = list(found.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    mark = F.xxhash64("text")
    first = Window.partitionBy("lang").orderBy("mark")
    marks = rows.select("lang", mark.alias("mark")).distinct().withColumn("rank", F.row_number().over(first))
    cuts = marks.filter(F.col("rank") <= per_language).groupBy("lang").agg(F.max("mark").alias("cut")).collect()
    languages = sorted(r["lang"] for r in cuts)
    if not languages or not total:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)
    cut = F.create_map(*[x for r in cuts for x in (F.lit(r["lang"]), F.lit(r["cut"]).cast("long"))])
    sample = (
        rows.select("lang", mark.alias("mark"), "text").filter(F.col("mark") <= cut[F.col("lang")])
        .mapInArrow(_sample_features, "lang string, mark long, at binary, counts binary").dropDuplicates(["lang", "mark"])
    )
    made = sample.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fit(languages, idf), "weights binary, temperature double").collect()
    if not made:
        return Model([], idf, np.zeros((FEATURES, 0)), 1.0)
    weights = np.frombuffer(made[0]["weights"], dtype=np.float32).reshape(FEATURES, len(languages))
    return Model(languages, idf, weights, made[0]["temperature"])


def _predictions(broadcast, at: int, names: tuple[str, str], dropped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()  # in the worker of the fit, its input has been freed only now
        model = broadcast.value
        for batch in batches:
            told = [model.predict(t.as_py()) for t in batch.column(at)]
            own = batch.columns[:-1] if dropped else batch.columns
            labels = batch.schema.names[:-1] if dropped else batch.schema.names
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([x for x, _ in told], pa.string()), pa.array([x for _, x in told], pa.float64())],
                names=[*labels, *names])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text",
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep``, then ``lang_pred`` and ``score`` (0 to 1; or other ``names``), from the whole text alone.

    A null text, or one without a letter, or any text under a model without languages, is ``und`` with score 0. An empty
    table gives no rows. The model's size is bounded (features by languages), so it is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    dropped = text_col not in keep
    chosen = docs.select(*keep, *([text_col] if dropped else []))
    schema = StructType([docs.schema[c] for c in keep] + [StructField(names[0], StringType()),
                                                         StructField(names[1], DoubleType())])
    at = len(keep) if dropped else keep.index(text_col)
    return chosen.mapInArrow(_predictions(shared, at, names, dropped), schema)
