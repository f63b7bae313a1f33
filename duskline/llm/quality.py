"""Quality scores: random-indexing word vectors, pooled, and a two-layer network.

Every word has a sparse random index vector; its word vector sums the index vectors of the words
around it in the sample, so that words of like contexts are alike. A document is the mean of the
vectors of its words and of its punctuation runs, with a few shares (upper case, punctuation,
repeats). A network of one hidden layer, written in numpy, scores it; a temperature fitted on rows
that it was not trained on calibrates the probabilities.

The fit sees at most SAMPLE labelled rows; scoring sees every text whole.

Defined cases: null and empty texts are scored like any other, by all-zero means; without labelled
rows every score is 0.5; with one label alone, that label's smoothed share; repeated rows are scored
one by one; an empty table gives no rows; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import fold, sample
from .tables import give_back, shared
from .textbytes import Words, column_bytes, letters_and_digits, steps, words_of

MODULUS, HELD_OUT = 3, 1
SAMPLE = 6_000
SLOTS, WIDTH, NONZERO, REACH = 1 << 15, 32, 4, 2
HIDDEN, EPOCHS, BATCH = 48, 30, 128


def punctuation() -> np.ndarray:
    table = np.zeros(256, bool)
    table[33:48] = table[58:65] = table[91:97] = table[123:127] = True
    return table


@dataclass
class Model:
    vectors: np.ndarray
    marks: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None


def _slots(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - 15)).astype(np.int64)


def _rows(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.rows) - 1), np.diff(words.rows))


def _index(rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    return rng.integers(0, WIDTH, (SLOTS, NONZERO)), rng.choice([-1.0, 1.0], (SLOTS, NONZERO))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def random_indexing(parts: list[Words], seed: int) -> np.ndarray:
    """Word vectors by slot: contexts in the sample, and a share of the own index vector."""
    place, sign = _index(np.random.default_rng(seed))
    context = np.zeros(SLOTS * WIDTH)
    for words in parts:
        slots, rows = _slots(words), _rows(words)
        for distance in range(1, REACH + 1):
            a, b = slots[:-distance], slots[distance:]
            same = rows[:-distance] == rows[distance:]
            for left, right in ((a[same], b[same]), (b[same], a[same])):
                for k in range(NONZERO):
                    context += np.bincount(left * WIDTH + place[right, k], sign[right, k], SLOTS * WIDTH)
    own = np.zeros((SLOTS, WIDTH))
    for k in range(NONZERO):
        np.add.at(own, (np.arange(SLOTS), place[:, k]), sign[:, k])
    return (_unit(context.reshape(SLOTS, WIDTH)) + 0.5 * _unit(own)).astype(np.float32)


def _pool(words: Words, vectors: np.ndarray) -> np.ndarray:
    """The mean vector of the words of each row; zeros without words."""
    counts = np.diff(words.rows)
    out = np.zeros((len(counts), vectors.shape[1]))
    full = np.flatnonzero(counts)
    if len(full):
        # Rows lie one after the other, so those without words take no place.
        sums = np.add.reduceat(vectors[_slots(words)], words.rows[:-1][full], axis=0)
        out[full] = sums / counts[full, None]
    return out


def _share(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def features(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray, marks: np.ndarray) -> np.ndarray:
    words, runs = words_of(data, offsets, letters_and_digits()), words_of(data, offsets, punctuation())
    pooled, marked = _pool(words, vectors), _pool(runs, marks)
    raw, bounds = data[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]
    counts = np.diff(words.rows)
    rows = _rows(words)
    again = np.zeros(len(rows), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((words.hashes, rows))
    sorted_ = words.hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (sorted_[1:] != sorted_[:-1]) | (rows[1:] != rows[:-1])
    lengths = np.append(0, np.cumsum(words.ends - words.starts))
    shares = [
        _share((raw >= 65) & (raw <= 90), bounds),
        _share((raw >= 48) & (raw <= 57), bounds),
        _share(punctuation()[raw], bounds),
        _share(raw == 10, bounds),
        _share(again, words.rows),
        _share(new, words.rows),
        np.log1p(counts),
        np.diff(runs.rows) / np.maximum(counts, 1),
        (lengths[words.rows[1:]] - lengths[words.rows[:-1]]) / np.maximum(counts, 1),
        np.linalg.norm(pooled, axis=1),
        np.linalg.norm(marked, axis=1),
    ]
    return np.column_stack([pooled, marked, *shares])


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3]


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    layers = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    first, second = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            hidden, logit = _forward(x[rows], layers)
            error = (_sigmoid(logit) - y[rows]) / len(rows)
            back = np.outer(error, layers[2]) * (1 - hidden**2)
            slopes = [x[rows].T @ back + 1e-4 * layers[0], back.sum(0), hidden.T @ error + 1e-4 * layers[2], error.sum(keepdims=True)]
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope**2
                rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                layers[k] = layers[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return layers


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss."""
    if not len(y):
        return 1.0
    tried = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    sign = np.where(y == 1, 1, -1)
    return float(min(tried, key=lambda t: np.logaddexp(0, -sign * logit / t).mean()))


def _blocks(texts: list[str]):
    data, offsets = column_bytes(pa.array(texts, pa.large_string()))
    for first, last in steps(offsets):
        yield data, offsets[first : last + 1]


def fit(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    rng, y = np.random.default_rng(seed), np.array(labels, float)
    blocks = list(_blocks(texts))
    vectors = random_indexing([words_of(d, o, letters_and_digits()) for d, o in blocks], seed + 1)
    marks = random_indexing([words_of(d, o, punctuation()) for d, o in blocks], seed + 2)
    if len(set(labels)) < 2:
        constant = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        none = np.zeros(0)
        return Model(vectors, marks, none, none, [], 1.0, float(constant))
    x = np.concatenate([features(d, o, vectors, marks) for d, o in blocks])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / scale
    checked = rng.random(len(y)) < 0.15
    layers = _train(x[~checked], y[~checked], rng)
    temperature = _temperature(_forward(x[checked], layers)[1], y[checked])
    return Model(vectors, marks, mean, scale, layers, temperature)


def predict(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(offsets) - 1, model.constant)
    x = (features(data, offsets, model.vectors, model.marks) - model.mean) / model.scale
    return _sigmoid(_forward(x, model.layers)[1] / model.temperature)


def scorer(model: Model, text: int):
    """A function of batches that gives their scores; `text` is the place of the text column."""

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        data, offsets = column_bytes(batch.column(text))
        parts = [predict(model, data, offsets[a : b + 1]) for a, b in steps(offsets)]
        return np.concatenate(parts) if parts else np.zeros(0)

    return scores


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    model = fit(*sample(docs, labels, "quality", MODULUS, HELD_OUT, SAMPLE))
    give_back()
    return model


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`."""
    model = shared(docs.sparkSession, trained(docs, labels))

    def run(batches):
        scores = scorer(model(), 1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores(batch))], names=["doc_id", "score"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return source.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(fold(MODULUS) == HELD_OUT, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score 0.5 or more."""
    model = shared(docs.sparkSession, trained(docs, labels))
    place = docs.columns.index("text")

    def run(batches):
        scores = scorer(model(), place)
        for batch in batches:
            yield batch.filter(pa.array(scores(batch) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
