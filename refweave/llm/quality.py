"""Quality classifier: supervised subword embeddings.

Hashed words, word pairs and character n-grams have learned vectors; a document is the average of its vectors, and a softmax layer on it
tells low from high quality. Vectors and layer are trained in numpy by stochastic gradient descent on a bounded sample of labelled rows.
As average and layer are linear, a trained model scores with one number per hashed feature: its vector's product with the layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket, labelled_sample, learn_in_task, map_in_arrow, table
from .textvec import U64, Words, buffer_of, mix, pieces, span_hash, sum_by

BITS = 17
DIM = 8
CHARS = (3, 4)
#: The sample that a model learns from: rows of each label, and characters of a text at most.
PER_CLASS, MAX_CHARS = 2000, 50_000
EPOCHS, RATE = 8, 4.0
FOLDS, FOLD = 5, 0
KEEP = 0.3
SEED = 6


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashed feature, offsets of the texts) of words, of pairs of words that follow each other, and of character n-grams.

    A pair is hashed by the difference of its words' hashes, so that all pairs of equal words are one feature.
    """
    words = Words(raw, offsets)
    shift = U64(64 - BITS)
    yield (words.hash >> shift).astype(np.int64), words.of
    pair = mix(words.hash[1:] - words.hash[:-1] + U64(1)) if len(words.hash) else words.hash
    text = words.text_index()
    inside = np.flatnonzero(text[1:] == text[:-1])
    yield (pair[inside] >> shift).astype(np.int64), np.searchsorted(text[inside], np.arange(len(offsets)))
    at, after, more = words.characters()
    of = np.searchsorted(at, offsets)
    for n in CHARS:
        first = np.flatnonzero(more >= n - 1)
        grams = span_hash(words.sums, at[first], after[first + n - 1])
        yield (mix(grams + U64(n)) >> shift).astype(np.int64), np.searchsorted(first, of)


def train(texts: pa.ChunkedArray, labels: np.ndarray, sizes: dict[int, int], seed: int = SEED) -> tuple[np.ndarray, float]:
    """(number per feature, bias). The log-odds of label 1 are the mean of a text's features' numbers plus the bias; the bias is for the
    labels' own frequencies, not the sample's. Without both labels there is nothing to tell apart: all scores are the one label's."""
    seen = [int((labels == k).sum()) for k in (0, 1)]
    if not all(seen):
        return np.zeros(1 << BITS, np.float32), 0.0 if not any(seen) else (4.0 if seen[1] else -4.0)
    rows = []
    for i in range(len(labels)):
        parts = [f for f, _ in features(*buffer_of(texts.slice(i, 1)))]
        ids, counts = np.unique(np.concatenate(parts), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = [len(labels) / (2 * n) for n in seen]
    step, steps = 0, EPOCHS * len(labels)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            ids, share = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            hidden = share @ vectors[ids]
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[labels[i]]
            back = layer @ p
            layer -= 0.1 * rate * np.outer(hidden, p)
            bias -= 0.01 * rate * p
            vectors[ids] -= rate * share[:, None] * back * 10
    number = vectors @ (layer[:, 1] - layer[:, 0])
    touched = np.zeros(1 << BITS, bool)
    for ids, _ in rows:
        touched[ids] = True
    number[~touched] = 0  # a feature that was never seen says nothing
    prior = np.log(max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0)))  # the weights made both labels equally frequent
    return number.astype(np.float32), float(bias[1] - bias[0] + prior)


def score_piece(texts: pa.Array, number: np.ndarray, bias: float) -> np.ndarray:
    raw, offsets = buffer_of(texts)
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for ids, of in features(raw, offsets):
        total += sum_by(number[ids], of)
        count += np.diff(of)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def _score(number: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                score = pa.array(score_piece(piece.column(piece.num_columns - 1), number, bias))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], score], names=[*piece.schema.names[:-1], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    rows, sizes = labelled_sample(docs, labels, "quality", folds, fold, per_class, MAX_CHARS, SEED)
    return learn_in_task(rows, lambda known: train(known.column("text"), known.column("label").to_numpy(), sizes))


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """(doc_id, score): one row per row of ``docs``, in [0, 1], from the whole text.

    A null or blank text has no features: its score is that of the labels' frequencies. Repeated rows get equal scores; other columns go.
    """
    kept = docs.select("doc_id", "text")
    return map_in_arrow(kept, _score(*model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], least: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``least`` or more. A column named score is replaced."""
    from pyspark.sql import types as T

    names = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*docs.select(*names).schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                score = score_piece(piece.column(piece.schema.get_field_index("text")), *model)
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(score)], names=[*piece.schema.names, "score"]).filter(pa.array(score >= least))

    return map_in_arrow(docs.select(*names), run, schema).drop("score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == FOLD).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
