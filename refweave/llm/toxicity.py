"""Toxicity: a factorization machine over hashed terms.

Score = sigmoid(bias + sum of weights + sum over pairs of terms of the products of their factors); the pairs say what neither term alone
does, such as an insult beside the mention of a group. The sum over pairs is half the square of the summed factors less the summed squares.
A term is a run of letters and digits, ASCII letters lower-cased; its first code points are terms too, which is what inflected and
compounded words share. A document has a term or not; how often does not count.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket, labelled_sample, learn_in_tasks, map_in_arrow, table
from .textvec import LOWER_VALUE, NOT_TERM, U64, Words, buffer_of, mix, pieces, span_hash, sum_by

BITS = 18
FACTORS = 4
#: Lengths of the prefixes, in code points, of terms longer than that.
PREFIXES = (4, 5)
PER_CLASS, MAX_CHARS = 3000, 50_000
EPOCHS, RATE = 20, 0.3
#: A weight is drawn to zero by so many deviations of the mean gradient that a term of its number of documents has by chance; a factor likewise.
SHRINK, SHRINK_PAIRS = 2.0, 2.5
#: A term takes part if so many sampled documents have it. Whether it says anything, alone or in a pair, is for learning to find.
LEAST_DOCS = 2
FOLDS, FOLD = 5, 0
CUT = 0.5
SEED = 7


def terms(raw: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text (only those that ``known`` marks), end to end; n + 1 offsets."""
    words = Words(raw, offsets, LOWER_VALUE, NOT_TERM)
    shift = U64(64 - BITS)
    text = words.text_index()
    ids, of = [(words.hash >> shift).astype(np.int64)], [text]
    at, after, more = words.characters()
    word = np.searchsorted(words.start, at, "right") - 1
    head = np.flatnonzero(np.diff(word, prepend=-1) != 0)
    for n in PREFIXES:
        long = head[more[head] >= n]
        ids.append((mix(span_hash(words.sums, at[long], after[long + n - 1]) + U64(n)) >> shift).astype(np.int64))
        of.append(text[word[long]])
    ids, of = np.concatenate(ids), np.concatenate(of)
    if known is not None:
        keep = known[ids]
        ids, of = ids[keep], of[keep]
    both = np.unique(of << BITS | ids)
    of = both >> BITS
    return both & ((1 << BITS) - 1), np.searchsorted(of, np.arange(len(offsets)))


class Machine:
    """A score is the sigmoid of ``slope`` * odds + ``shift``."""

    def __init__(self, weight: np.ndarray, factor: np.ndarray, known: np.ndarray, bias: float, slope: float = 1.0, shift: float = 0.0):
        self.weight, self.factor, self.known, self.bias = weight, factor, known, bias
        self.slope, self.shift = slope, shift

    def odds(self, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = sum_by(self.weight[ids], of) + self.bias
        for k in range(self.factor.shape[1]):
            f = self.factor[ids, k]
            total = total + 0.5 * (sum_by(f, of) ** 2 - sum_by(f * f, of))
        return total

    def score(self, texts: pa.Array) -> np.ndarray:
        odds = self.odds(*terms(*buffer_of(texts), self.known))
        return 1 / (1 + np.exp(-np.clip(self.slope * odds + self.shift, -30, 30)))


def calibrate(odds: np.ndarray, labels: np.ndarray, sizes: dict[int, int]) -> tuple[float, float]:
    """(slope, shift) of the logistic curve through odds of documents that were not learned from, by Newton steps. Each label's documents
    weigh together what ``sizes`` says; targets are (n + 1) / (n + 2), so that separable odds have a finite slope."""
    seen = np.array([(labels == k).sum() for k in (0, 1)])
    much = np.array([max(1, sizes.get(k, 0)) for k in (0, 1)]) / seen
    target = np.where(labels == 1, (seen[1] + 1) / (seen[1] + 2), 1 / (seen[0] + 2))
    weigh = much[labels] / much[labels].sum()
    x = np.stack([odds, np.ones(len(odds))])
    at = np.array([0.0, np.log(much[1] * seen[1] / (much[0] * seen[0]))])

    def loss(p: np.ndarray) -> float:
        v = p @ x
        return float((weigh * (np.logaddexp(0, v) - target * v)).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(at @ x, -30, 30)))
        g = x @ (weigh * (p - target))
        step = np.linalg.solve((x * (weigh * p * (1 - p))) @ x.T + 1e-9 * np.eye(2), g)
        now = loss(at)
        while loss(at - step) > now and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() < 1e-7:
            break
    return max(0.0, float(at[0])), float(at[1])


def descend(rows: list[np.ndarray], labels: np.ndarray, seed: int) -> Machine:
    """Stochastic gradient descent with per-parameter rates (squared gradients summed), both labels weighing the same. Weights are averaged
    duals: a term keeps none while its summed gradients stay within ``SHRINK``; its factors shrink at each step."""
    seen = [int((labels == k).sum()) for k in (0, 1)]
    docs = np.bincount(np.concatenate(rows), minlength=1 << BITS)
    known = docs >= LEAST_DOCS
    place, n, docs = np.cumsum(known) - 1, int(known.sum()), docs[known]
    rows = [place[r[known[r]]] for r in rows]  # the arrays of learning hold the known terms alone
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(n, np.float32), rng.normal(0, 0.01, (n, FACTORS)).astype(np.float32)
    weight2, factor2, bias, bias2 = np.full(n, 1e-2, np.float32), np.full((n, FACTORS), 1e-2, np.float32), 0.0, 1e-2
    share = seen[1] / len(labels)
    chance = (0.25 / np.sqrt(share * (1 - share) * docs)).astype(np.float32)
    dual, visits = np.zeros(n, np.float32), docs.astype(np.float32)
    balance = [len(labels) / (2 * n) for n in seen]
    for _ in range(EPOCHS):
        for i in rng.permutation(len(labels)):
            ids = rows[i]
            f, chances = factor[ids], chance[ids]
            total = f.sum(axis=0)
            odds = float(bias + weight[ids].sum() + 0.5 * ((total * total).sum() - np.vdot(f, f)))
            g = float((1 / (1 + np.exp(-min(30.0, max(-30.0, odds)))) - labels[i]) * balance[labels[i]])
            squares, summed, seen_by = weight2[ids] + g * g, dual[ids] + g, visits[ids] + 1
            weight2[ids], dual[ids], visits[ids] = squares, summed, seen_by
            left = np.maximum(np.abs(summed) - SHRINK * chances * seen_by, 0)
            weight[ids] = np.copysign(RATE * left / np.sqrt(squares), -summed)
            others = total - f
            gf = g * others
            squares = factor2[ids]
            squares += gf * gf
            factor2[ids] = squares
            step = 0.1 * RATE / np.sqrt(squares)
            f -= step * gf
            step *= np.abs(others)
            step *= (SHRINK_PAIRS * chances)[:, None]
            factor[ids] = np.copysign(np.maximum(np.abs(f) - step, 0), f)
            bias2 += g * g
            bias -= RATE * g / bias2**0.5
    all_weights, all_factors = np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32)
    all_weights[known], all_factors[known] = weight, factor
    return Machine(all_weights, all_factors, known, float(bias))


class Sample:
    """What there is to learn from: distinct terms of each text, labels, and the half that a text's hash puts it in (equal texts share one)."""

    def __init__(self, texts: pa.ChunkedArray, labels: np.ndarray):
        self.labels = np.asarray(labels).astype(np.int64)
        self.rows = [terms(*buffer_of(texts.slice(i, 1)))[0] for i in range(len(self.labels))]
        self.half = np.array([crc32((t or "").encode()) & 1 for t in texts.to_pylist()], np.int64)

    def seen(self) -> list[int]:
        return [int((self.labels == k).sum()) for k in (0, 1)]

    def whole(self, seed: int) -> Machine:
        """A machine of all texts, not calibrated. With one label only, or none, all scores are that label's (none: 0)."""
        seen = self.seen()
        if all(seen):
            return descend(self.rows, self.labels, seed)
        return Machine(np.zeros(1 << BITS, np.float32), np.zeros((1 << BITS, FACTORS), np.float32), np.zeros(1 << BITS, bool), 4.0 if seen[1] else -4.0)

    def across(self, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(odds, labels) of one half's texts from a machine of the other half, ``k``; none where a half lacks a label."""
        if len(np.unique(2 * self.half + self.labels)) < 4:
            return np.zeros(0), np.zeros(0, np.int64)
        mine, others = np.flatnonzero(self.half == k), np.flatnonzero(self.half != k)
        one = descend([self.rows[i] for i in mine], self.labels[mine], seed)
        kept = [self.rows[i][one.known[self.rows[i]]] for i in others]
        return one.odds(np.concatenate(kept), np.cumsum([0, *map(len, kept)])), self.labels[others]


def calibrated(machine: Machine, seen: list[int], parts: list[tuple[np.ndarray, np.ndarray]], sizes: dict[int, int]) -> Machine:
    """The machine, calibrated on what two others, of a half each, said of the other half. Where a half lacks a label, the labels' frequencies
    shift the odds instead; with one label only nothing does."""
    odds, labels = (np.concatenate(x) for x in zip(*parts))
    if len(odds):
        machine.slope, machine.shift = calibrate(odds, labels, sizes)
    elif all(seen):
        machine.shift = float(np.log(max(1, sizes.get(1, 0)) / max(1, sizes.get(0, 0))))
    return machine


def train(texts: pa.ChunkedArray, labels: np.ndarray, sizes: dict[int, int], seed: int = SEED) -> Machine:
    """The three machines one after the other, in this process."""
    sample = Sample(texts, labels)
    return calibrated(sample.whole(seed), sample.seen(), [sample.across(k, seed) for k in (0, 1)], sizes)


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = FOLD, per_class: int = PER_CLASS) -> Machine:
    """The three machines, each in a task of its own."""
    rows, sizes = labelled_sample(docs, labels, "toxic", folds, fold, per_class, MAX_CHARS, SEED)

    def sample(known: pa.Table) -> Sample:
        return Sample(known.column("text"), known.column("label").to_numpy())

    def whole(known: pa.Table) -> tuple[Machine, list[int]]:
        of = sample(known)
        return of.whole(SEED), of.seen()

    (machine, seen), *parts = learn_in_tasks(rows, [whole, lambda known: sample(known).across(0, SEED), lambda known: sample(known).across(1, SEED)])
    return calibrated(machine, seen, parts, sizes)


def score_toxicity(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score): one row per row of ``docs``, in [0, 1], from the whole text.

    A null text, or one without a term known from learning, scores what the bias says. Repeated rows get equal scores; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(machine.score(piece.column(1)))], names=["doc_id", "score"])

    return map_in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == FOLD).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
