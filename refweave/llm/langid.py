"""Language identification with a byte convolutional network, in numpy.

A window of bytes becomes learned byte vectors; filters of several widths slide over them, each filter's greatest value in the window
counts, and a softmax layer turns those into languages. It learns from labelled windows by Adam. A document is cut into windows of one
fixed length that cover all of it; its language is the one with the greatest sum of probabilities, each weighing as much as its window holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket, cut, learn_in_task, map_in_arrow, pick, sized, table
from .textvec import buffer_of, pieces

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS, DIM = 8, 8
STEP = WINDOW - max(WIDTHS) + 1
#: The sample to learn from: documents of a language, and windows of a document (spread over it).
PER_LANGUAGE, PER_DOCUMENT, MAX_CHARS = 600, 4, 50_000
EPOCHS, BATCH, RATE = 5, 64, 0.01
FOLDS, FOLD = 4, 2
UNKNOWN = "und"
SEED = 3
#: Windows that go through the filters at once: what they need stays in a core's cache.
AT_ONCE = 64


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each window, number of windows of each text): steps of STEP, so that each filter position of a text is in one window."""
    size = np.diff(offsets)
    number = np.maximum(1, -(-(size - (WINDOW - STEP)) // STEP))
    of = np.concatenate([[0], np.cumsum(number)])
    text = np.repeat(np.arange(len(size)), number)
    return offsets[text] + STEP * (np.arange(of[-1]) - of[text]), number


def cut_windows(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """windows x WINDOW bytes; beyond the text's end zeros."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], raw[np.minimum(at, len(raw) - 1)] if len(raw) else np.uint8(0), np.uint8(0))


class Network:
    def __init__(self, languages: list[str], rng: np.random.Generator):
        self.languages = languages
        deep = max(WIDTHS)
        self.bytes = rng.normal(0, 0.3, (256, DIM)).astype(np.float32)
        self.filters = rng.normal(0, 0.25, (deep * DIM, FILTERS * len(WIDTHS))).astype(np.float32)
        self.reach = np.zeros_like(self.filters)  # a narrow filter doesn't see the last bytes
        for k, width in enumerate(WIDTHS):
            self.reach[: width * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters *= self.reach
        self.bias = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.out = rng.normal(0, 0.2, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def stacked(self, x: np.ndarray) -> np.ndarray:
        """windows x positions x (vectors of the bytes that a filter sees there)."""
        v = self.bytes[x]
        return np.concatenate([v[:, k : k + STEP] for k in range(max(WIDTHS))], axis=2)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Greatest filter values of the windows, negative ones as 0."""
        out = np.empty((len(x), self.filters.shape[1]), np.float32)
        for at in range(0, len(x), AT_ONCE):
            seen = self.stacked(x[at : at + AT_ONCE])
            out[at : at + AT_ONCE] = (seen.reshape(-1, seen.shape[2]) @ self.filters).reshape(len(seen), STEP, -1).max(axis=1)
        return np.maximum(out + self.bias, 0)

    def log_probability(self, pooled: np.ndarray) -> np.ndarray:
        z = pooled @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def learn(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        held = [self.bytes, self.filters, self.bias, self.out, self.out_bias]
        m, s, t = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held], 0
        steps = EPOCHS * -(-len(x) // BATCH)
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                i = order[at : at + BATCH]
                seen = self.stacked(x[i])
                raw = seen @ self.filters
                top = raw.argmax(axis=1)
                value = np.take_along_axis(raw, top[:, None, :], 1)[:, 0] + self.bias
                pooled = np.maximum(value, 0)
                d = np.exp(self.log_probability(pooled))
                d[np.arange(len(i)), y[i]] -= 1
                d *= (weight[y[i]] / len(i))[:, None].astype(np.float32)
                back = (d @ self.out.T) * (value > 0)
                chosen = seen[np.arange(len(i))[:, None], top]  # windows x filters x what each saw
                g_filters = np.einsum("nfd,nf->df", chosen, back) * self.reach
                g_seen = back[:, :, None] * self.filters.T[None]
                g_bytes = np.zeros_like(self.bytes)
                for k in range(max(WIDTHS)):
                    np.add.at(g_bytes, x[i][np.arange(len(i))[:, None], top + k], g_seen[:, :, k * DIM : (k + 1) * DIM])
                t += 1
                rate = RATE * (1 - (t - 1) / steps)
                for k, g in enumerate([g_bytes, g_filters, back.sum(axis=0), pooled.T @ d, d.sum(axis=0)]):
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    held[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, offsets = buffer_of(texts)
        lettered = has_letter(texts, raw, offsets)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        starts, number = windows(raw, offsets)
        ends = np.repeat(offsets[1:], number)
        logs = np.concatenate([self.log_probability(self.pooled(cut_windows(raw, starts[a : a + 4096], ends[a : a + 4096]))) for a in range(0, len(starts), 4096)]) if len(starts) else np.zeros((0, len(self.languages)))
        share = np.minimum(ends - starts, WINDOW) / WINDOW
        first = np.concatenate([[0], np.cumsum(number)])[:-1]
        total = np.add.reduceat(np.exp(logs) * share[:, None], first, axis=0) if len(number) else logs
        p = total
        best = total.argmax(axis=1) if len(total) else np.zeros(0, int)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), lettered.tolist())], np.where(lettered, p.max(axis=1) / np.maximum(p.sum(axis=1), 1e-300), 0.0) if len(p) else np.zeros(0)


_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])


def has_letter(texts: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = np.concatenate([[0], np.cumsum(_LETTER[raw])])
    out = found[offsets[1:]] > found[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return out


def train(texts: pa.ChunkedArray, langs: list[str], seed: int = SEED) -> Network:
    """A network for the languages that occur, in order of name; each weighs the same."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    network = Network(languages, rng)
    raw, offsets = buffer_of(texts)
    starts, number = windows(raw, offsets)
    of = np.concatenate([[0], np.cumsum(number)])
    chosen = np.concatenate([of[i] + np.unique(np.linspace(0, number[i] - 1, PER_DOCUMENT).round().astype(int)) for i in range(len(number)) if offsets[i + 1] > offsets[i]] or [np.zeros(0, int)])
    text = np.searchsorted(of, chosen, "right") - 1
    x = cut_windows(raw, starts[chosen], offsets[text + 1])
    y = np.array([languages.index(langs[i]) for i in text], int)
    if len(languages) > 1 and len(x):
        count = np.bincount(y, minlength=len(languages))
        network.learn(x, y, len(y) / (len(languages) * np.maximum(count, 1)), rng)
    return network


def fit(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD, per_language: int = PER_LANGUAGE) -> Network:
    """Learns from a bounded hash sample of the documents outside the held-out fold that have a text and a language."""
    known = docs.where("lang is not null and text is not null").where(bucket(F.col("doc_id"), folds) != fold)
    ids = cut(pick(known.where(F.length("text") <= MAX_CHARS).select("doc_id", "lang"), "lang", per_language, SEED))
    rows = known.select("doc_id", "text").join(sized(ids.dropDuplicates(["doc_id"])), "doc_id").where(F.length("text") <= MAX_CHARS)
    return learn_in_task(rows, lambda known: train(known.column("text"), known.column("lang").to_pylist()))


def identify(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, lang_pred, score): one row per row of ``docs``, from the whole text.

    A null text, or one without a letter, is 'und' with score 0. score: the language's share of the probability. Equally likely languages:
    the first by name. If nothing was learned all are 'und'. Repeated rows get equal results; other columns go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                lang, score = network.predict(piece.column(1))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (bucket(F.col("doc_id"), FOLDS) == FOLD).alias("held_out"), "lang_pred", "score")
