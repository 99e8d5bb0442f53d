"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into buckets. Two multinomials are counted over the buckets, each over all its documents: the target's
(documents labelled good that pass the base rules) and the raw corpus's (all documents). A document's score is the mean over its n-grams
of log(target / raw), so long and short documents compare; documents below a fixed threshold go. Nothing is drawn by chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, labels_of, map_in_arrow, sized, table
from .textvec import U64, Words, buffer_of, mix, pieces, span_hash, sum_by

BITS = 16
#: Counts a bucket, in proportion to the raw corpus, that the target is smoothed with; they draw the ratio of buckets that the target
#: hardly knows towards 0, so that small targets don't hold rare n-grams against a text.
SMOOTHING = 8.0
#: Nats for an n-gram. The raw corpus holds the target, so ordinary text scores about 0 and text unlike the target far below.
LEAST_RATIO = -0.1
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def grams(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, offsets of the texts) of the words, and of the pairs of words that follow each other."""
    shift = U64(64 - BITS)
    pairs, at = words.ngrams(2)
    return [((words.hash >> shift).astype(np.int64), words.of), ((pairs >> shift).astype(np.int64), np.searchsorted(at, words.of))]


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    raw, offsets, of = words.raw, words.offsets, words.of
    n = len(offsets) - 1
    lead = words.inside & ((raw & 0xC0) != 0x80)
    chars = np.concatenate([[0], np.cumsum(lead)])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[raw])])
    # Lines: from each text's start or a line feed to the next line feed or the text's end.
    feeds = np.flatnonzero(raw == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    text = np.searchsorted(offsets, starts, "right") - 1
    # What follows a text's last line feed may be the next text's start twice: equal spans, of which one counts.
    fresh = np.diff(starts, prepend=-1) > 0
    starts, text = starts[fresh], text[fresh]
    feed = np.append(feeds, len(raw))[np.searchsorted(feeds, starts)]
    ends = np.minimum(feed, offsets[np.minimum(text + 1, n)])
    filled = (np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)) & (text < n)
    line_text = text[filled]
    key = mix(span_hash(words.sums, starts[filled], ends[filled]) ^ mix(line_text.astype(U64) + U64(1)))
    _, first = np.unique(key, return_index=True)
    again = np.bincount(line_text, minlength=n) - np.bincount(line_text[first], minlength=n)
    # Words in three-word windows that the text has twice or more.
    triples, at = words.ngrams(3)
    where = words.text_index()
    repeated = np.zeros(len(words.start) + 1, bool)
    if len(triples):
        key = mix(triples ^ mix(where[at].astype(U64) + U64(1)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hits = at[twice]
        for k in range(3):
            repeated[hits + k] = True
    covered = np.concatenate([[0], np.cumsum(repeated[:-1])])
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": chars[offsets[1:]] - chars[offsets[:-1]],
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": again.astype(np.int64),
        "n_repeat_words": covered[of[1:]] - covered[of[:-1]],
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, raw, target): what a task's documents add to the multinomials. Columns in: _trusted, text."""
    total = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for piece in pieces(batch):
            words = Words(*buffer_of(piece.column(1)))
            good = piece.column(0).to_numpy(zero_copy_only=False).astype(bool) & ~base_failed(base_counts(words))
            for ids, of in grams(words):
                total[0] += np.bincount(ids, minlength=1 << BITS)
                total[1] += np.bincount(ids[np.repeat(good, np.diff(of))], minlength=1 << BITS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "raw", "target"])


def ratios(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target / raw) of each bucket, of counts over all documents. Without a target all are 0: nothing is held against a document."""
    good = cut(labels_of(labels, "quality").where("label = 1").select("doc_id"))
    marked = docs.select("doc_id", "text").join(sized(good.withColumn("_good", F.lit(True))), "doc_id", "left").select(F.coalesce("_good", F.lit(False)).alias("_trusted"), "text")
    rows = map_in_arrow(marked, _count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = rows.column("bucket").to_numpy()
    raw[at], target[at] = rows.column("raw").to_numpy(), rows.column("target").to_numpy()
    if not target.sum():
        return np.zeros(1 << BITS)
    share = (raw + 1) / (raw.sum() + len(raw))
    extra = SMOOTHING * len(raw)
    return np.log((target + extra * share) / (target.sum() + extra)) - np.log(share)


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean"


def apply_rules(docs: DataFrame, ratio: np.ndarray, least: float = LEAST_RATIO) -> DataFrame:
    """doc_id and the columns of COLUMNS: one row per row of ``docs``, over whole texts.

    llr is 0 for a text without words. kept: not base_failed, and llr at ``least`` or above. A null text has no words. Repeated rows get
    equal results; other columns go. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                words = Words(*buffer_of(piece.column(1)))
                counts = base_counts(words)
                failed = base_failed(counts)
                total, number = np.zeros(piece.num_rows), np.zeros(piece.num_rows)
                for ids, of in grams(words):
                    total += sum_by(ratio[ids], of)
                    number += np.diff(of)
                llr = total / np.maximum(number, 1)
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, counts.values()), pa.array(failed), pa.array(llr), pa.array(~failed & (llr >= least))], names=["doc_id", *counts, "base_failed", "llr", "kept"])

    return map_in_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COLUMNS}")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply_rules(docs, ratios(docs, table(spark, sf_dir, "labels")))
