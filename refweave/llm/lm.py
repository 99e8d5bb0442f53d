"""LM scoring: log-probabilities of whole documents under a gated recurrent word model and under an add-one unigram model.

1. Words of all training documents are counted (by 64-bit hash), as partial sums of tasks and then by shuffle.
2. The commonest words make the recurrent model's vocabulary; a bounded number of common words and their counts goes to all tasks.
3. The recurrent model begins on a bounded sample on the driver. Then tasks all over the cluster learn from all training documents, each on
   its own, and their changes are averaged by the number of tokens.
4. Tasks run the model over every document, its state carried from the first word to the last. Words that are not among the common ones are
   joined to their counts by shuffle and added.

A word outside the vocabulary has the model's probability of such a word, times its add-one share among all words outside: probabilities of
all known words and of one unknown add up to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import bucket, cut, map_in_arrow, sized, table, uniform
from .gru import END, OUTSIDE, Model
from .textvec import LOWER_VALUE, U64, Words, buffer_of, pieces, sum_by

FOLDS, FOLD = 7, 2
VOCABULARY = 4096
#: Common words, whose counts every task gets: 16 bytes each.
COMMON = 100_000
START_DOCS, START_PASSES, MAX_CHARS = 800, 2, 50_000
RATE = 0.1
#: Training tokens of a learner, about: enough to learn something before changes are averaged. Documents are dealt to learners by hash, so
#: that what is learned doesn't depend on how the table is stored; a row that is repeated more often than HOT is dealt over all of them.
TOKENS_A_TASK, HOT = 6_000_000, 10_000
#: Learners whose changes are added up first, before the sums are.
ADDED_FIRST = 64
#: Tokens that a task scores at once.
AT_ONCE = 2_000_000
CHUNK = 8192
SEED = 10


def count_words(docs: DataFrame) -> DataFrame:
    """(w, c): occurrences of each word hash in the documents, summed in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            w, inverse = np.unique(np.concatenate(words), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(counts), len(w)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], names=["w", "c"])

        for batch in batches:
            for piece in pieces(batch):
                w, c = np.unique(Words(*buffer_of(piece.column(0)), LOWER_VALUE).hash, return_counts=True)
                words.append(w)
                counts.append(c)
                held += len(w)
                if held > 1_500_000:
                    one = flush()
                    if one.num_rows > 750_000:
                        yield one
                        words, counts, held = [], [], 0
                    else:
                        words, counts, held = [one.column(0).to_numpy().view(U64)], [one.column(1).to_numpy()], one.num_rows
        if words:
            yield flush()

    return map_in_arrow(docs.select("text"), run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Lexicon:
    """Common words by hash, with counts; the first of them, by count, are the vocabulary (ids from 2)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, vocabulary: int, total: int, distinct: int, ends: int):
        by = np.lexsort((words, -counts))
        words, counts = words[by], counts[by]
        inside = min(len(words), vocabulary - 2)
        ids = np.full(len(words), OUTSIDE, np.int64)
        ids[:inside] = 2 + np.arange(inside)
        self.total, self.distinct, self.ends = total, distinct, ends
        outside = total - ends - int(counts[:inside].sum())
        self.id_counts = np.concatenate([[ends, outside], counts[:inside]])
        #: Add-one share of a word outside the vocabulary: (c + 1) / outside_mass.
        self.outside_mass = outside + (distinct - 1 - inside) + 1
        order = np.argsort(words)
        self.words, self.counts, self.ids = words[order], counts[order], ids[order]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the common words, whether it is one)."""
        if not len(self.words):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        k = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return k, self.words[k] == h

    def id_of(self, h: np.ndarray) -> np.ndarray:
        k, known = self.find(h)
        return np.where(known, self.ids[k] if len(self.ids) else OUTSIDE, OUTSIDE)

    def token_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and ends, documents end to end, and their offsets."""
        words = Words(*buffer_of(texts), LOWER_VALUE)
        return self.with_ends(self.id_of(words.hash), words.of, END)

    @staticmethod
    def with_ends(values: np.ndarray, of: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        return np.insert(values, of[1:], end), of + np.arange(len(of))


def make_lexicon(counts: DataFrame, training: DataFrame, vocabulary: int = VOCABULARY, common: int = COMMON) -> Lexicon:
    """Totals over all counts; the common words are all above a count that at most ``common`` words reach."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = training.count()
    steps = counts.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()  # under 512 rows
    held, least = 0, None
    for row in steps:
        if held + row["n"] > common:
            break
        held, least = held + row["n"], row["least"]
    if least is None:
        rows = counts.limit(0).toArrow()
    else:
        rows = counts.where(F.col("c") >= least).toArrow()
    # The end is a token of its own: one more distinct one, if there is any.
    return Lexicon(rows.column("w").to_numpy().view(U64), rows.column("c").to_numpy(), vocabulary, int(whole[0]) + ends, int(whole[1]) + (ends > 0), ends)


def start_model(training: DataFrame, lexicon: Lexicon) -> Model:
    model = Model(lexicon.id_counts, SEED)
    n = training.count()
    sample = training.where(uniform(SEED, F.col("doc_id")) < min(1.0, START_DOCS / max(1, n))).where(F.length("text") <= MAX_CHARS)
    rows = sample.select("doc_id", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    if rows.num_rows:
        tokens, of = lexicon.token_ids(rows.column("text"))
        for k in range(START_PASSES):
            model.learn(tokens, of, RATE / (1 + k))
    return model


def learn_everywhere(training: DataFrame, lexicon: Lexicon, model: Model) -> Model:
    """Averages, by tokens, what learners, starting from ``model``, learn from all training documents (doc_id, text) between them."""
    start = model.flat()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(lexicon.id_counts, SEED)
        own.load(start)
        n, tokens, sizes, held = 0, [], [], 0

        def step() -> int:
            return own.learn(np.concatenate(tokens), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), RATE / 2)

        for batch in batches:
            for piece in pieces(batch):
                t, of = lexicon.token_ids(piece.column(0))
                tokens.append(t)
                sizes.append(np.diff(of))
                held += len(t)
                if held > AT_ONCE // 2:
                    n += step()
                    tokens, sizes, held = [], [], 0
        if held:
            n += step()
        if n:
            change = (own.flat() - start) * np.float32(n)
            parts = range(0, len(change), CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array([a // CHUNK for a in parts], pa.int32()), pa.array([n] * len(parts), pa.int64()), pa.array([change[a : a + CHUNK].tolist() for a in parts], pa.list_(pa.float32()))], names=["chunk", "n", "change"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        seen: dict[int, int] = {}
        for batch in batches:
            chunks, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, k in enumerate(chunks):
                value = batch.column(2)[i].values.to_numpy().astype(np.float64)
                total[k] = total[k] + value if k in total else value
                seen[k] = seen.get(k, 0) + ns[i]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(seen.values()), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["chunk", "n", "change"])

    tasks = max(1, -(-lexicon.total // TOKENS_A_TASK))
    keyed = training.select(F.xxhash64("doc_id", "text").alias("_key"), "text")
    often = cut(keyed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select("_key"))  # few: each stands for many rows
    salted = keyed.join(sized(often.withColumn("_often", F.lit(True))), "_key", "left").withColumn("_salt", F.when(F.col("_often"), F.floor(F.rand(SEED) * tasks)).otherwise(0))
    dealt = salted.repartition(tasks, "_key", "_salt").sortWithinPartitions("_key").select("text")
    changed = "chunk int, n long, change array<double>"
    learned = map_in_arrow(dealt, learn, "chunk int, n long, change array<float>").withColumn("_some", F.spark_partition_id() % ADDED_FIRST)
    added = map_in_arrow(learned.repartition("chunk", "_some").select("chunk", "n", "change"), add, changed)
    rows = map_in_arrow(added.repartition("chunk"), add, changed).toArrow()
    flat = start.astype(np.float64)
    for k, n, change in zip(rows.column("chunk").to_pylist(), rows.column("n").to_pylist(), rows.column("change")):
        flat[k * CHUNK : k * CHUNK + len(change)] += change.values.to_numpy() / n
    out = Model(lexicon.id_counts, SEED)
    out.load(flat.astype(np.float32))
    return out


def _score(lexicon: Lexicon, model_flat: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(lexicon.id_counts, SEED)
        model.load(model_flat)
        smooth = lexicon.total + lexicon.distinct + 1
        doc_ids, tokens, sizes, parts, rare, rare_sizes, held = [], [], [], [], [], [], 0

        def finish() -> pa.RecordBatch:
            t, size = np.concatenate(tokens), np.concatenate(sizes)
            of = np.concatenate([[0], np.cumsum(size)])
            part = np.concatenate(parts, axis=1)
            lp = sum_by(model.score(t, of), of) + part[2]
            flat = pa.array(np.concatenate(rare).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(rare_sizes))]).astype(np.int32)), flat)
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays(doc_ids), pa.array(size.astype(np.int64)), pa.array(part[0].astype(np.int64)), pa.array(part[1] / log(10)), pa.array(lp / log(10)), lists],
                names=["doc_id", "n_tokens", "_known", "_base", "_score", "_rare"],
            )

        for batch in batches:
            for piece in pieces(batch):
                words = Words(*buffer_of(piece.column(1)), LOWER_VALUE)
                place, common = lexicon.find(words.hash)
                counts = np.where(common, lexicon.counts[place] if len(lexicon.counts) else 0, 0)
                ids = np.where(common, lexicon.ids[place] if len(lexicon.ids) else OUTSIDE, OUTSIDE)
                base = np.where(common, np.log((counts + 1) / smooth), 0.0)
                extra = np.where(common & (ids == OUTSIDE), np.log((counts + 1) / lexicon.outside_mass), 0.0)
                end_base = log((lexicon.ends + 1) / smooth)
                t, of = lexicon.with_ends(ids, words.of, END)
                doc_ids.append(piece.column(0))
                tokens.append(t.astype(np.int32))
                sizes.append(np.diff(of))
                parts.append(np.stack([sum_by(common.astype(np.int64), words.of) + (lexicon.ends > 0), sum_by(base, words.of) + end_base, sum_by(extra, words.of)]))
                rare.append(words.hash[~common])
                rare_sizes.append(sum_by((~common).astype(np.int64), words.of))
                held += len(t)
                if held > AT_ONCE:
                    yield finish()
                    doc_ids, tokens, sizes, parts, rare, rare_sizes, held = [], [], [], [], [], [], 0
        if held:
            yield finish()

    return run


def score_documents(docs: DataFrame, folds: int = FOLDS, fold: int = FOLD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``, over whole texts.

    Tokens are the words, ASCII letters lower-cased, and one end. A null or blank text is an end alone. Rows whose id falls in the held-out
    fold are scored but not learned from; null ids hash as empty text. Repeated rows count as often as they occur, and score alike. Other
    columns go. An empty table gives an empty result.
    """
    out = bucket(F.col("doc_id"), folds) == fold
    training = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~out)
    counts = cut(count_words(training))
    lexicon = make_lexicon(counts, training)
    model = learn_everywhere(training, lexicon, start_model(training, lexicon))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = map_in_arrow(docs.select("doc_id", "text"), _score(lexicon, model.flat()), f"doc_id {id_type}, n_tokens long, _known long, _base double, _score double, _rare array<long>")
    scored = cut(scored.withColumn("_row", F.monotonically_increasing_id()))  # cut, so a row keeps its number
    rare = scored.select("_row", F.explode("_rare").alias("w")).groupBy("_row", "w").agg(F.count("*").alias("_tf"))
    found = rare.join(counts, "w", "left").select("_row", "_tf", F.coalesce("c", F.lit(0)).alias("_c"))
    smooth, mass = float(lexicon.total + lexicon.distinct + 1), float(lexicon.outside_mass)
    added = found.groupBy("_row").agg(
        F.sum(F.when(F.col("_c") > 0, F.col("_tf")).otherwise(0)).alias("_k"),
        F.sum(F.col("_tf") * F.log10((F.col("_c") + 1) / smooth)).alias("_b"),
        F.sum(F.col("_tf") * F.log10((F.col("_c") + 1) / mass)).alias("_s"),
    )
    zero = F.lit(0.0)
    return scored.join(added, "_row", "left").select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        (F.col("_known") + F.coalesce("_k", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_b", zero)).alias("base_score"),
        (F.col("_score") + F.coalesce("_s", zero)).alias("score"),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
