"""What the operators of this subpackage share: row keys, hash samples, and the library's helpers."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from . import textvec
from ..shared import BROADCAST_ROWS, cut, shared_folder, sized, table

__all__ = ["BROADCAST_ROWS", "SPACES", "bucket", "cut", "labelled_sample", "labels_of", "learn_in_task", "learn_in_tasks", "map_in_arrow", "pick", "row_key", "shared_folder", "sized", "table", "uniform"]

T = TypeVar("T")
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
#: Word separators; words are ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """128 bits for a row: repeated rows share a key, and rows that share only the id do not."""
    return [F.xxhash64(doc_id, text).alias("_k1"), F.xxhash64(F.lit(7), text, doc_id).alias("_k2")]


def bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def uniform(seed: int, doc_id: Column) -> Column:
    """In [0, 1), from a hash of the id; the same at every run and size."""
    return F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 40)) / F.lit(float(1 << 40))


def pick(df: DataFrame, by: str, per_class: int, seed: int) -> DataFrame:
    """A hash sample of about ``per_class`` rows of each value of ``by`` (all of a rarer one): each row is drawn with probability
    per_class / class size. The number of classes must be small; class sizes are counted over all rows."""
    sizes = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    chance = F.lit(0.0)
    for value, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        if value is not None:
            chance = F.when(F.col(by) == F.lit(value), F.lit(min(1.0, per_class / n))).otherwise(chance)
    return df.where(uniform(seed, F.col("doc_id")) < chance)


def labels_of(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label): one row per id; null ids and labels go, and of contradicting labels the greater counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("label"))


def give_back() -> None:
    """Hands memory that a finished task held back to the system: a worker stays, idle, beside the executor's later stages."""
    textvec.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; others hand back by themselves
    if trim:
        trim(0)


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow``, in batches of about ``BATCH_BYTES``, of which JVM and worker hold several copies for each running task; workers give
    memory back at the end of a task. The session keeps the batch size, unless it has a smaller one."""
    conf = df.sparkSession.conf
    given = conf.get(BATCH_SETTING).rstrip("bB")
    if not (given.isdigit() and 0 < int(given) <= BATCH_BYTES):
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(whole, schema)


def learn_in_tasks(rows: DataFrame, learns: list[Callable[[pa.Table], T]]) -> list[T]:
    """What each of ``learns`` makes of all ``rows``, a bounded sample, each in a task of its own: the driver holds no more than the outcomes,
    and a lost executor costs a repetition. Rows come in order of doc_id and text, so that every run learns the same."""
    schema = to_arrow_schema(rows.schema)

    def in_order(batches: list[pa.RecordBatch]) -> pa.Table:
        return pa.Table.from_batches(batches, schema).sort_by([("doc_id", "ascending"), ("text", "ascending")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            k = held[0].column(0)[0].as_py()  # a partition has the rows of one learner
            told = learns[k](in_order([b.drop_columns(["_k"]).cast(schema) for b in held]))
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pickle.dumps(told)], pa.binary())], names=["k", "outcome"])

    numbers = F.explode(F.array(*[F.lit(k) for k in range(len(learns))])).alias("_k")
    tasks = map_in_arrow(rows.select(numbers, *rows.columns).repartitionById(len(learns), "_k"), run, "k int, outcome binary")
    out = {r["k"]: pickle.loads(r["outcome"]) for r in tasks.collect()}  # a row for each of ``learns``
    return [out[k] if k in out else learn(in_order([])) for k, learn in enumerate(learns)]


def learn_in_task(rows: DataFrame, learn: Callable[[pa.Table], T]) -> T:
    return learn_in_tasks(rows, [learn])[0]


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, folds: int, fold: int, per_class: int, max_chars: int, seed: int) -> tuple[DataFrame, dict[int, int]]:
    """((doc_id, text, label), sizes): a sample to learn from, of about ``per_class`` documents of each label, and the numbers of labelled
    rows by label. Only ids outside the held-out fold, and texts of at most ``max_chars``; so it is bounded whatever the input."""
    known = labels_of(labels, column).where(bucket(F.col("doc_id"), folds) != fold)
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    drawn = cut(pick(known, "label", per_class, seed))
    return docs.select("doc_id", "text").join(sized(drawn), "doc_id").where(F.length("text") <= max_chars).select("doc_id", "text", "label"), sizes
