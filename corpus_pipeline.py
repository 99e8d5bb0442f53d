"""A corpus pipeline over ``documents``: quality classifier, line dedup, near-duplicate join, benchmark decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written as Parquet and read again as the next stage's ``docs``. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from refweave.llm import decontaminate, linededup, mixing, nearjoin, quality
from refweave.llm.common import SPACES, shared_folder, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. It learns from the labelled ones among them, outside its held-out fold. A null, empty or blank text
    scores what the labels' frequencies say; equal texts score alike, so repeated rows stay or go together; a null id has no label. Without
    labels of both kinds all documents get one score. An empty table gives an empty one."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand on many sites (one copy of each stays). A document of which nothing is left goes: others hold its
    lines. n_chars follows the text. A null text stays, as does one that was blank before; of copies of a line the one in the least id stays
    (null ids come last); repeated rows are one document, and keep the same lines. An empty table gives an empty one."""
    cleaned = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.btrim("text", F.lit(SPACES)) == "")
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*[c for c in docs.columns if c in cleaned.columns and c != "n_removed"])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links connect: the one with the least id, null ids last. Documents with a null, empty or
    blank text are in no group, and stay; of repeated rows one stays. An empty table gives an empty one."""
    return nearjoin.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null, empty and blank texts hold none, and stay; repeated rows stay or go together; null
    and empty items match nothing. With an empty benchmark all stay; an empty table gives an empty one."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or thinned to the sources' target shares, in global random order. A null source is a source of its own; a null id is drawn by its text, and
    rows that share an id (and, without one, the text) get equal numbers of copies. An empty table gives an empty one."""
    return mixing.mix_sources(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("source mixing", mixed),
]

#: A trained classifier decides in the first stage, so there is no SQL for the rows; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
