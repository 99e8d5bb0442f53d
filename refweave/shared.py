"""Cutting lineage in the folder that driver and executors share, and broadcasts behind a size check."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

#: Rows up to which a frame of a few short columns is broadcast; beyond it Spark joins by shuffle, with its skew handling.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the one the cluster names in spark.checkpoint.dir. A temporary one is set only where none
    is named and all is one process, as in tests; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there. A lost executor costs nothing that was written."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """A folder within the shared one for frames that would be many times as large as checkpoints: ``keep`` writes them by column, compressed.
    Shuffle files go as each step ends, and the folder as the block ends, so what the block returns must be ``cut`` in it. Any step may run
    again, as it starts from what is written.

    Spark goes by the size of files when it broadcasts what it reads, and a file of a few MB can hold millions of rows, which the driver has to
    gather. With ``by_rows`` it broadcasts only what is hinted, and what a shuffle has measured as rows."""

    CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    BROADCAST, MEASURED = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"

    def __init__(self, spark: SparkSession, by_rows: bool = False):
        self.spark, self.path, self.n = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", 0
        self.put = {self.CLEANUP: "true"}
        if by_rows:
            self.put |= {self.MEASURED: spark.conf.get(self.MEASURED, None) or spark.conf.get(self.BROADCAST), self.BROADCAST: "-1"}

    def __enter__(self) -> Scratch:
        self.before = {key: self.spark.conf.get(key, None) for key in self.put}
        for key, value in self.put.items():
            self.spark.conf.set(key, value)
        return self

    def __exit__(self, *_) -> None:
        for key, value in self.before.items():
            if value is None:
                self.spark.conf.unset(key)
            else:
                self.spark.conf.set(key, value)
        self._delete(self.path)

    def _delete(self, path: str) -> None:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (already cut, of short rows), with a broadcast hint only if it is counted to have at most ``max_rows`` rows."""
    return F.broadcast(df) if df.count() <= max_rows else df


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """``df`` with a row number from 1 in a total order, without gathering the rows in one task: ranges are sorted apart, and each range's
    count shifts the next. ``order`` should have no ties."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33)))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row per partition
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def ranked(df: DataFrame, name: str, key: str, *order, size: str | None = None) -> DataFrame:
    """``df`` with each row's rank from 1 within its key, and the key's number of rows as ``size``; a key may hold most rows, as no task has
    to see a whole key."""
    rows = cut(numbered(df, "_k", key, *order))
    starts = cut(rows.groupBy(key).agg(F.min("_k").alias("_first"), F.count("*").alias(size or "_size")))
    out = rows.withColumnRenamed(key, "_key").join(sized(starts), F.col("_key").eqNullSafe(F.col(key))).withColumn(name, F.col("_k") - F.col("_first") + 1)
    return out.drop("_key", "_k", "_first", *([] if size else ["_size"]))


def quantiles(df: DataFrame, key: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(key, a column per share): exact quantiles with linear interpolation between the two nearest ranks. Nulls don't count."""
    rows = ranked(df.select(key, value).where(F.col(value).isNotNull()), "_r", key, value, size="_n")
    at = {name: (F.col("_n") - 1) * share for name, share in shares.items()}
    r = F.col("_r") - 1
    near = None
    for place in at.values():
        one = (r == F.floor(place)) | (r == F.ceil(place))
        near = one if near is None else near | one
    picked = rows.where(near)
    pair = [F.max(F.when(r == f(place), F.col(value))).alias(f"_{name}_{k}") for name, place in at.items() for k, f in enumerate((F.floor, F.ceil))]
    wide = picked.groupBy(key).agg(F.first("_n").alias("_n"), *pair)
    return wide.select(key, *[(F.col(f"_{name}_0") + (F.col(f"_{name}_1") - F.col(f"_{name}_0")) * (place - F.floor(place))).alias(name) for name, place in at.items()])
