"""The two ways in from a file: ``split`` into parts with a manifest, and ``inspect``; and saved indexes that are reused only if the source is
the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import assign, graph
from ..operators.model import ProductModel
from ..shared import shared_folder
from ..sources import part21


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 over the sorted SHA-256 of the files that the path names, wherever Spark can read them."""
    sums = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("h"))
    return sums.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", "h"))), lambda x: x["h"]), ","), 256).alias("s")).first().s


def save_index(entities: DataFrame, source_sha256: str, path: str) -> None:
    entities.withColumn("source_sha256", F.lit(source_sha256)).write.mode("overwrite").parquet(path)


def open_index(spark: SparkSession, path: str, source_sha256: str) -> DataFrame | None:
    """The saved index, or None if it was made from other bytes."""
    saved = spark.read.parquet(path)
    return saved.drop("source_sha256") if saved.where(F.col("source_sha256") != source_sha256).isEmpty() else None


def read(spark: SparkSession, path: str, chunk: int = part21.CHUNK) -> DataFrame:
    spark.dataSource.register(part21.Part21)
    return spark.read.format("part21").option("path", path).option("chunk", chunk).load()


def split(entities: DataFrame, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(manifest, coverage): a file per product under ``out`` (a new folder of the shared one if none is given). Manifest: product, name, file,
    entities, bytes, bodies."""
    model = ProductModel(entities)
    rows, membership, _ = model.split()
    files = part21.part_text(rows, "ISO-10303-21;\nHEADER;\nENDSEC;\nDATA;\n", "\nENDSEC;\nEND-ISO-10303-21;\n")
    folder = out or f"{shared_folder(entities.sparkSession)}/parts-{uuid.uuid4().hex}"
    files.write.parquet(folder)
    bodies = model.bodies.groupBy("product").agg(F.count("*").alias("bodies"))
    from ..functions.part21 import file_name_column

    named = entities.sparkSession.read.parquet(folder).drop("content").join(model.products.select(F.col("id").alias("part"), "name"), "part")
    manifest = named.join(bodies.withColumnRenamed("product", "part"), "part", "left").select(
        F.col("part").alias("product"), "name", file_name_column(F.col("name"), F.col("part")).alias("file"), "entities", "bytes", F.coalesce("bodies", F.lit(0)).alias("bodies")
    )
    return manifest, assign.coverage(model.entities.select("id", "type"), membership)


def inspect(entities: DataFrame, depth: int = 2) -> dict[str, DataFrame]:
    """types, products, tree (paths from the roots to a depth), bodies by type, colours and unresolved references."""
    model = ProductModel(entities)
    edges = model.occurrences.where("parent is not null and child is not null").select("parent", "child", F.col("row").alias("slot"))
    return {
        "types": entities.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type"),
        "products": model.products,
        "tree": graph.paths(model.roots, edges, max_depth=depth),
        "bodies": model.bodies.join(model.entities.select(F.col("id").alias("body"), "type"), "body").groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("product").isNull()).alias("unowned")),
        "colours": model.face_colours.groupBy("colour").agg(F.sum("n").alias("faces")).orderBy(F.desc("faces"), "colour"),
        "unresolved": graph.unresolved(entities).groupBy("dst").agg(F.count("*").alias("n")),
    }
