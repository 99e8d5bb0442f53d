"""Assignment by rules and policies: priorities with conflicts, precedence overlays, inheritance, coverage and exactly-once checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from ..shared import sized


def matches(items: DataFrame, rules: DataFrame, box: dict[str, tuple[str, str]], key: str | None = None) -> DataFrame:
    """Items with the rules whose closed box holds them: ``box`` is {item column: (rule's low, rule's high)}; ``key``: a column to be equal."""
    inside = None
    for value, (low, high) in box.items():
        one = (items[value] >= rules[low]) & (items[value] <= rules[high])
        inside = one if inside is None else inside & one
    on = inside if key is None else (items[key] == rules[key]) & inside
    return items.join(sized(rules), on)


def by_priority(matched: DataFrame, items: DataFrame, item: str, group: str, priority: str, fallback: Column) -> DataFrame:
    """(item, group, reason): the group of the highest-priority rule. Different groups at that priority are a conflict and give the fallback,
    as does no rule."""
    top = matched.groupBy(item).agg(F.max(priority).alias("_top"))
    best = matched.join(top, item).where(F.col(priority) == F.col("_top")).groupBy(item).agg(F.count_distinct(group).alias("_n"), F.min(group).alias("_g"))
    joined = items.join(best, item, "left")
    return joined.select(item, F.when(F.col("_n") == 1, F.col("_g")).otherwise(fallback).alias("group"), F.when(F.col("_n").isNull(), "unmatched").when(F.col("_n") == 1, "rule").otherwise("conflict").alias("reason"))


def overlay(base: DataFrame, layers: list[tuple[DataFrame, str]], settings: list[str]) -> DataFrame:
    """``base`` with each setting taken from the last layer that has it. A layer is (frame, key column), with one row per key and a null where
    it says nothing; earlier layers give way to later ones, and all to ``base``'s defaults only where none speaks."""
    out = base
    for k, (layer, key) in enumerate(layers):
        told = layer.select(key, *[F.col(s).alias(f"_{k}_{s}") for s in settings])
        out = out.join(told, key, "left")
    order = range(len(layers) - 1, -1, -1)
    columns = [c for c in base.columns if c not in settings]
    return out.select(*columns, *[F.coalesce(*[F.col(f"_{k}_{s}") for k in order], F.col(s)).alias(s) for s in settings])


def coverage(entities: DataFrame, membership: DataFrame, key: str = "id", part: str = "part") -> DataFrame:
    """(type, in_none, in_one, in_many): in how many parts the entities of a type are."""
    return span_coverage(entities, membership.groupBy(key).agg(F.min(part).alias("least"), F.max(part).alias("most")), key)


def span_coverage(entities: DataFrame, spans: DataFrame, key: str = "id") -> DataFrame:
    """``coverage`` by the least and greatest part of each entity, ``spans(key, least, most)``, as of ``graph.spans``."""
    joined = entities.join(spans, key, "left").select("type", "least", "most")
    kinds = (("in_none", F.col("least").isNull()), ("in_one", F.col("least") == F.col("most")), ("in_many", F.col("least") < F.col("most")))
    return joined.groupBy("type").agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(name) for name, c in kinds])


def not_exactly_once(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Keys with their number of finds, where that is not 1: misses and repeats of expected keys, and finds nobody expects (expected false)."""
    n = found.groupBy(*key).agg(F.count("*").alias("_n"))
    joined = expected.select(*key).distinct().withColumn("_e", F.lit(True)).join(n, key, "full_outer")
    return joined.select(*key, F.coalesce("_n", F.lit(0)).alias("n"), F.coalesce("_e", F.lit(False)).alias("expected")).where("n <> 1 or not expected")


def nearest_with_margin(pairs: DataFrame, item: str, candidate: str, distance: str, within: float, margin: float) -> DataFrame:
    """(item, candidate, distance) of each item's nearest candidate, if it is within reach and the second is at least ``margin`` farther."""
    w = W.partitionBy(item).orderBy(distance, candidate)
    two = pairs.withColumn("_k", F.row_number().over(w)).where("_k <= 2").groupBy(item).agg(
        F.min_by(candidate, F.struct("_k")).alias(candidate), F.min(distance).alias(distance), F.max(F.when(F.col("_k") == 2, F.col(distance))).alias("_second")
    )
    return two.where((F.col(distance) <= within) & (F.col("_second").isNull() | (F.col("_second") - F.col(distance) >= margin))).select(item, candidate, distance)


def first_accepted(trials: DataFrame, item: str, attempt: str, accepted: str, value: str, source: Column) -> DataFrame:
    """(item, value): of an ordered ladder of trials the first accepted one's value, else the source's."""
    best = trials.groupBy(item).agg(F.min_by(F.when(F.col(accepted), F.col(value)), F.when(F.col(accepted), F.col(attempt))).alias("_v"))
    return best.select(item, F.coalesce("_v", source).alias(value))


def compose(units: DataFrame, omitted: DataFrame, changed: DataFrame, unit: str) -> DataFrame:
    """(unit, state): omitted beats changed beats retained; a unit in a ledger that isn't among the units is unknown."""
    told = omitted.select(unit).withColumn("_o", F.lit(True)).distinct().join(changed.select(unit).withColumn("_c", F.lit(True)).distinct(), unit, "full_outer")
    joined = units.select(unit).distinct().withColumn("_u", F.lit(True)).join(told, unit, "full_outer")
    return joined.select(unit, F.when(F.col("_u").isNull(), "unknown").when(F.col("_o"), "omitted").when(F.col("_c"), "changed").otherwise("retained").alias("state"))


def multiset_difference(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """(key, left, right): how often each key occurs on each side, where that differs."""
    n = a.groupBy(*key).agg(F.count("*").alias("_a")).join(b.groupBy(*key).agg(F.count("*").alias("_b")), key, "full_outer")
    return n.select(*key, F.coalesce("_a", F.lit(0)).alias("left"), F.coalesce("_b", F.lit(0)).alias("right")).where("left <> right")
