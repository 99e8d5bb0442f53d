"""Named passes over a graph, with what each requires and preserves, and plans that are proved against the data they were made from."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..operators import fingerprint, graph
from ..shared import cut


@dataclass(frozen=True)
class Pass:
    name: str
    run: Callable[[DataFrame], DataFrame]
    requires: frozenset[str] = frozenset()
    preserves: frozenset[str] = frozenset()


@dataclass
class Registry:
    passes: dict[str, Pass] = field(default_factory=dict)

    def add(self, name: str, requires: tuple[str, ...] = (), preserves: tuple[str, ...] = ()):
        def register(function: Callable[[DataFrame], DataFrame]):
            if name in self.passes:
                raise ValueError(f"pass {name} is there already")
            self.passes[name] = Pass(name, function, frozenset(requires), frozenset(preserves))
            return function

        return register

    def run(self, names: list[str], entities: DataFrame, holds: set[str]) -> tuple[DataFrame, set[str]]:
        """The passes in order. One whose requirements don't hold is an error; what a pass doesn't preserve holds no more."""
        for name in names:
            one = self.passes[name]
            if missing := one.requires - holds:
                raise ValueError(f"{name} requires {', '.join(sorted(missing))}")
            entities = one.run(entities)
            holds = holds & one.preserves
        return entities, holds


def revision(entities: DataFrame) -> str:
    """A digest of all records, whatever their order."""
    row = entities.select(F.sha2(F.concat_ws("|", "id", "type", F.coalesce(F.col("text").cast("string"), F.lit("")), F.array_join(F.col("refs").cast("array<string>"), ",")), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")) for k in range(5)]  # sums: equal records don't cancel out
    got = row.agg(F.count("*"), *parts).first()
    return "-".join(f"{int(v or 0) % (1 << 48):012x}" for v in got)


@dataclass(frozen=True)
class SharingPlan:
    """Aliases of records that are equal with all that they reach, and the revision that they were found in."""

    source: str
    aliases: DataFrame


def plan_sharing(entities: DataFrame, protected: DataFrame | None = None) -> SharingPlan:
    refs = cut(graph.references(entities).select("src", "pos", "dst"))
    hashed = fingerprint.merkle(entities.select("id", F.concat_ws("|", "type", F.col("text").cast("string")).alias("text")), refs)
    return SharingPlan(revision(entities), cut(fingerprint.alias_plan(hashed, protected)))


def apply_sharing(entities: DataFrame, plan: SharingPlan) -> DataFrame:
    """New entities without the aliased records; the old ones stay as they are. A plan for another revision, or one that can't be proved, is an
    error."""
    if revision(entities) != plan.source:
        raise ValueError("the plan was made for other records")
    refs = cut(graph.references(entities).select("src", "pos", "dst"))
    kept, moved = fingerprint.apply_plan(entities, refs, plan.aliases)
    moved = cut(moved)
    if not fingerprint.prove_plan(entities, refs, plan.aliases, kept, moved).isEmpty():
        raise ValueError("the plan does not hold")
    lists = moved.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("_refs"))
    return kept.join(lists, "id", "left").withColumn("refs", F.coalesce("_refs", F.array().cast("array<bigint>"))).drop("_refs")
