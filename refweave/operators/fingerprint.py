"""Content fingerprints: Merkle hashes by level, duplicate groups, interning, alias plans, and proofs that a rewrite lost nothing."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..shared import BROADCAST_ROWS, cut, numbered, sized
from .graph import Keep, forward_closure

#: References whose children are looked up at once, of records that nothing refers to.
SLICE = 25_000_000
#: Positions of references that get a column each; longer lists are spread over rows and gathered by key.
COLUMNS = 8


def _there(done: DataFrame, longest: int) -> dict[int, DataFrame]:
    """Of ``done(id, hash, level, at)`` what is referred to at each of the first positions. What is broadcast comes last, when no shuffle has to
    carry its hashes."""
    there = {k: done.where(F.col("at").bitwiseAND(F.lit(1 << k)) != 0).select("id", "hash", "level") for k in range(min(longest, COLUMNS))}
    rows = {k: x.count() for k, x in there.items()}
    return {k: F.broadcast(there[k]) if rows[k] <= BROADCAST_ROWS else there[k] for k in sorted(there, key=lambda k: -rows[k])}


def _by_column(records: DataFrame, there: dict[int, DataFrame]) -> DataFrame:
    """``records`` of no more references than ``there`` has, with (below, top): the children's hashes in order, and their greatest level. A join
    for each position, so that nothing is gathered by key; where there is no reference, rows are dealt by id and find nothing."""
    out = records.select("id", "text", "n", "at", *[F.get("refs", F.lit(k)).alias(f"_r{k}") for k in there])
    for k, done in there.items():
        found = done.select(F.col("id").alias("_id"), F.unhex("hash").alias(f"_h{k}"), F.col("level").alias(f"_l{k}"))
        at = F.col(f"_r{k}")
        out = out.join(found, (F.coalesce(at, F.xxhash64("id")) == F.col("_id")) & at.isNotNull(), "left").drop("_id", f"_r{k}")
    return out.withColumn("below", F.concat_ws(",", *[F.lower(F.hex(f"_h{k}")) for k in sorted(there)])).withColumn("top", F.greatest(F.lit(-1), F.lit(-1), *[F.col(f"_l{k}") for k in there]))


def _by_row(records: DataFrame, done: DataFrame) -> DataFrame:
    """The same for lists of any length."""
    found = records.select("id", F.posexplode("refs").alias("pos", "dst")).join(done.select(F.col("id").alias("dst"), "hash", "level"), "dst")
    listed = found.groupBy("id").agg(F.max("level").alias("top"), F.sort_array(F.collect_list(F.struct("pos", F.unhex("hash").alias("h")))).alias("c"))
    return records.join(listed, "id").withColumn("below", F.array_join(F.transform("c", lambda x: F.lower(F.hex(x["h"]))), ","))


def _hash(records: DataFrame, done: DataFrame, there: dict[int, DataFrame], longest: int) -> DataFrame:
    """(id, hash, level, at) of ``records(id, text, n, refs, at)`` with ``longest`` references at most, all in ``done`` and so in ``there``."""
    found = [_by_column(records.where(F.col("n") <= len(there)), there)]
    if longest > len(there):
        found.append(_by_row(records.where(F.col("n") > len(there)), done))
    text = F.when(F.col("n") == 0, F.col("text")).otherwise(F.concat_ws("|", "text", "below"))
    return _union([x.select("id", F.sha2(text, 256).alias("hash"), (F.col("top") + 1).alias("level"), "at") for x in found])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def merkle(nodes: DataFrame, edges: DataFrame, max_rounds: int = 10_000, keep: Keep = cut) -> DataFrame:
    """``merkle_records`` of ``nodes(id, text)`` with ``edges(src, pos, dst)``."""
    listed = edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("refs"))
    return merkle_records(nodes.select("id", "text").join(listed, "id", "left"), max_rounds, keep)


def merkle_records(records: DataFrame, max_rounds: int = 10_000, keep: Keep = cut) -> DataFrame:
    """(id, hash, level) of ``records(id, text, refs)``: SHA-256 of a record's own text and its children's hashes in order; ids don't enter.

    A record is hashed once, in the round after its last child; rounds count, by ids alone, which children the last one has done. What nothing
    refers to takes no part in them: when all else is done, it is hashed in one step, in slices of about ``SLICE`` references by hash of the
    id, so that what is shuffled at once does not grow with the input. A cycle or a reference to a missing record raises ValueError.
    """
    where = F.expr(f"shiftleft(1L, least(pos, {COLUMNS}))")
    inner = keep(records.select(F.posexplode("refs").alias("pos", "id")).groupBy("id").agg(F.bit_or(where).alias("at")))
    n = F.greatest(F.coalesce(F.size("refs"), F.lit(0)), F.lit(0))
    told = keep(records.join(inner, "id", "left").select("id", "text", n.alias("n"), "refs", "at"))
    left = keep(told.where("at is not null"))
    if not inner.join(left.select("id"), "id", "left_anti").isEmpty():
        raise ValueError("reference to a missing record")
    below = keep(left.select(F.col("id").alias("src"), "n", F.explode("refs").alias("dst")))
    newest = keep(left.where("n = 0").select("id", F.sha2(F.col("text"), 256).alias("hash"), F.lit(0).alias("level"), "at"))
    levels, part, waiting = [newest], None, left.where("n > 0").count()
    for level in range(1, max_rounds):
        if not waiting:
            break
        met = below.join(sized(newest.select(F.col("id").alias("dst"))), "dst").groupBy(F.col("src").alias("id"), "n").agg(F.count("*").alias("k"))
        met = keep(met if part is None else met.unionByName(part).groupBy("id", "n").agg(F.sum("k").alias("k")))
        part, whole = met.where("k < n"), met.where("k = n")
        fresh, longest = whole.agg(F.count("*"), F.max("n")).first()
        if not fresh:
            break
        done = _union(levels)
        newest = keep(_hash(left.join(whole.select("id"), "id", "left_semi"), done, _there(done, longest), longest))
        waiting -= fresh
        levels.append(newest)
        if len(levels) > 16:  # long chains: one frame again
            levels = [keep(_union(levels))]
    if waiting:
        raise ValueError("cycle of references")
    done = _union(levels)
    longest, references = told.where("at is null").agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    there, slices = _there(done, longest), references // SLICE + 1
    out = done.select("id", "hash", "level")
    for k in range(slices):
        mine = F.pmod(F.xxhash64(F.lit("slice"), "id"), F.lit(slices)) == k
        out = out.unionByName(keep(_hash(told.where(F.col("at").isNull() & mine), done, there, longest).drop("at")))
    return out


def duplicate_groups(hashed: DataFrame, key: str = "hash", order: str = "id") -> DataFrame:
    """(hash, members, representative, redundant): groups of two or more, the representative being the least id."""
    grouped = hashed.groupBy(key).agg(F.count("*").alias("members"), F.min(order).alias("representative"))
    return grouped.where("members >= 2").withColumn("redundant", F.col("members") - 1)


def intern(df: DataFrame, value: str, order: str) -> DataFrame:
    """(value, code): a dense code for each distinct value, in order of first appearance."""
    first = df.groupBy(value).agg(F.min(order).alias("_first"))
    return numbered(first, "_code", "_first").select(value, (F.col("_code") - 1).alias("code"))


def alias_plan(hashed: DataFrame, protected: DataFrame | None = None) -> DataFrame:
    """(id, canonical): every eligible record that has an equal with a lesser id, and the least of them."""
    eligible = hashed if protected is None else hashed.join(protected.select("id"), "id", "left_anti")
    canon = eligible.groupBy("hash").agg(F.min("id").alias("canonical"))
    return eligible.join(canon, "hash").where("id <> canonical").select("id", "canonical")


def apply_plan(entities: DataFrame, refs: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without the aliased ones, and references that point at canonical records; positions stay."""
    to = plan.select(F.col("id").alias("dst"), "canonical")
    kept = entities.join(plan.select("id"), "id", "left_anti")
    moved = refs.join(plan.select(F.col("id").alias("src")), "src", "left_anti").join(to, "dst", "left")
    return kept, moved.select("src", "pos", F.coalesce("canonical", "dst").alias("dst"))


def prove_plan(entities: DataFrame, refs: DataFrame, plan: DataFrame, kept: DataFrame, moved: DataFrame, keep: Keep = lambda df: df) -> DataFrame:
    """Rows that contradict the plan: none if every record is either kept or aliased to a kept one, and each kept record's references are the
    original ones with aliases resolved. Columns: id, problem. ``keep`` writes each step, if given."""
    lost = entities.select("id").join(kept.select("id"), "id", "left_anti").join(plan.select("id"), "id", "left_anti").withColumn("problem", F.lit("lost"))
    dangling = plan.join(kept.select(F.col("id").alias("canonical")), "canonical", "left_anti").select("id").withColumn("problem", F.lit("alias to nothing"))
    to = plan.select(F.col("id").alias("dst"), "canonical")
    want = refs.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(to, "dst", "left").select("src", "pos", F.coalesce("canonical", "dst").alias("dst"))
    got = moved.select("src", "pos", "dst")
    want, got = keep(want), keep(got)
    wrong = keep(want.exceptAll(got)).unionByName(keep(got.exceptAll(want))).select(F.col("src").alias("id")).distinct().withColumn("problem", F.lit("references differ"))
    return keep(lost).unionByName(keep(dangling)).unionByName(keep(wrong))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows, with repeats, that only one side has. Both 0: equal as multisets."""
    left = a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit("only left").alias("side"), "n")
    return left.unionByName(b.exceptAll(a).agg(F.count("*").alias("n")).select(F.lit("only right").alias("side"), "n"))


def positional_diff(a: DataFrame, b: DataFrame, order: str, value: str) -> DataFrame:
    """(k, left, right) where two ordered sequences differ, or one has ended."""
    one = numbered(a, "k", order).select("k", F.col(value).alias("left"))
    two = numbered(b, "k", order).select("k", F.col(value).alias("right"))
    return one.join(two, "k", "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def visit_code(children: dict[int, list[int]], labels: dict[int, str], root: int) -> str:
    """SHA-256 of a walk from the root in argument order, records named by the order in which they are first met: what is shared where
    counts, ids don't."""
    met = {root: 0}
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        told = []
        fresh = []
        for y in children.get(x, []):
            if y not in met:
                met[y] = len(met)
                fresh.append(y)
            told.append(str(met[y]))
        out.append(f"{met[x]}:{labels.get(x, '')}({','.join(told)})")
        stack += reversed(fresh)
    return hashlib.sha256(";".join(out).encode()).hexdigest()


def incidence(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, hash) by ``visit_code`` of what each of ``roots(id)`` reaches; a root's graph, such as a body's, is one group."""
    edges = cut(edges.select("src", "pos", "dst"))
    reached = forward_closure(edges, roots.select(F.col("id").alias("part"), "id")).select("part", "id")
    labelled = reached.join(nodes.select("id", F.col("text").alias("label")), "id", "left")
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "dst"))), lambda x: x["dst"]).alias("to"))
    rows = labelled.join(lists, "id", "left").select(F.col("part").alias("root"), "id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("to", F.array().cast("array<bigint>")).alias("to"))

    def code(x: pd.DataFrame) -> pd.DataFrame:
        root = int(x["root"].iloc[0])
        return pd.DataFrame({"root": [root], "hash": [visit_code({int(i): [int(v) for v in to] for i, to in zip(x["id"], x["to"])}, dict(zip(x["id"].astype(int), x["label"])), root)]})

    return rows.groupBy("root").applyInPandas(code, "root long, hash string")
