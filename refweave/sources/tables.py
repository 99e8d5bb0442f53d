"""Star-schema tables as an entity graph: a record per row, its foreign keys as ordered references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..shared import table

#: Ids: kind * KIND + key.
KIND = 10**13
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "orders": 6, "lineitem": 7}


def ref(kind: str, key) -> F.Column:
    return (F.lit(KINDS[kind] * KIND) + key).cast("bigint")


def entity_graph(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """(row, id, type, text, refs). lineitem keys are order * 10 + line number, of which the table has repeats: the greatest
    (part, supplier, price) stands for the key, as the last definition of an id does. row is the id."""
    c = F.col
    shapes = {
        "region": (c("r_regionkey"), c("r_name"), []),
        "nation": (c("n_nationkey"), c("n_name"), [("region", c("n_regionkey"))]),
        "customer": (c("c_custkey"), c("c_mktsegment"), [("nation", c("c_nationkey"))]),
        "supplier": (c("s_suppkey"), c("s_name"), [("nation", c("s_nationkey"))]),
        "part": (c("p_partkey"), c("p_brand"), []),
        "orders": (c("o_orderkey"), c("o_orderpriority"), [("customer", c("o_custkey"))]),
        "lineitem": (c("l_orderkey") * 10 + c("l_linenumber"), c("l_returnflag"), [("orders", c("l_orderkey")), ("part", c("l_partkey")), ("supplier", c("l_suppkey"))]),
    }
    out = None
    for kind in kinds or shapes:
        key, text, refs = shapes[kind]
        id_ = ref(kind, key)
        rows = table(spark, sf_dir, kind)
        if kind == "lineitem":
            last = F.max(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")).alias("_last")
            rows = rows.groupBy("l_orderkey", "l_linenumber").agg(last).select("l_orderkey", "l_linenumber", "_last.*")
        part = rows.select(
            id_.alias("row"), id_.alias("id"), F.lit(kind).alias("type"), text.alias("text"), (F.array(*[ref(k, v) for k, v in refs]) if refs else F.array().cast("array<bigint>")).alias("refs")
        )
        out = part if out is None else out.unionByName(part)
    return out


#: The same as DuckDB SQL: a CTE named ents.
ENTS = f"""ents AS (
SELECT {1 * KIND} + r_regionkey AS id, 'region' AS type, r_name AS text, []::BIGINT[] AS refs FROM region
UNION ALL SELECT {2 * KIND} + n_nationkey, 'nation', n_name, [{1 * KIND} + n_regionkey] FROM nation
UNION ALL SELECT {3 * KIND} + c_custkey, 'customer', c_mktsegment, [{2 * KIND} + c_nationkey] FROM customer
UNION ALL SELECT {4 * KIND} + s_suppkey, 'supplier', s_name, [{2 * KIND} + s_nationkey] FROM supplier
UNION ALL SELECT {5 * KIND} + p_partkey, 'part', p_brand, []::BIGINT[] FROM part
UNION ALL SELECT {6 * KIND} + o_orderkey, 'orders', o_orderpriority, [{3 * KIND} + o_custkey] FROM orders
UNION ALL SELECT {7 * KIND} + l_orderkey * 10 + l_linenumber, 'lineitem', l_returnflag, [{6 * KIND} + l_orderkey, {5 * KIND} + l_partkey, {4 * KIND} + l_suppkey] FROM (SELECT l_orderkey, l_linenumber, unnest(max(struct_pack(l_partkey, l_suppkey, l_extendedprice, l_returnflag))) FROM lineitem GROUP BY 1, 2))"""

REFS = "refs AS (SELECT id AS src, unnest(refs) AS dst, unnest(range(0, len(refs))) AS pos FROM ents)"
