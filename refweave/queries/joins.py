"""Filters, joins, set operations, rules and policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import assign, fingerprint, graph
from ..shared import cut, sized, table
from ..sources.tables import ENTS, REFS, entity_graph
from .base import query

c = F.col


# Filters and projections


@query(f"WITH {ENTS} SELECT id, type FROM ents WHERE type IN ('region', 'nation', 'supplier')")
def f1_rows_of_types(spark, d):
    return entity_graph(spark, d).where(c("type").isin("region", "nation", "supplier")).select("id", "type").orderBy("id")


@query("SELECT p_partkey AS id, substr(p_name, instr(p_name, ' ') + 1) AS args, split_part(p_name, ' ', 1) AS head FROM part")
def f2_text_projections(spark, d):
    name = c("p_name")
    return table(spark, d, "part").select(c("p_partkey").alias("id"), F.substring(name, F.instr(name, F.lit(" ")) + 1, F.length(name)).alias("args"), F.split_part(name, F.lit(" "), F.lit(1)).alias("head"))


@query("SELECT p_partkey AS id FROM part WHERE contains(p_name, 'ring') AND NOT contains(p_name, 'red')")
def f3_contains_and_not(spark, d):
    return table(spark, d, "part").where(c("p_name").contains("ring") & ~c("p_name").contains("red")).select(c("p_partkey").alias("id"))


@query("SELECT p_partkey AS id, p_brand AS name FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') ORDER BY p_partkey LIMIT 20")
def f4_names_in_file_order(spark, d):
    return table(spark, d, "part").where(c("p_brand").isin("Brand#1", "Brand#2")).select(c("p_partkey").alias("id"), c("p_brand").alias("name")).orderBy("id").limit(20)


@query("""WITH k AS (SELECT c_custkey, r_name || '/' || n_name AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey, grp FROM k WHERE grp = (SELECT min(r_name) FROM region) OR starts_with(grp, (SELECT min(r_name) FROM region) || '/')""")
def f5_select_by_group_prefix(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("grp"))
    wanted = table(spark, d, "region").agg(F.min("r_name").alias("s"))
    chosen = nations.join(F.broadcast(wanted), (c("grp") == c("s")) | c("grp").startswith(F.concat("s", F.lit("/"))))  # one selector
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(chosen, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "grp")


@query("SELECT p_partkey AS id FROM part WHERE p_type IN ('SMALL', 'ECONOMY') AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 48) AND regexp_matches(p_name, '^[a-m]')")
def f6_eligible(spark, d):
    protected = table(spark, d, "lineitem").where("l_quantity > 48").select(c("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").where(c("p_type").isin("SMALL", "ECONOMY") & c("p_name").rlike("^[a-m]")).join(protected, "p_partkey", "left_anti").select(c("p_partkey").alias("id"))


REGIONS = [("low", 0.0, 150_000.0, 900_000, 10_000_000), ("mid", 100_000.0, 300_000.0, 5_000_000, 30_000_000)]
BOX = """b AS (SELECT l_orderkey AS body, min(l_extendedprice) AS x0, max(l_extendedprice) AS x1, min(l_quantity) AS y0, max(l_quantity) AS y1 FROM lineitem GROUP BY 1)"""


def _boxes(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("body")).agg(F.min("l_extendedprice").alias("x0"), F.max("l_extendedprice").alias("x1"), F.min("l_quantity").alias("y0"), F.max("l_quantity").alias("y1"))


@query(f"""WITH {BOX}, r AS (SELECT o_orderkey, o_orderstatus FROM orders) SELECT o_orderkey AS body, CASE WHEN x0 IS NULL THEN 'unbounded' WHEN x0 >= 10000 AND x1 <= 60000 AND y0 >= 5 AND y1 <= 45 THEN 'contained'
WHEN x1 >= 10000 AND x0 <= 60000 AND y1 >= 5 AND y0 <= 45 THEN 'straddling' ELSE 'outside' END AS class FROM orders LEFT JOIN b ON b.body = o_orderkey""")
def f8_classify_boxes(spark, d):
    """Whole boxes against a region with closed bounds; a body without points is unbounded."""
    joined = table(spark, d, "orders").select("o_orderkey").join(_boxes(spark, d), c("o_orderkey") == c("body"), "left")
    return joined.select(c("o_orderkey").alias("body"), g.classify_box([(c("x0"), c("x1")), (c("y0"), c("y1"))], [(F.lit(10000.0), F.lit(60000.0)), (F.lit(5.0), F.lit(45.0))]).alias("class"))


@query("""SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, 'bolt|gear') THEN 'metal' WHEN p_size > 30 AND regexp_matches(p_name, '^(red|blue)') THEN 'paint' WHEN p_retailprice < 1000 THEN 'small' ELSE 'plain' END AS material FROM part""")
def f9_first_rule_wins(spark, d):
    n = c("p_name")
    return table(spark, d, "part").select(c("p_partkey").alias("id"), g.first_match([(n.rlike("bolt|gear"), "metal"), ((c("p_size") > 30) & n.rlike("^(red|blue)"), "paint"), (c("p_retailprice") < 1000, "small")], "plain").alias("material"))


@query("""SELECT p_partkey AS id, array_to_string(list_filter([CASE WHEN regexp_matches(p_name, '(?i)RING') THEN 'round' END, CASE WHEN regexp_matches(p_name, '(?i)bolt') THEN 'fixing' END, CASE WHEN regexp_matches(p_name, '(?i)^red') THEN 'red' END], lambda x: x IS NOT NULL), ',') AS hints FROM part""")
def f10_f11_all_hints(spark, d):
    n = c("p_name")
    return table(spark, d, "part").select(c("p_partkey").alias("id"), F.array_join(g.all_matches([(n.rlike("(?i)RING"), "round"), (n.rlike("(?i)bolt"), "fixing"), (n.rlike("(?i)^red"), "red")]), ",").alias("hints"))


@query("""SELECT l_partkey AS node, list_has_any(list(DISTINCT l_returnflag), ['R']) OR list_has_any(list(DISTINCT l_linestatus), ['X']) AS protected, bool_or(l_discount = 0.1 AND l_returnflag = 'A') AS eligible FROM lineitem GROUP BY 1""")
def f12_f14_protected_roles(spark, d):
    tags = table(spark, d, "lineitem").groupBy(c("l_partkey").alias("node")).agg(F.collect_set("l_returnflag").alias("roles"), F.collect_set("l_linestatus").alias("layers"), F.bool_or((c("l_discount") == 0.1) & (c("l_returnflag") == "A")).alias("eligible"))
    return tags.select("node", (F.arrays_overlap("roles", F.array(F.lit("R"))) | F.arrays_overlap("layers", F.array(F.lit("X")))).alias("protected"), "eligible")


# Joins


@query(f"WITH {ENTS}, {REFS} SELECT e.type AS source, coalesce(t.type, '(missing)') AS target, count(*) AS n FROM refs r JOIN ents e ON e.id = r.src LEFT JOIN ents t ON t.id = r.dst GROUP BY 1, 2")
def j1_resolve_references(spark, d):
    """Counts by source and target type; summed per target before targets are looked up, so that hubs don't skew the join."""
    e = entity_graph(spark, d)
    counted = e.select("type", F.explode("refs").alias("dst")).groupBy("dst", "type").agg(F.count("*").alias("n"))
    joined = counted.join(e.select(c("id").alias("dst"), c("type").alias("target")), "dst", "left")
    return joined.groupBy(c("type").alias("source"), F.coalesce("target", F.lit("(missing)")).alias("target")).agg(F.sum("n").alias("n"))


@query("""SELECT l_orderkey AS definition, arg_min(c_nationkey, (l_linenumber, l_partkey, l_suppkey, l_extendedprice)) AS product FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def j2_definition_chain(spark, d):
    """Three hops, the first that resolves at each."""
    lines = table(spark, d, "lineitem").select("l_orderkey").distinct()
    return lines.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey")).select(c("l_orderkey").alias("definition"), c("c_nationkey").alias("product"))


@query(f"WITH {ENTS} SELECT id, refs[1] AS shape, refs[2] AS representation, refs[-1] AS last FROM ents WHERE len(refs) >= 2")
def j3_fixed_positions(spark, d):
    r = c("refs")
    return entity_graph(spark, d).where(F.size(r) >= 2).select("id", F.try_element_at(r, F.lit(1)).alias("shape"), F.try_element_at(r, F.lit(2)).alias("representation"), F.try_element_at(r, F.lit(-1)).alias("last"))


@query("""SELECT coalesce(c_custkey, -1) AS parent, c_custkey IS NOT NULL AS resolved, o_orderkey AS child FROM (SELECT * FROM orders WHERE o_orderstatus <> 'F') o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def j4_occurrences_with_unresolved(spark, d):
    """Unresolved parents stay, marked, as -1."""
    customers = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey")
    return table(spark, d, "orders").where("o_orderstatus <> 'F'").join(customers, c("o_custkey") == c("c_custkey"), "left").select(F.coalesce("c_custkey", F.lit(-1)).alias("parent"), c("c_custkey").isNotNull().alias("resolved"), c("o_orderkey").alias("child"))


@query(f"""WITH {ENTS}, {REFS} SELECT e.type, count(*) AS roots FROM ents e WHERE NOT EXISTS (SELECT 1 FROM refs WHERE dst = e.id) AND EXISTS (SELECT 1 FROM refs WHERE src = e.id) GROUP BY 1""")
def j5_roots(spark, d):
    e = entity_graph(spark, d)
    edges = graph.references(e).select(c("src").alias("parent"), c("dst").alias("child"))
    return graph.roots(e, edges).join(e.select("id", "type"), "id").groupBy("type").agg(F.count("*").alias("roots"))


@query("SELECT l_orderkey AS body, l_linenumber AS pos, coalesce(o_custkey, -1) AS product FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') ON o_orderkey = l_orderkey")
def j6_body_to_product(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_orderkey", "o_custkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, c("l_orderkey") == c("o_orderkey"), "left").select(c("l_orderkey").alias("body"), c("l_linenumber").alias("pos"), F.coalesce("o_custkey", F.lit(-1)).alias("product"))


@query("SELECT o_custkey AS target, array_to_string(list(o_orderkey ORDER BY o_orderkey), ',') AS styles FROM orders GROUP BY 1")
def j7_styles_in_file_order(spark, d):
    return table(spark, d, "orders").groupBy(c("o_custkey").alias("target")).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("styles"))


@query(f"WITH {ENTS}, {REFS} SELECT DISTINCT dst AS target, src AS owner FROM refs JOIN ents ON ents.id = refs.src WHERE (type = 'lineitem' AND pos = 0) OR (type IN ('customer', 'supplier') AND pos = len(refs) - 1)".replace("len(refs)", "len(ents.refs)"))
def j8_reverse_table(spark, d):
    """Owners by target: by first position for one type, by last for others."""
    e = entity_graph(spark, d)
    r = graph.references(e).join(e.select(c("id").alias("src"), "type"), "src")
    return r.where(((c("type") == "lineitem") & (c("pos") == 0)) | (c("type").isin("customer", "supplier") & (c("back") == -1))).select(c("dst").alias("target"), c("src").alias("owner")).distinct()


@query(f"WITH {ENTS}, {REFS} SELECT e.type, count(*) AS missing FROM refs r JOIN ents e ON e.id = r.src WHERE NOT EXISTS (SELECT 1 FROM ents t WHERE t.id = r.dst AND t.text NOT IN ('BUILDING', '1-URGENT', 'Brand#3')) GROUP BY 1")
def j9_unresolved(spark, d):
    """References to records that aren't there (some kinds are left out), repeats counted."""
    e = entity_graph(spark, d)
    counted = e.select("type", F.explode("refs").alias("dst")).groupBy("dst", "type").agg(F.count("*").alias("n"))
    return counted.join(e.where(~c("text").isin("BUILDING", "1-URGENT", "Brand#3")).select(c("id").alias("dst")), "dst", "left_anti").groupBy("type").agg(F.sum("n").alias("missing"))


@query("SELECT 'customer without order' AS problem, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'part without line', count(*) FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) UNION ALL SELECT 'order without line', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def j10_unowned(spark, d):
    def lacking(name, left, key, right, other):
        used = table(spark, d, right).select(c(other).alias(key))
        return table(spark, d, left).select(key).join(used, key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")

    return lacking("customer without order", "customer", "c_custkey", "orders", "o_custkey").unionByName(lacking("part without line", "part", "p_partkey", "lineitem", "l_partkey")).unionByName(lacking("order without line", "orders", "o_orderkey", "lineitem", "l_orderkey"))


@query(f"""WITH {BOX}, r(kind, lo, hi) AS (VALUES ('1-URGENT', 1000.0, 70000.0), ('2-HIGH', 5000.0, 50000.0)) SELECT body, kind AS region, CASE WHEN x0 >= lo AND x1 <= hi THEN 'contained' ELSE 'straddling' END AS class
FROM b JOIN orders ON o_orderkey = body JOIN r ON kind = o_orderpriority WHERE x1 >= lo AND x0 <= hi""")
def j11_boxes_in_regions(spark, d):
    """Boxes meet the regions of their product only: an equi-join with the box test behind it."""
    regions = spark.createDataFrame([("1-URGENT", 1000.0, 70000.0), ("2-HIGH", 5000.0, 50000.0)], "region string, lo double, hi double")
    bodies = _boxes(spark, d).join(table(spark, d, "orders").select(c("o_orderkey").alias("body"), c("o_orderpriority").alias("region")), "body")
    met = bodies.join(sized(regions), "region").withColumn("class", g.classify_box([(c("x0"), c("x1"))], [(c("lo"), c("hi"))]))
    return met.where("class <> 'outside'").select("body", "region", "class")


RULES = [("r1", 0.0, 20000.0, 1.0, 50.0, "bulk", 1), ("r2", 15000.0, 60000.0, 1.0, 25.0, "dear", 2), ("r3", 15000.0, 40000.0, 20.0, 50.0, "mixed", 2), ("r4", 0.0, 90000.0, 50.0, 50.0, "full", 5)]
RULE_SQL = "rules(id, x0, x1, y0, y1, grp, priority) AS (VALUES " + ", ".join(str(r) for r in RULES) + ")"


@query(f"""WITH {RULE_SQL}, i AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS item, l_extendedprice AS x, l_quantity AS y FROM lineitem), u AS (SELECT item, min(x) AS x, min(y) AS y FROM i GROUP BY 1),
m AS (SELECT item, grp, priority FROM u JOIN rules ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), t AS (SELECT item, max(priority) AS p FROM m GROUP BY 1),
b AS (SELECT m.item, count(DISTINCT grp) AS n, min(grp) AS g FROM m JOIN t ON t.item = m.item AND t.p = m.priority GROUP BY 1)
SELECT u.item, CASE WHEN n = 1 THEN g ELSE 'rest' END AS "group", CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'rule' ELSE 'conflict' END AS reason FROM u LEFT JOIN b USING (item)""")
def a14_j12_p5_rules_by_priority(spark, d):
    """The highest-priority rule's group; a tie between groups is a conflict and falls back."""
    items = table(spark, d, "lineitem").groupBy((c("l_orderkey") * 10 + c("l_linenumber")).alias("item")).agg(F.min("l_extendedprice").alias("x"), F.min("l_quantity").alias("y"))
    rules = spark.createDataFrame(RULES, "id string, x0 double, x1 double, y0 double, y1 double, grp string, priority int")
    matched = assign.matches(items, rules, {"x": ("x0", "x1"), "y": ("y0", "y1")})
    return assign.by_priority(matched, items, "item", "grp", "priority", F.lit("rest"))


@query("""WITH e AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), a AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderpriority <> '2-HIGH' GROUP BY 1)
SELECT coalesce(e.k, a.k) AS part, coalesce(e.n, 0) AS expected, coalesce(a.n, 0) AS actual FROM e FULL JOIN a ON e.k = a.k WHERE e.n IS DISTINCT FROM a.n""")
def j13_manifest_comparison(spark, d):
    side = lambda test, name: table(spark, d, "orders").where(test).groupBy(c("o_custkey").alias("part")).agg(F.count("*").alias(name))
    return side("o_orderstatus <> 'P'", "expected").join(side("o_orderpriority <> '2-HIGH'", "actual"), "part", "full_outer").select("part", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).where("expected <> actual")


@query("SELECT p_name AS name, min(p_partkey) AS part, arg_min(p_brand, p_partkey) AS node FROM part GROUP BY 1")
def j14_first_candidate_by_name(spark, d):
    return table(spark, d, "part").groupBy(c("p_name").alias("name")).agg(F.min("p_partkey").alias("part"), F.min_by("p_brand", "p_partkey").alias("node"))


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS k FROM embeddings), ctr AS (SELECT label, k, avg(x) AS m FROM e GROUP BY 1, 2),
d AS (SELECT vec_id, ctr.label AS label, sum((x - m) ** 2) AS dist FROM e JOIN ctr USING (k) GROUP BY 1, 2) SELECT vec_id, arg_min(label, (dist, label)) AS cluster FROM d GROUP BY 1""")
def j15_x13_nearest_centre(spark, d):
    """The centre with the least squared distance over all components; ties: the first label. Sent to all tasks only if it is few numbers."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).withColumn("x", c("x").cast("double"))
    centres = cut(e.groupBy(c("label").alias("centre"), "k").agg(F.avg("x").alias("m")))
    apart = e.select("vec_id", "k", "x").join(sized(centres), "k").groupBy("vec_id", "centre").agg(F.sum((c("x") - c("m")) ** 2).alias("dist"))
    return apart.groupBy("vec_id").agg(F.min_by("centre", F.struct("dist", "centre")).alias("cluster"))


@query("""WITH m AS (SELECT o_orderkey AS id, o_custkey AS k, round(o_totalprice / 50000) AS q FROM orders) SELECT b.id AS candidate, min(a.id) AS reference FROM m a JOIN m b ON a.k = b.k AND a.q = b.q AND a.id < b.id GROUP BY 1""")
def j17_blocked_candidates(spark, d):
    """Each candidate with the first earlier one of its blocks: the block's least id, which needs no pairs. Halves round away from zero, and an
    id that is there more than once, in one block or several, is one candidate."""
    m = table(spark, d, "orders").select(c("o_orderkey").alias("candidate"), c("o_custkey").alias("k"), F.round(c("o_totalprice") / 50000).alias("q"))
    first = m.groupBy("k", "q").agg(F.min("candidate").alias("reference"))
    return m.join(first, ["k", "q"]).where("candidate <> reference").groupBy("candidate").agg(F.min("reference").alias("reference"))


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_orderstatus AS v FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_orderstatus AS v FROM orders WHERE o_totalprice < 490000)
SELECT coalesce(a.k, b.k) AS k, a.v AS "left", b.v AS "right" FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v""")
def j19_sequences_differ(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return fingerprint.positional_diff(o, o.where("o_totalprice < 490000").drop("o_totalprice"), "o_orderkey", "o_orderstatus")


# Sets


@query("""WITH s AS (SELECT o_custkey AS k, o_orderpriority AS p FROM orders) SELECT p AS kind, count(DISTINCT k) AS n FROM s GROUP BY 1""")
def u1_visited_union(spark, d):
    return table(spark, d, "orders").select("o_custkey", "o_orderpriority").distinct().groupBy(c("o_orderpriority").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS removable FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 25)")
def u2_removable_minus_retained(spark, d):
    lines = table(spark, d, "lineitem")
    return lines.where("l_returnflag = 'R'").select("l_partkey").subtract(lines.where("l_returnflag = 'A' AND l_quantity > 25").select("l_partkey")).agg(F.count("*").alias("removable"))


@query("""SELECT 'missing' AS side, k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', k FROM (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > -500)""")
def u3_expected_and_actual(spark, d):
    customers, orders = table(spark, d, "customer").select(c("c_custkey").alias("k"), "c_acctbal"), table(spark, d, "orders").select(c("o_custkey").alias("k"))
    solvent = customers.where("c_acctbal > -500").select("k")
    return customers.select("k").subtract(orders).select(F.lit("missing").alias("side"), "k").unionByName(orders.subtract(solvent).select(F.lit("extra").alias("side"), "k"))


@query("SELECT l_partkey AS face, count(DISTINCT l_returnflag) AS groups FROM lineitem WHERE l_quantity > 40 GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def u4_faces_in_several_groups(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 40").groupBy(c("l_partkey").alias("face")).agg(F.count_distinct("l_returnflag").alias("groups")).where("groups > 1")


@query("""SELECT 'not subset' AS problem, count(*) AS n FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer)) UNION ALL SELECT 'symmetric difference', count(*) FROM
((SELECT s_nationkey FROM supplier EXCEPT SELECT c_nationkey FROM customer) UNION ALL (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier))""")
def u5_u6_u8_set_equality(spark, d):
    s, k = table(spark, d, "supplier").select(c("s_nationkey").alias("n")), table(spark, d, "customer").select(c("c_nationkey").alias("n"))
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
    return count(s.distinct().join(k, "n", "left_anti"), "not subset").unionByName(count(s.subtract(k).unionByName(k.subtract(s)), "symmetric difference"))


@query("""WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 30), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 31)
SELECT 'only left' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only right', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def u7_s14_x30_multisets_both_ways(spark, d):
    lines = table(spark, d, "lineitem")
    return fingerprint.same_rows(*[lines.where(f"l_quantity < {q}").select("l_partkey", "l_suppkey") for q in (30, 31)])


@query("""WITH f AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT coalesce(c_custkey, k) AS k, coalesce(n, 0)::BIGINT AS n, c_custkey IS NOT NULL AS expected FROM (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') FULL JOIN f ON k = c_custkey WHERE coalesce(n, 0) <> 1 OR c_custkey IS NULL""")
def u9_x12_not_exactly_once(spark, d):
    return assign.not_exactly_once(table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("k")), table(spark, d, "orders").select(c("o_custkey").alias("k")), ["k"])


# Policies


@query("""SELECT c_custkey AS part, coalesce(CASE WHEN c_acctbal > 9000 THEN 1.0 END, CASE WHEN n_regionkey = 1 THEN 2.0 END, CASE WHEN c_mktsegment = 'BUILDING' THEN 3.0 END, 4.0)::DOUBLE AS linear,
coalesce(CASE WHEN c_acctbal > 9500 THEN 0.1 END, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.3 END, 0.5)::DOUBLE AS angular FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def p1_settings_by_precedence(spark, d):
    """Base, then segment, then nation, then the customer's own: the last layer that says anything wins, setting by setting."""
    base = table(spark, d, "customer").select(c("c_custkey").alias("part"), c("c_nationkey").alias("asset"), c("c_mktsegment").alias("kind"), F.lit(4.0).alias("linear"), F.lit(0.5).alias("angular"))
    nothing = F.lit(None).cast("double")
    kinds = spark.createDataFrame([("BUILDING", 3.0, 0.3)], "kind string, linear double, angular double")
    assets = table(spark, d, "nation").where("n_regionkey = 1").select(c("n_nationkey").alias("asset"), F.lit(2.0).alias("linear"), nothing.alias("angular"))
    own = table(spark, d, "customer").where("c_acctbal > 9000").select(c("c_custkey").alias("part"), F.lit(1.0).alias("linear"), F.when(c("c_acctbal") > 9500, 0.1).alias("angular"))
    return assign.overlay(base, [(kinds, "kind"), (assets, "asset"), (own, "part")], ["linear", "angular"]).select("part", "linear", "angular")


@query("""WITH f AS (SELECT l_orderkey AS face, count(DISTINCT l_returnflag) AS owners, min(l_returnflag) AS owner FROM lineitem GROUP BY 1) SELECT CASE WHEN owners = 1 THEN owner ELSE 'conflict' END AS motion, count(*) AS faces FROM f GROUP BY 1""")
def p6_motion_owners(spark, d):
    faces = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_returnflag").alias("n"), F.min("l_returnflag").alias("o"))
    return faces.groupBy(F.when(c("n") == 1, c("o")).otherwise("conflict").alias("motion")).agg(F.count("*").alias("faces"))


@query("""SELECT p_type AS kind, count(DISTINCT p_brand) AS settings, count(DISTINCT p_brand) = 1 AS consistent, count(*) AS uses FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey) GROUP BY 1""")
def p7_compositions(spark, d):
    used = table(spark, d, "lineitem").select(c("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(used, "p_partkey", "left_semi").groupBy(c("p_type").alias("kind")).agg(F.count_distinct("p_brand").alias("settings"), (F.count_distinct("p_brand") == 1).alias("consistent"), F.count("*").alias("uses"))


@query("""WITH r AS (SELECT l_returnflag AS flag, unnest(CASE WHEN l_discount > 0.08 THEN ['marking', 'backing'] WHEN l_tax > 0.05 THEN ['surface'] ELSE ['ignored'] END) AS role FROM lineitem) SELECT flag, role, count(*) AS n FROM r GROUP BY 1, 2""")
def p8_x40_roles(spark, d):
    """A marking also gives a backing row; all others have one role."""
    role = F.when(c("l_discount") > 0.08, F.array(F.lit("marking"), F.lit("backing"))).when(c("l_tax") > 0.05, F.array(F.lit("surface"))).otherwise(F.array(F.lit("ignored")))
    return table(spark, d, "lineitem").select(c("l_returnflag").alias("flag"), F.explode(role).alias("role")).groupBy("flag", "role").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT l_partkey AS body, 'fixture/' || min(l_returnflag) AS grp FROM lineitem WHERE l_quantity = 50 GROUP BY 1) SELECT coalesce(grp, 'fixture/other-bodies') AS grp, count(*) AS bodies FROM part LEFT JOIN g ON body = p_partkey GROUP BY 1""")
def p9_catalog_with_remainder(spark, d):
    owned = table(spark, d, "lineitem").where("l_quantity = 50").groupBy("l_partkey").agg(F.concat(F.lit("fixture/"), F.min("l_returnflag")).alias("grp"))
    return table(spark, d, "part").select("p_partkey").join(owned, c("p_partkey") == c("l_partkey"), "left").groupBy(F.coalesce("grp", F.lit("fixture/other-bodies")).alias("grp")).agg(F.count("*").alias("bodies"))


@query("""WITH s AS (SELECT p_partkey AS node, p_partkey * 10 AS lo, p_partkey * 10 + p_size AS hi FROM part), t AS (SELECT node, unnest(range(lo, hi)) AS tri FROM s), n AS (SELECT tri, count(*) AS n FROM t GROUP BY 1)
SELECT CASE WHEN n > 1 THEN 'overlap' ELSE 'one' END AS state, count(*) AS triangles, sum(n)::BIGINT AS uses FROM n GROUP BY 1""")
def p10_triangle_ranges(spark, d):
    """Half-open ranges, expanded: overlaps show as triangles with several owners, and counts are conserved."""
    tri = table(spark, d, "part").where("p_size > 0").select(F.explode(F.sequence(c("p_partkey") * 10, c("p_partkey") * 10 + c("p_size") - 1)).alias("tri"))
    n = tri.groupBy("tri").agg(F.count("*").alias("n"))
    return n.groupBy(F.when(c("n") > 1, "overlap").otherwise("one").alias("state")).agg(F.count("*").alias("triangles"), F.sum("n").alias("uses"))


@query("""SELECT CASE WHEN n IS NULL THEN 'unclassified' ELSE tag END AS tag, count(*) AS nodes FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n, CASE WHEN bool_or(l_discount = 0) THEN 'bound' ELSE 'tagged' END AS tag FROM lineitem WHERE l_tax = 0 GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1""")
def p11_unclassified_remainder(spark, d):
    tagged = table(spark, d, "lineitem").where("l_tax = 0").groupBy("l_partkey").agg(F.when(F.bool_or(c("l_discount") == 0), "bound").otherwise("tagged").alias("tag"))
    return table(spark, d, "part").select("p_partkey").join(tagged, c("p_partkey") == c("l_partkey"), "left").groupBy(F.coalesce("tag", F.lit("unclassified")).alias("tag")).agg(F.count("*").alias("nodes"))


@query("""WITH x AS (SELECT o_custkey AS layer, count(*) AS bodies, count(*) FILTER (WHERE o_orderstatus = 'F') AS fixed, count(*) FILTER (WHERE o_orderstatus = 'O') AS moving FROM orders GROUP BY 1)
SELECT CASE WHEN fixed = bodies THEN 'fixed' WHEN moving = bodies THEN 'moving' WHEN fixed + moving < bodies THEN 'unknown' ELSE 'mixed' END AS scope, count(*) AS layers FROM x GROUP BY 1""")
def p12_layer_scope(spark, d):
    """What isn't known stays unknown: it never counts as fixed."""
    x = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("b"), F.count_if(c("o_orderstatus") == "F").alias("f"), F.count_if(c("o_orderstatus") == "O").alias("m"))
    scope = F.when(c("f") == c("b"), "fixed").when(c("m") == c("b"), "moving").when(c("f") + c("m") < c("b"), "unknown").otherwise("mixed")
    return x.groupBy(scope.alias("scope")).agg(F.count("*").alias("layers"))


@query("""WITH f AS (SELECT l_orderkey, count(*) FILTER (WHERE l_discount <= 0.05) AS accepted, count(*) AS faces FROM lineitem GROUP BY 1) SELECT sum(accepted)::BIGINT AS accepted, sum(faces - accepted)::BIGINT AS fallback, sum(faces)::BIGINT AS faces FROM f""")
def p14_accepted_and_fallback(spark, d):
    return table(spark, d, "lineitem").agg(F.count_if(c("l_discount") <= 0.05).alias("accepted"), F.count_if(~(c("l_discount") <= 0.05)).alias("fallback"), F.count("*").alias("faces"))


# Patterns of the binding modules


@query("""SELECT l_orderkey AS face, array_to_string(coalesce(list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_discount = 0), list(l_partkey ORDER BY l_partkey) FILTER (WHERE l_tax = 0), list(l_partkey ORDER BY l_partkey)), ',') AS styles FROM lineitem GROUP BY 1""")
def x3_first_level_with_styles(spark, d):
    """The first level that has any style row gives all of its rows."""
    level = lambda test: F.sort_array(F.collect_list(F.when(test, c("l_partkey"))))
    got = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("face")).agg(level(c("l_discount") == 0).alias("a"), level(c("l_tax") == 0).alias("b"), level(F.lit(True)).alias("c"))
    return got.select("face", F.array_join(F.when(F.size("a") > 0, c("a")).when(F.size("b") > 0, c("b")).otherwise(c("c")), ",").alias("styles"))


@query("""WITH p AS (SELECT o_custkey AS item, o_orderkey AS cand, abs(o_totalprice - 150000) AS dist FROM orders), k AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY dist, cand) AS k FROM p),
t AS (SELECT item, max(cand) FILTER (WHERE k = 1) AS candidate, max(dist) FILTER (WHERE k = 1) AS distance, max(dist) FILTER (WHERE k = 2) AS second FROM k WHERE k <= 2 GROUP BY 1) SELECT item, candidate, distance FROM t WHERE distance <= 20000 AND (second IS NULL OR second - distance >= 5000)""")
def x4_nearest_with_margin(spark, d):
    pairs = table(spark, d, "orders").select(c("o_custkey").alias("item"), c("o_orderkey").alias("candidate"), F.abs(c("o_totalprice") - 150000).alias("distance"))
    return assign.nearest_with_margin(pairs, "item", "candidate", "distance", 20000.0, 5000.0)


@query("""WITH w AS (SELECT l_suppkey AS body, round(l_discount, 1) AS n, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2) SELECT body, arg_max(n, (w, -n)) AS normal, max(w) AS weight FROM w GROUP BY 1""")
def x5_dominant_orientation(spark, d):
    w = table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("body"), F.round("l_discount", 1).alias("n")).agg(F.sum("l_quantity").alias("w"))
    return w.groupBy("body").agg(F.max_by("n", F.struct(c("w"), -c("n"))).alias("normal"), F.max("w").alias("weight"))


@query("""WITH e AS (SELECT l_orderkey AS mesh, least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey UNION ALL SELECT l_orderkey, least(l_suppkey, l_linenumber), greatest(l_suppkey, l_linenumber) FROM lineitem WHERE l_suppkey <> l_linenumber),
n AS (SELECT mesh, a, b, count(*) AS n FROM e GROUP BY 1, 2, 3) SELECT mesh, count(*) AS edges, count(*) FILTER (WHERE n = 1) AS boundary, count(*) FILTER (WHERE n > 2) AS non_manifold, bool_and(n = 2) AS closed FROM n GROUP BY 1""")
def x6_x20_x29_edge_incidence(spark, d):
    """Edges by number of uses: closed if all have two; degenerate edges are left out first."""
    lines = table(spark, d, "lineitem")
    edge = lambda a, b: F.struct(F.least(a, b).cast("bigint").alias("a"), F.greatest(a, b).cast("bigint").alias("b"))
    edges = lines.select(c("l_orderkey").alias("mesh"), F.inline(F.array(edge(c("l_partkey"), c("l_suppkey")), edge(c("l_suppkey"), c("l_linenumber").cast("bigint"))))).where("a <> b")
    n = edges.groupBy("mesh", "a", "b").agg(F.count("*").alias("n"))
    return n.groupBy("mesh").agg(F.count("*").alias("edges"), F.count_if(c("n") == 1).alias("boundary"), F.count_if(c("n") > 2).alias("non_manifold"), F.bool_and(c("n") == 2).alias("closed"))


@query("""WITH t AS (SELECT l_orderkey AS unit, l_linenumber AS attempt, l_discount <= 0.02 AS ok, l_partkey AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1)
SELECT unit, coalesce(arg_min(v, attempt) FILTER (WHERE ok), -1)::BIGINT AS value FROM t GROUP BY 1""")
def x7_x26_first_accepted(spark, d):
    one = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("unit"), c("l_linenumber").alias("attempt")).agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_discount")).alias("r"))
    trials = one.select("unit", "attempt", (c("r.l_discount") <= 0.02).alias("ok"), c("r.l_partkey").alias("value"))
    return assign.first_accepted(trials, "unit", "attempt", "ok", "value", F.lit(-1).cast("bigint"))


@query(f"""WITH {BOX} SELECT count(*) AS overlaps FROM b x JOIN orders ox ON ox.o_orderkey = x.body JOIN orders oy ON oy.o_custkey = ox.o_custkey AND oy.o_orderkey > ox.o_orderkey JOIN b y ON y.body = oy.o_orderkey
WHERE least(x.x1, y.x1) > greatest(x.x0, y.x0) AND least(x.y1, y.y1) > greatest(x.y0, y.y0)""")
def x11_overlapping_boxes(spark, d):
    """Pairs of one owner's boxes that share area; touching isn't overlap."""
    boxes = _boxes(spark, d).join(table(spark, d, "orders").select(c("o_orderkey").alias("body"), c("o_custkey").alias("owner")), "body")
    a, b = boxes.alias("a"), boxes.alias("b")
    axes = lambda t: [(c(f"{t}.x0"), c(f"{t}.x1")), (c(f"{t}.y0"), c(f"{t}.y1"))]
    return a.join(b, (c("a.owner") == c("b.owner")) & (c("a.body") < c("b.body"))).where(g.overlaps(axes("a"), axes("b"))).agg(F.count("*").alias("overlaps"))


@query("""SELECT count(*) AS mismatches FROM (SELECT doc_id, sha256(text) AS h FROM documents) a JOIN (SELECT doc_id, sha256(CASE WHEN source = 'src3' THEN text || '!' ELSE text END) AS h FROM documents) b USING (doc_id) WHERE a.h <> b.h""")
def x15_x39_checksums_agree(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    a = docs.select("doc_id", F.sha2("text", 256).alias("h"))
    b = docs.select("doc_id", F.sha2(F.when(c("source") == "src3", F.concat("text", F.lit("!"))).otherwise(c("text")), 256).alias("k"))
    return a.join(b, "doc_id").where("h <> k").agg(F.count("*").alias("mismatches"))


@query("""WITH m AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL) SELECT h AS payload, count(*) AS placements, min(doc_id) AS stored FROM m GROUP BY 1 HAVING count(*) > 1""")
def x22_x35_shared_payloads(spark, d):
    """Computed once, placed often: by content, whatever the name or place."""
    m = table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("payload"))
    return m.groupBy("payload").agg(F.count("*").alias("placements"), F.min("doc_id").alias("stored")).where("placements > 1")


@query("""SELECT l_partkey AS node, CASE WHEN bool_or(l_returnflag = 'X') THEN 'explicit' WHEN bool_or(l_discount = 0.1) THEN 'semantics' WHEN max(l_quantity) > 49 THEN 'attributes' WHEN count(*) < 25 THEN 'few triangles' ELSE 'simplify' END AS reason FROM lineitem GROUP BY 1""")
def x25_reason_precedence(spark, d):
    n = table(spark, d, "lineitem").groupBy(c("l_partkey").alias("node")).agg(F.bool_or(c("l_returnflag") == "X").alias("x"), F.bool_or(c("l_discount") == 0.1).alias("s"), F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    return n.select("node", g.first_match([(c("x"), "explicit"), (c("s"), "semantics"), (c("q") > 49, "attributes"), (c("n") < 25, "few triangles")], "simplify").alias("reason"))


@query("""SELECT l_suppkey AS piece, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 9.9 AND 10.1 AND abs(l_discount - 0.05) <= 0.001 GROUP BY 1 HAVING count(*) = 1""")
def x28_one_match(spark, d):
    return table(spark, d, "lineitem").where(c("l_quantity").between(9.9, 10.1) & (F.abs(c("l_discount") - 0.05) <= 0.001)).groupBy(c("l_suppkey").alias("piece")).agg(F.count("*").alias("n")).where("n = 1")


@query("""SELECT round_even(l_discount / 0.02, 0)::BIGINT AS nq, round_even(l_extendedprice / 20000.0, 0)::BIGINT AS dq, l_returnflag AS material, count(*) AS n FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 5""")
def x31_x37_coplanar_groups(spark, d):
    """Grouping by quantised keys; groups of under five stay out."""
    return table(spark, d, "lineitem").groupBy(g.quantised(c("l_discount"), 0.02).alias("nq"), g.quantised(c("l_extendedprice"), 20000.0).alias("dq"), c("l_returnflag").alias("material")).agg(F.count("*").alias("n")).where("n >= 5")


@query("""WITH o AS (SELECT DISTINCT o_custkey AS g FROM orders WHERE o_totalprice > 290000), k AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_custkey IN (SELECT g FROM o)), v AS (SELECT DISTINCT l_partkey FROM lineitem JOIN k ON l_orderkey = id)
SELECT (SELECT count(*) FROM k) AS kept, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM v)) AS with_ring""")
def x32_groups_and_ring(spark, d):
    """All of each group with an observed member, and what shares a vertex with them."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    seen = orders.where("o_totalprice > 290000").select("o_custkey").distinct()
    kept = orders.select("o_orderkey", "o_custkey").join(seen, "o_custkey", "left_semi").select(c("o_orderkey").alias("l_orderkey"))
    vertices = lines.select("l_orderkey", "l_partkey").join(kept, "l_orderkey", "left_semi").select("l_partkey").distinct()
    ring = lines.select("l_orderkey", "l_partkey").join(vertices, "l_partkey", "left_semi").agg(F.count_distinct("l_orderkey").alias("with_ring"))
    return kept.agg(F.count("*").alias("kept")).join(F.broadcast(ring))  # one row each


@query("""WITH o AS (SELECT o_orderkey AS unit FROM orders WHERE o_orderstatus = 'P' UNION SELECT 99999999999), ch AS (SELECT o_orderkey AS unit FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT coalesce(u.o_orderkey, t.unit) AS unit, CASE WHEN u.o_orderkey IS NULL THEN 'unknown' WHEN t.om THEN 'omitted' WHEN t.c THEN 'changed' ELSE 'retained' END AS state
FROM orders u FULL JOIN (SELECT coalesce(o.unit, ch.unit) AS unit, o.unit IS NOT NULL AS om, ch.unit IS NOT NULL AS c FROM o FULL JOIN ch ON o.unit = ch.unit) t ON t.unit = u.o_orderkey""")
def x34_composed_states(spark, d):
    orders = table(spark, d, "orders").select(c("o_orderkey").alias("unit"), "o_orderstatus", "o_orderpriority")
    omitted = orders.where("o_orderstatus = 'P'").select("unit").unionByName(spark.createDataFrame([(99999999999,)], "unit long"))
    return assign.compose(orders, omitted, orders.where("o_orderpriority = '1-URGENT'"), "unit")


@query("""WITH f AS (SELECT p_type AS kind, round_even(p_size / 10.0, 0)::BIGINT AS radius, round_even(p_retailprice / 250.0, 0)::BIGINT AS depth, count(*) AS n, min(p_partkey) AS first_part FROM part GROUP BY 1, 2, 3)
SELECT kind, radius, depth, n, first_part FROM f WHERE n >= 2""")
def p13_families_by_rounded_key(spark, d):
    """Openings and fasteners of one family: equal after rounding, two at least."""
    key = [c("p_type").alias("kind"), g.quantised(c("p_size"), 10.0).alias("radius"), g.quantised(c("p_retailprice"), 250.0).alias("depth")]
    return table(spark, d, "part").groupBy(*key).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part")).where("n >= 2")
