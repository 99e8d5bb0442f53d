"""Histograms, summaries, percentiles, top lists and window-like reports."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from ..functions import geometry as g
from ..operators import assign, fingerprint, graph
from ..shared import numbered, quantiles, ranked, table
from ..sources.tables import ENTS, REFS, entity_graph
from .base import query

c = F.col
#: Lines of an order, in order: line numbers repeat.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query(f"WITH {ENTS} SELECT type, count(*) AS n FROM ents GROUP BY type")
def a1_type_histogram(spark, d):
    """Records by type, most frequent first, then by name."""
    return entity_graph(spark, d).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query(f"WITH {ENTS} SELECT type, count(*) AS n FROM ents WHERE type NOT IN ('lineitem', 'orders') GROUP BY type")
def a2_histogram_without_types(spark, d):
    return entity_graph(spark, d).where(~c("type").isin("lineitem", "orders")).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


@query("SELECT l_returnflag AS kind, l_linestatus AS target, coalesce(p_brand, '?') AS colour, count(*) AS n FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON l_partkey = p_partkey GROUP BY 1, 2, 3")
def a3_styled_histogram(spark, d):
    """Three keys, '?' where the third doesn't resolve."""
    part = table(spark, d, "part").where("p_size > 10").select("p_partkey", "p_brand")
    joined = table(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus").join(part, c("l_partkey") == c("p_partkey"), "left")
    return joined.groupBy(c("l_returnflag").alias("kind"), c("l_linestatus").alias("target"), F.coalesce("p_brand", F.lit("?")).alias("colour")).agg(F.count("*").alias("n"))


@query("""SELECT p_type AS body_type, count(DISTINCT p_partkey) AS bodies, count(l_orderkey) AS faces, min(l_extendedprice) AS x_min, max(l_extendedprice) AS x_max,
min(l_quantity) AS y_min, max(l_quantity) AS y_max, count(DISTINCT p_brand) AS colours FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1""")
def a4_summarise_bodies(spark, d):
    """Bodies by type with members, extent per axis and colours. Members are summed per body before bodies meet by type."""
    faces = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("f"), *[f(v).alias(n) for n, f, v in (("x0", F.min, "l_extendedprice"), ("x1", F.max, "l_extendedprice"), ("y0", F.min, "l_quantity"), ("y1", F.max, "l_quantity"))])
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand").join(faces, c("p_partkey") == c("l_partkey"), "left")
    return part.groupBy(c("p_type").alias("body_type")).agg(
        F.count("*").alias("bodies"), F.coalesce(F.sum("f"), F.lit(0)).alias("faces"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y0").alias("y_min"), F.max("y1").alias("y_max"), F.count_distinct("p_brand").alias("colours")
    )


@query("""SELECT coalesce(CASE WHEN l_discount > 0.08 THEN 'face ' || l_returnflag END, CASE WHEN o_orderstatus <> 'O' THEN 'shell ' || o_orderstatus END, 'body ' || c_mktsegment) AS colour, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def a5_inherited_colour_histogram(spark, d):
    """A line's own colour, else its order's, else its customer's."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_returnflag")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    joined = lines.join(orders, c("l_orderkey") == c("o_orderkey")).join(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), c("o_custkey") == c("c_custkey"))
    colour = F.coalesce(F.when(c("l_discount") > 0.08, F.concat(F.lit("face "), "l_returnflag")), F.when(c("o_orderstatus") != "O", F.concat(F.lit("shell "), "o_orderstatus")), F.concat(F.lit("body "), "c_mktsegment"))
    return joined.groupBy(colour.alias("colour")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority AS kind, sum(greatest(n - 1, 0))::BIGINT AS extra FROM (SELECT o_orderkey, o_orderpriority, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1")
def a7_extra_bounds(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    joined = table(spark, d, "orders").select("o_orderkey", "o_orderpriority").join(n, c("o_orderkey") == c("l_orderkey"), "left")
    return joined.groupBy(c("o_orderpriority").alias("kind")).agg(F.sum(F.greatest(F.coalesce("n", F.lit(0)) - 1, F.lit(0))).alias("extra"))


@query("""WITH t AS (SELECT o_custkey AS p, list(sha256(o_orderpriority || o_orderstatus) ORDER BY sha256(o_orderpriority || o_orderstatus)) AS k FROM orders GROUP BY 1)
SELECT sha256(array_to_string(k, ',')) AS signature, count(*) AS products, min(p) AS representative FROM t GROUP BY 1 HAVING count(*) >= 2""")
def a10_products_with_equal_bodies(spark, d):
    """Products whose bodies have the same hashes, whatever the order."""
    key = F.sha2(F.concat("o_orderpriority", "o_orderstatus"), 256)
    keyed = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(key)).alias("k"))
    return keyed.groupBy(F.sha2(F.array_join("k", ","), 256).alias("signature")).agg(F.count("*").alias("products"), F.min("o_custkey").alias("representative")).where("products >= 2")


@query(f"WITH {ENTS} SELECT type, count(*) AS records, sum(strlen(text))::BIGINT AS bytes, sum(len(refs))::BIGINT AS refs FROM ents GROUP BY type")
def a11_size_profile(spark, d):
    return entity_graph(spark, d).groupBy("type").agg(F.count("*").alias("records"), F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.size("refs")).alias("refs")).orderBy(F.desc("bytes"), "type")


@query("""WITH o AS (SELECT l_orderkey, list(l_suppkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem GROUP BY 1)
SELECT array_to_string(k, ',') AS members, count(*) AS layers, min(l_orderkey) AS representative FROM o GROUP BY k HAVING count(*) >= 2""")
def a12_equal_ordered_lists(spark, d):
    """Layers with the same ordered list, repeats included."""
    lists = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct(*LINE, (c("l_suppkey") % 3).alias("m")))), lambda x: x["m"]).alias("k"))
    return lists.groupBy(F.array_join("k", ",").alias("members")).agg(F.count("*").alias("layers"), F.min("l_orderkey").alias("representative")).where("layers >= 2")


@query("""WITH f AS (SELECT l_partkey, count(DISTINCT l_returnflag) AS n, count(*) AS w FROM lineitem GROUP BY 1)
SELECT n AS layers, count(*) AS faces, sum(w)::BIGINT AS weight FROM f GROUP BY 1""")
def a13_faces_by_layers(spark, d):
    faces = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_returnflag").alias("layers"), F.count("*").alias("w"))
    return faces.groupBy("layers").agg(F.count("*").alias("faces"), F.sum("w").alias("weight"))


BUDGETS = (0.01, 0.03, 0.05, 0.08)


@query("""SELECT l_shipmode AS model, """.replace("l_shipmode", "l_returnflag") + ", ".join(f"sum(CASE WHEN l_discount <= {b} THEN 1 ELSE 0 END)::BIGINT AS within_{k}" for k, b in enumerate(BUDGETS)) + ", min(l_discount) AS best FROM lineitem GROUP BY 1")
def a15_a16_within_budgets(spark, d):
    """Errors within each budget, and the best, by model."""
    return table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("model")).agg(*[F.sum(F.when(c("l_discount") <= b, 1).otherwise(0)).alias(f"within_{k}") for k, b in enumerate(BUDGETS)], F.min("l_discount").alias("best"))


@query("SELECT least(floor((l_quantity - 1) / 7.0), 6)::INT AS x, least(floor(l_discount / 0.03), 3)::INT AS y, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a17_density_grid(spark, d):
    """Counts by cell over a closed envelope: the upper edge belongs to the last cell, outside is an error."""
    return table(spark, d, "lineitem").groupBy(g.grid_cell(c("l_quantity"), 1.0, 50.0, 7.0).alias("x"), g.grid_cell(c("l_discount"), 0.0, 0.1, 0.03).alias("y")).agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem)
SELECT p_type AS surface, count(*) AS faces, sum(p_size)::BIGINT AS triangles, count(*) FILTER (WHERE p_retailprice < 1000) AS small FROM f JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def a18_surface_summary(spark, d):
    """Shared faces count once."""
    faces = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag").distinct()
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return faces.join(part, c("l_partkey") == c("p_partkey")).groupBy(c("p_type").alias("surface")).agg(F.count("*").alias("faces"), F.sum("p_size").cast("bigint").alias("triangles"), F.count_if(c("p_retailprice") < 1000).alias("small"))


@query("""SELECT o_orderpriority AS kind, round(quantile_cont(o_totalprice, 0.95), 6) AS p95, round(quantile_cont(o_totalprice, 0.99), 6) AS p99,
list_sort(list(o_totalprice))[count(*) // 2 + 1] AS upper_median FROM orders GROUP BY 1""")
def a19_a20_percentiles(spark, d):
    """Interpolated percentiles, and the upper median (element n // 2), by ranks: no task gathers a kind's values."""
    orders = table(spark, d, "orders").select(c("o_orderpriority").alias("kind"), "o_totalprice")
    shares = quantiles(orders, "kind", "o_totalprice", {"p95": 0.95, "p99": 0.99})
    middle = ranked(orders, "r", "kind", "o_totalprice", size="n").where(c("r") == F.floor(c("n") / 2) + 1).select("kind", c("o_totalprice").alias("upper_median"))
    return shares.join(middle, "kind").select("kind", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"), "upper_median")


@query("""SELECT r_name AS region, count(*) AS placements, sum(p_size)::BIGINT AS triangles FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def a21_triangles_over_placements(spark, d):
    uses = table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("n"))
    sized = uses.join(table(spark, d, "part").select("p_partkey", "p_size"), c("l_partkey") == c("p_partkey")).groupBy("l_suppkey").agg(F.sum("n").alias("n"), F.sum(c("n") * c("p_size")).alias("t"))
    up = sized.join(table(spark, d, "supplier"), c("l_suppkey") == c("s_suppkey")).join(table(spark, d, "nation"), c("s_nationkey") == c("n_nationkey")).join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey"))
    return up.groupBy(c("r_name").alias("region")).agg(F.sum("n").alias("placements"), F.sum("t").cast("bigint").alias("triangles"))


@query(f"""WITH {ENTS}, {REFS} SELECT e.type, count(DISTINCT dst) AS shared, count(*) AS uses FROM refs JOIN ents e ON e.id = refs.dst GROUP BY 1""")
def a22_distinct_shared(spark, d):
    e = entity_graph(spark, d)
    used = graph.references(e).groupBy("dst").agg(F.count("*").alias("n"))
    return used.join(e.select("id", "type"), c("dst") == c("id")).groupBy("type").agg(F.count("*").alias("shared"), F.sum("n").alias("uses"))


@query(f"""WITH {ENTS}, a AS (SELECT type, count(*) AS n FROM ents GROUP BY 1), b AS (SELECT type, count(*) AS n FROM (SELECT type, text, min(id) FROM ents GROUP BY type, text) GROUP BY 1)
SELECT type, a.n AS before, coalesce(b.n, 0) AS after FROM a LEFT JOIN b USING (type)""")
def a23_statistics_before_and_after(spark, d):
    e = entity_graph(spark, d)
    after = e.select("type", "text").distinct().groupBy("type").agg(F.count("*").alias("after"))
    return e.groupBy("type").agg(F.count("*").alias("before")).join(after, "type", "left").select("type", "before", F.coalesce("after", F.lit(0)).alias("after"))


@query("""SELECT coalesce(nullif(json_extract_string(props, '$.k'), ''), '(unresolved)') AS colour, count(*) AS n FROM events GROUP BY 1""")
def a24_palette_with_unresolved(spark, d):
    return table(spark, d, "events").groupBy(F.coalesce(F.nullif(F.get_json_object("props", "$.k"), F.lit("")), F.lit("(unresolved)")).alias("colour")).agg(F.count("*").alias("n"))


@query("""SELECT l_partkey AS edge, l_returnflag AS channel, min(l_discount * s_nationkey) AS limit_mm FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""")
def a25_shared_boundary_limits(spark, d):
    """The strictest allowance of all owners of an edge, by channel."""
    scale = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_discount")
    return lines.join(scale, c("l_suppkey") == c("s_suppkey")).groupBy(c("l_partkey").alias("edge"), c("l_returnflag").alias("channel")).agg(F.min(c("l_discount") * c("s_nationkey")).alias("limit_mm"))


@query("""WITH s AS (SELECT DISTINCT l_partkey AS body, l_returnflag AS owner FROM lineitem WHERE l_discount = 0.05)
SELECT CASE WHEN n IS NULL THEN 'unassigned' WHEN n > 1 THEN 'multiple' ELSE 'one' END AS state, count(*) AS bodies FROM part LEFT JOIN (SELECT body, count(*) AS n FROM s GROUP BY 1) ON body = p_partkey GROUP BY 1""")
def a26_selection_coverage(spark, d):
    owned = table(spark, d, "lineitem").where("l_discount = 0.05").groupBy("l_partkey").agg(F.size(F.collect_set("l_returnflag")).alias("n"))
    state = F.when(c("n").isNull(), "unassigned").when(c("n") > 1, "multiple").otherwise("one")
    return table(spark, d, "part").select("p_partkey").join(owned, c("p_partkey") == c("l_partkey"), "left").groupBy(state.alias("state")).agg(F.count("*").alias("bodies"))


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS part, coalesce(a.n, 0) AS "left", coalesce(b.n, 0) AS "right" FROM a FULL JOIN b ON a.k = b.k WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def a27_x27_multiset_difference(spark, d):
    one = lambda f: table(spark, d, "lineitem").where(c("l_returnflag") == f).select(c("l_partkey").alias("part"))
    return assign.multiset_difference(one("A"), one("R"), ["part"])


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 8) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def a28_partial_and_final_merge(spark, d):
    """Sums that each task makes before any shuffle; only the needed columns are read and the date filter reaches the scan."""
    lines = table(spark, d, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return lines.groupBy(c("l_returnflag").alias("flag"), c("l_linestatus").alias("status")).agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 8).alias("avg_disc"), F.count("*").alias("n")
    )


# Windows


@query("""SELECT l_orderkey AS src, l_partkey AS dst, l_linenumber AS pos FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem WHERE l_discount > 0.04) WHERE k = 1""")
def w1_first_match_by_position(spark, d):
    """The first reference of each owner that qualifies: an aggregate, which needs no sort."""
    return table(spark, d, "lineitem").where("l_discount > 0.04").groupBy(c("l_orderkey").alias("src")).agg(F.min_by("l_partkey", F.struct(*LINE)).alias("dst"), F.min("l_linenumber").alias("pos"))


@query("""SELECT user_id, event_id, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS first_value FROM events""")
def w2_first_not_null_in_order(spark, d):
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return table(spark, d, "events").select("user_id", "event_id", F.first(F.when(c("event_type") == "purchase", c("value")), True).over(w).alias("first_value"))


@query("""SELECT l_partkey AS body, l_orderkey AS rep FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY (l_returnflag = 'R') DESC, l_orderkey) AS k FROM lineitem) WHERE k = 1""")
def w3_preferred_owner(spark, d):
    """Owned representations first, then the first one."""
    return table(spark, d, "lineitem").groupBy(c("l_partkey").alias("body")).agg(F.min_by("l_orderkey", F.struct(c("l_returnflag") != "R", "l_orderkey")).alias("rep"))


@query("""WITH n AS (SELECT event_type, event_id, event_id - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS island FROM events)
SELECT event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n FROM n GROUP BY event_type, island""")
def w4_runs_of_consecutive_rows(spark, d):
    """Rows of one kind whose ids follow each other: id less position is the same for all of a run. Positions are over the whole table in the
    order of (kind, id), so that no task has to see all rows of a kind."""
    runs = numbered(table(spark, d, "events").select("event_type", "event_id"), "k", "event_type", "event_id").withColumn("island", c("event_id") - c("k"))
    return runs.groupBy("event_type", "island").agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("*").alias("n")).drop("island")


@query("""SELECT p_name AS name, p_partkey AS node FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS occurrence FROM part) WHERE occurrence = 2""")
def w5_f13_nth_occurrence(spark, d):
    rows = ranked(table(spark, d, "part").select("p_brand", "p_partkey", "p_name"), "o", "p_brand", "p_partkey")
    return rows.where("o = 3").select(c("p_name").alias("name"), c("p_partkey").alias("node"))


@query("""SELECT l_orderkey AS loop, l_linenumber AS pos, l_partkey AS vertex, coalesce(lead(l_partkey) OVER w, first_value(l_partkey) OVER w) AS next_vertex FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""")
def w6_cyclic_next(spark, d):
    w = W.partitionBy("l_orderkey").orderBy(*LINE)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("loop"), c("l_linenumber").alias("pos"), c("l_partkey").alias("vertex"), F.coalesce(F.lead("l_partkey").over(w), F.first("l_partkey").over(w)).alias("next_vertex"))


@query("""SELECT l_orderkey AS mesh, l_linenumber AS pos, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem""")
def w7_offsets_for_concatenation(spark, d):
    w = W.partitionBy("l_orderkey").orderBy(*LINE).rowsBetween(W.unboundedPreceding, -1)
    return table(spark, d, "lineitem").select(c("l_orderkey").alias("mesh"), c("l_linenumber").alias("pos"), F.coalesce(F.sum(c("l_quantity").cast("bigint")).over(w), F.lit(0)).alias("start"))


@query("""SELECT chunk, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS chunk FROM orders) GROUP BY 1""")
def w9_chunks_of_fixed_size(spark, d):
    """Row numbers over the whole table without one task that sees all rows."""
    rows = numbered(table(spark, d, "orders").select("o_orderkey"), "k", "o_orderkey")
    return rows.groupBy(F.floor((c("k") - 1) / 500).alias("chunk")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("SELECT text AS value, dense_rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT o_orderpriority AS text, min(o_orderkey) AS f FROM orders GROUP BY 1)")
def w10_h14_dictionary_by_first_appearance(spark, d):
    return fingerprint.intern(table(spark, d, "orders").select(c("o_orderpriority").alias("value"), "o_orderkey"), "value", "o_orderkey")


@query("""WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT l_orderkey AS loop, array_to_string(list_min(list_transform(range(0, len(v)), lambda k: v[k + 1 :] || v[1 : k])), ',') AS canonical FROM l""")
def w11_least_rotation(spark, d):
    loops = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct(*LINE))), lambda x: x["l_suppkey"]).alias("v"))
    return loops.select(c("l_orderkey").alias("loop"), F.array_join(g.least_rotation(c("v")), ",").alias("canonical"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS r FROM lineitem)
SELECT l_orderkey AS mesh, count(*) AS corners, max(r) AS vertices, sum(r)::BIGINT AS index_sum FROM p GROUP BY 1""")
def x16_x23_dense_renumbering(spark, d):
    """Used entries get dense numbers and references follow; equal entries merge."""
    w = W.partitionBy("l_orderkey").orderBy("l_partkey")
    return table(spark, d, "lineitem").select("l_orderkey", F.dense_rank().over(w).alias("r")).groupBy(c("l_orderkey").alias("mesh")).agg(F.count("*").alias("corners"), F.max("r").cast("bigint").alias("vertices"), F.sum("r").alias("index_sum"))


# Sorts and top lists


@query("SELECT p_brand AS colour, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, colour LIMIT 16")
def t1_t2_top_colours(spark, d):
    return table(spark, d, "part").groupBy(c("p_brand").alias("colour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "colour").limit(16)


@query("SELECT greatest(count(DISTINCT p_brand) - 16, 0)::BIGINT AS more FROM part")
def t2_how_many_more(spark, d):
    return table(spark, d, "part").agg(F.greatest(F.count_distinct("p_brand") - 16, F.lit(0)).alias("more"))


@query("""WITH n AS (SELECT c_nationkey AS parent, c_custkey AS child, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS a FROM customer)
SELECT parent, child, k::BIGINT AS n, CASE WHEN a > 12 THEN a - 8 ELSE 0 END AS hidden FROM n WHERE a <= 12 OR k <= 8""")
def t3_g15_truncated_children(spark, d):
    return graph.tree_lines(table(spark, d, "customer").select(c("c_nationkey").alias("parent"), c("c_custkey").alias("child")))


@query("""SELECT l_orderkey AS body, round(max(l_extendedprice) - min(l_extendedprice), 4) AS extent FROM lineitem GROUP BY 1 ORDER BY extent DESC, body LIMIT 25""")
def t4_t5_largest_bodies(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("body")).agg(F.round(F.max("l_extendedprice") - F.min("l_extendedprice"), 4).alias("extent")).orderBy(F.desc("extent"), "body").limit(25)


@query("""SELECT l_suppkey AS representative, count(*) AS members FROM lineitem GROUP BY 1 ORDER BY members DESC, representative LIMIT 20""")
def t6_t7_top_groups(spark, d):
    return table(spark, d, "lineitem").groupBy(c("l_suppkey").alias("representative")).agg(F.count("*").alias("members")).orderBy(F.desc("members"), "representative").limit(20)


@query("""WITH t AS (SELECT l_orderkey AS mesh, l_linenumber AS row, l_partkey AS a, l_suppkey AS b, l_suppkey % 7 AS c FROM lineitem),
k AS (SELECT *, list_min([[a, b, c], [b, c, a], [c, a, b]]) AS v FROM t) SELECT v[1] AS a, v[2] AS b, v[3] AS c, count(*) AS n, min(mesh * 10 + row) AS first_row FROM k GROUP BY 1, 2, 3""")
def t8_x8_canonical_triangles(spark, d):
    """Triangles equal up to rotation are one, the first seen; winding is kept."""
    t = table(spark, d, "lineitem").select((c("l_orderkey") * 10 + c("l_linenumber")).alias("row"), g.least_rotation(F.array("l_partkey", "l_suppkey", c("l_suppkey") % 7)).alias("v"))
    return t.groupBy(c("v")[0].alias("a"), c("v")[1].alias("b"), c("v")[2].alias("c")).agg(F.count("*").alias("n"), F.min("row").alias("first_row"))


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS k, count(*) OVER () AS n FROM part)
SELECT p_partkey AS sample, k FROM n JOIN (SELECT DISTINCT floor(i * (m - 1) / 95.0)::BIGINT AS w FROM range(0, 96) t(i), (SELECT count(*) AS m FROM part)) ON w = k""")
def t9_t10_even_samples(spark, d):
    """A stable sort, and 96 rows spread evenly over it."""
    part = table(spark, d, "part").select("p_partkey", "p_retailprice")
    rows = numbered(part, "k1", "p_retailprice", "p_partkey")
    last = part.count() - 1
    wanted = spark.range(96).select(F.floor(c("id") * last / 95.0).alias("k")).distinct()
    return rows.select(c("p_partkey").alias("sample"), (c("k1") - 1).alias("k")).join(F.broadcast(wanted), "k")
