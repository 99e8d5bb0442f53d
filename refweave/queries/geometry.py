"""Scalar functions and numeric operators over values of the tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry as g, part21 as p21
from ..operators import mesh
from ..shared import table
from ..sources import part21
from .base import query

c = F.col


@query("""SELECT n_regionkey AS file, n_nationkey AS id, 'NATION' AS type, 2 AS refs, n_regionkey + 1000 AS first_ref, length(n_name) AS name_chars FROM nation""")
def s1_s4_scan_exchange_text(spark, d):
    """Exchange files made of the nations, one per region, scanned back into records and references."""
    line = F.concat(F.lit("#"), c("n_nationkey").cast("string"), F.lit("=NATION('"), "n_name", F.lit("',#"), (c("n_regionkey") + 1000).cast("string"), F.lit(",/* #5 */#7);"))
    body = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("X;\nDATA;\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n"), F.lit("\nENDSEC;\n")).cast("binary").alias("content"))
    rows = part21.scan(body.select(c("n_regionkey").cast("string").alias("path"), "content"))
    args = F.regexp_extract(c("text").cast("string"), r"\((.*)\)", 1)
    return rows.select(c("file").cast("int").alias("file"), c("id").cast("int").alias("id"), "type", F.size("refs").alias("refs"), F.get("refs", F.lit(0)).cast("int").alias("first_ref"), F.length(p21.first_string_column(args)).cast("bigint").alias("name_chars"))


@query("""WITH t AS (SELECT r_name AS part, '#' || n_nationkey || '=NATION(''' || n_name || ''');' AS line, n_nationkey AS row FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT part, 'DATA;' || chr(10) || string_agg(line, chr(10) ORDER BY row) || chr(10) || 'ENDSEC;' AS content, count(*) AS entities, strlen('DATA;' || chr(10) || string_agg(line, chr(10) ORDER BY row) || chr(10) || 'ENDSEC;')::BIGINT AS bytes FROM t GROUP BY 1""")
def s11_s12_part_files(spark, d):
    line = F.concat(F.lit("#"), c("n_nationkey").cast("string"), F.lit("=NATION('"), "n_name", F.lit("');"))
    rows = table(spark, d, "nation").join(table(spark, d, "region"), c("n_regionkey") == c("r_regionkey")).select(c("r_name").alias("part"), c("n_nationkey").cast("bigint").alias("row"), line.alias("text"))
    return part21.part_text(rows, "DATA;\n", "\nENDSEC;")


@query("""WITH b AS (SELECT o_custkey, count(*) AS parts, sum(n)::BIGINT AS bodies FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1)
SELECT c_custkey AS source, '{"parts":' || coalesce(parts, 0) || ',"bodies":' || coalesce(bodies, 0) || '}' AS manifest FROM customer LEFT JOIN b ON o_custkey = c_custkey""")
def s13_manifest(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(lines, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_custkey").agg(F.count("*").alias("parts"), F.sum("n").alias("bodies"))
    joined = table(spark, d, "customer").select("c_custkey").join(orders, c("c_custkey") == c("o_custkey"), "left")
    return joined.select(c("c_custkey").alias("source"), F.to_json(F.struct(F.coalesce("parts", F.lit(0)).alias("parts"), F.coalesce("bodies", F.lit(0)).alias("bodies"))).alias("manifest"))


@query(r"""SELECT p_partkey AS id, p_name AS decoded, '''' || replace(p_name, '''', '''''') || '''' AS encoded, regexp_replace(p_name, '[^A-Za-z0-9_.\-]+', '_', 'g') || '-' || p_partkey || '.stp' AS file, regexp_full_match(lower(p_brand), '[a-z0-9][a-z0-9-]*') AS slug FROM part""")
def f_strings_and_names(spark, d):
    """Encoded and decoded again; file names; safe slugs."""
    name = c("p_name")
    encoded = p21.udf_of(p21.encode_string, "string")(name)
    return table(spark, d, "part").select(c("p_partkey").alias("id"), p21.udf_of(p21.first_string, "string")(encoded).alias("decoded"), encoded.alias("encoded"), p21.file_name_column(name, c("p_partkey")).alias("file"), p21.safe_slug(F.lower("p_brand")).alias("slug"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[-+0-9.Ee]+'), lambda x: try_cast(x AS DOUBLE)), lambda x: x IS NOT NULL) AS n FROM documents) SELECT doc_id, len(n)::INT AS numbers, n[1] AS first FROM t""")
def f_numbers_in_text(spark, d):
    n = p21.numbers_column(c("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).select("doc_id", F.size("n").alias("numbers"), F.get("n", F.lit(0)).alias("first"))


@query("""SELECT l_returnflag AS k, round_even(sum(l_discount) * 1e4, 0) / 1e4 AS total FROM lineitem GROUP BY 1""")
def f_round4(spark, d):
    """To four decimals, ties to even."""
    return table(spark, d, "lineitem").groupBy(c("l_returnflag").alias("k")).agg(g.round4(F.sum("l_discount")).alias("total"))


@query("""SELECT printf('%.4f,%.4f,%.4f', l_discount, l_tax, l_quantity / 50) AS colour, count(*) AS n FROM lineitem GROUP BY 1""")
def f_colour_keys(spark, d):
    """Spelled once for each distinct colour, so the function meets few rows."""
    distinct = table(spark, d, "lineitem").groupBy("l_discount", "l_tax", "l_quantity").agg(F.count("*").alias("n"))
    key = p21.udf_of(p21.colour_key, "string")(c("l_discount"), c("l_tax"), c("l_quantity") / 50)
    return distinct.select(key.alias("colour"), "n").groupBy("colour").agg(F.sum("n").alias("n"))


@query("""WITH t AS (SELECT event_id, (event_id % 360) * pi() / 180 AS a, value FROM events) SELECT event_id, round(CASE WHEN a > pi() THEN a - 2 * pi() ELSE a END, 6) AS yaw, round(abs(sin(a / 2)), 6) AS qz, round(abs(cos(a / 2)), 6) AS qw, true AS rigid, 1.0::DOUBLE AS bound FROM t WHERE event_id % 360 <> 180
UNION ALL SELECT event_id, round(pi(), 6), 1.0::DOUBLE, 0.0::DOUBLE, true, 1.0::DOUBLE FROM t WHERE event_id % 360 = 180""")
def f_rotations(spark, d):
    """Angles, quaternions, rigidity and norm bounds of turns about the vertical by the event's number of degrees."""
    a = (c("event_id") % 360) * F.lit(float(np.pi)) / 180
    m = g.doubles([F.cos(a), -F.sin(a), 0, c("value"), F.sin(a), F.cos(a), 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    q, yaw = g.quaternion(c("m")), g.roll_pitch_yaw(c("m"))["yaw"]
    bound = F.when(g.scale_bound(c("m")) >= 1 - 1e-9, F.round(F.least(g.scale_bound(c("m")), F.lit(1.0)), 6)).otherwise(g.scale_bound(c("m")))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", F.round(yaw, 6).alias("yaw"), F.round(F.abs(F.get(q, F.lit(2))), 6).alias("qz"), F.round(F.abs(F.get(q, F.lit(3))), 6).alias("qw"), g.rigid(c("m")).alias("rigid"), bound.alias("bound"))


@query("""SELECT o_orderkey AS id, round((o_totalprice / 1e5) * 1080 / (2 * (1 + o_custkey) * tan(0.5)), 6) AS pixels, round(CASE WHEN o_totalprice / 1e6 <= 0.04045 THEN o_totalprice / 1e6 / 12.92 ELSE pow((o_totalprice / 1e6 + 0.055) / 1.055, 2.4) END, 9) AS linear FROM orders""")
def f_projection_and_colour(spark, d):
    price = c("o_totalprice")
    return table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.round(g.projected_error(price / 1e5, 1 + c("o_custkey"), F.lit(1080), F.lit(1.0)), 6).alias("pixels"), F.round(g.srgb_to_linear(price / 1e6), 9).alias("linear"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), k AS (SELECT vec_id, v, v[4]-v[1] AS ux, v[5]-v[2] AS uy, v[6]-v[3] AS uz, v[7]-v[1] AS vx, v[8]-v[2] AS vy, v[9]-v[3] AS vz FROM e)
SELECT vec_id, round(sqrt((uy*vz-uz*vy)**2 + (uz*vx-ux*vz)**2 + (ux*vy-uy*vx)**2) / 2, 6) AS area, round((v[1]+v[4]+v[7])/3, 6) AS cx, round(list_max(v[1:3]) , 6) AS top FROM k""")
def f_triangles(spark, d):
    """Area and centroid of a triangle, and the greatest corner coordinate of a box."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", *[F.slice("v", k, 3).alias(n) for n, k in (("a", 1), ("b", 4), ("k", 7))])
    corner = F.array_max(F.flatten(F.transform(g.corners(c("a"), c("a")), lambda x: x)))
    return e.select("vec_id", F.round(g.triangle_area(c("a"), c("b"), c("k")), 6).alias("area"), F.round(F.get(g.centroid(c("a"), c("b"), c("k")), F.lit(0)), 6).alias("cx"), F.round(corner, 6).alias("top"))


@query("""WITH e AS (SELECT label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), s AS (SELECT label, v, (v[4]-v[1])*(0-v[2]) - (v[5]-v[2])*(0-v[1]) AS d1, (v[7]-v[4])*(0-v[5]) - (v[8]-v[5])*(0-v[4]) AS d2, (v[1]-v[7])*(0-v[8]) - (v[2]-v[8])*(0-v[7]) AS d3,
(v[5]-v[2])*(v[9]-v[3]) - (v[6]-v[3])*(v[8]-v[2]) AS nx, (v[6]-v[3])*(v[7]-v[1]) - (v[4]-v[1])*(v[9]-v[3]) AS ny, (v[4]-v[1])*(v[8]-v[2]) - (v[5]-v[2])*(v[7]-v[1]) AS nz FROM e)
SELECT label, round(max(CASE WHEN ((d1>=0 AND d2>=0 AND d3>=0) OR (d1<=0 AND d2<=0 AND d3<=0)) AND abs(nz) > 1e-12 THEN v[3] - (nx*(0-v[1]) + ny*(0-v[2]))/nz END), 6) AS height FROM s GROUP BY 1""")
def j20_height_over_point(spark, d):
    """Highest triangle over the origin; edges count as inside."""
    v = [F.get("embedding", F.lit(k)).cast("double") for k in range(9)]
    z = g.height_over(F.lit(0.0), F.lit(0.0), v[0:3], v[3:6], v[6:9])
    return table(spark, d, "embeddings").select("label", z.alias("z")).groupBy("label").agg(F.round(F.max("z"), 6).alias("height"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:3], lambda x: x::DOUBLE) AS p FROM embeddings) SELECT a.vec_id, round(min(list_distance(a.p, b.p)), 6) AS residual FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1""")
def j16_nearest_vertex_residual(spark, d):
    """Distance to the nearest other vertex of the same mesh, in blocks."""
    e = table(spark, d, "embeddings").select("label", "vec_id", *[F.get("embedding", F.lit(k)).cast("double").alias(f"x{k}") for k in range(3)])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[["x0", "x1", "x2"]].to_numpy()
        out = np.full(len(p), np.nan)
        for k in range(0, len(p), 128):
            dist = np.sqrt(((p[k : k + 128, None] - p[None]) ** 2).sum(2))
            dist[np.arange(len(dist)), np.arange(k, k + len(dist))] = np.inf
            out[k : k + 128] = dist.min(1)
        return pd.DataFrame({"vec_id": rows["vec_id"], "residual": np.round(out, 6)})

    return mesh.per_group(e, "label", run, "vec_id long, residual double").where("residual < double('infinity')")


@query()
def j18_x1_x2_matched_poses(spark, d):
    """Poses of a label matched one to one with a shuffled, slightly moved copy: how many find their partner."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        p = rows[["x", "y"]].to_numpy()
        order = np.argsort(p[:, 0], kind="stable")
        dist = np.linalg.norm(p[:, None] - (p[order] + 1e-9)[None], axis=2)
        found = mesh.greedy_match(dist, dist <= 1e-7)
        exact = mesh.orbits(p, p[order] + 1e-9, 1e-7)
        return pd.DataFrame({"label": [int(rows["label"].iloc[0])], "n": [len(p)], "matched": [0 if found is None else int((order[found] == np.arange(len(p))).sum())], "exactly_one": [exact is not None]})

    return mesh.per_group(e, "label", run, "label int, n int, matched int, exactly_one boolean", ["vec_id"])


@query()
def w8_x36_sequential_packing(spark, d):
    """Order-dependent packing per customer: chunks of bounded distinct vertices, and shelves of tiles."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
    lines = lines.select(c("o_custkey").alias("mesh"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", c("l_quantity").cast("int").alias("w"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tri = rows[["l_partkey", "l_suppkey", "l_linenumber"]].to_numpy()
        tiles = mesh.pack_shelves(np.column_stack([rows["w"], rows["l_linenumber"]]).astype(int), 128, 16)
        return pd.DataFrame({"mesh": rows["mesh"].iloc[:1], "chunks": [int(mesh.vertex_chunks(tri, 32).max()) + 1], "pages": [int(tiles[:, 0].max()) + 1]})

    return mesh.per_group(lines, "mesh", run, "mesh long, chunks int, pages int", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query()
def h19_h20_x19_congruent_shapes(spark, d):
    """Triangles (from the embeddings) and quarter-turned copies of them, registered by congruence: each copy finds its original."""
    e = table(spark, d, "embeddings").select("label", "vec_id", F.transform(F.slice("embedding", 1, 9), lambda x: x.cast("double")).alias("v"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        quarter = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
        shapes = [np.asarray(v, float).reshape(3, 3) for v in rows["v"]]
        items = shapes + [s[[1, 2, 0]] @ quarter.T + 5 for s in shapes]
        key = lambda p: mesh.loop_key(p, 1e-3)
        one = mesh.register(items, key, lambda a, b: mesh.loops_match(a, b, 1e-6) is not None)
        tri = np.array([[0, 1, 2]])
        two = sum(mesh.congruent(s, tri, [0], t, tri, [0], 1e-6) is not None for s, t in zip(shapes, items[len(shapes) :]))
        return pd.DataFrame({"label": [int(rows["label"].iloc[0])], "shapes": [len(shapes)], "prototypes": [len(set(one))], "congruent": [two]})

    return mesh.per_group(e, "label", run, "label int, shapes int, prototypes int, congruent int", ["vec_id"])


@query("""WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), r AS (SELECT gx * 0.5::DOUBLE AS gx, gy * 0.5::DOUBLE AS gy FROM range(-2, 3) a(gx), range(-2, 3) b(gy))
SELECT gx, gy, count(*) FILTER (WHERE abs(x - gx) <= 0.05 AND abs(y - gy) <= 0.05) > 0 AS blocked FROM r, e GROUP BY 1, 2""")
def x38_any_hit_grid(spark, d):
    """A 5 x 5 grid of rays, blocked if any element stands in the way: each element finds its grid line by rounding, so nothing is paired off."""
    grid = spark.range(25).select(((c("id") % 5) * 0.5 - 1.0).alias("gx"), (F.floor(c("id") / 5) * 0.5 - 1.0).alias("gy"))
    e = table(spark, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    hits = e.select("x", "y", (F.rint(c("x") * 2) / 2).alias("gx"), (F.rint(c("y") * 2) / 2).alias("gy")).where("abs(x - gx) <= 0.05 AND abs(y - gy) <= 0.05").select((c("gx") + 0.0).alias("gx"), (c("gy") + 0.0).alias("gy")).distinct()
    return grid.join(hits.withColumn("_h", F.lit(True)), ["gx", "gy"], "left").select("gx", "gy", F.coalesce("_h", F.lit(False)).alias("blocked"))
