import random
from collections import deque

import pytest
from pyspark.sql import functions as F
from refweave.functions import geometry as g
from refweave.operators import assign, fingerprint, graph
from refweave.shared import numbered, quantiles, ranked


def entities(spark, rows):
    return spark.createDataFrame([(k, i, t, x, r) for k, (i, t, x, r) in enumerate(rows)], "row long, id long, type string, text string, refs array<long>")


def test_references_keep_order_and_repeats(spark):
    e = entities(spark, [(30, "L", "", [32, 31, 31, 32]), (31, "P", "", [70]), (32, "P", "", [])])
    got = sorted(tuple(r) for r in graph.references(e).collect())
    assert got == [(30, 0, -4, 32), (30, 1, -3, 31), (30, 2, -2, 31), (30, 3, -1, 32), (31, 0, -1, 70)]
    assert [tuple(r) for r in graph.unresolved(e).collect()] == [(31, 0, 70)]
    assert graph.argument(graph.references(e), -3).where("src = 30").first().dst == 31
    again = entities(spark, [(1, "A", "old", []), (1, "A", "new", [])])
    assert [r.text for r in graph.last_definitions(again).collect()] == ["new"]


def test_closure_and_components_by_hand(spark):
    rng = random.Random(1)
    for n, m in ((30, 25), (60, 90)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        frame = spark.createDataFrame(edges, "src long, dst long")
        seeds = spark.createDataFrame([(p, rng.randrange(n)) for p in range(5)], "part long, id long")
        got = {}
        for r in graph.forward_closure(frame, seeds).collect():
            got.setdefault(r.part, {})[r.id] = r.round
        for r in seeds.collect():
            far = {r.id: 0}
            queue = deque([r.id])
            while queue:
                x = queue.popleft()
                for a, b in edges:
                    if a == x and b not in far:
                        far[b] = far[x] + 1
                        queue.append(b)
            assert got[r.part] == far
        parent = list(range(n))
        for a, b in edges * n:
            parent[a] = parent[b] = min(parent[a], parent[b])
        found = {r.id: r.root for r in graph.components(frame.toDF("a", "b")).collect()}
        assert all(parent[k] == v for k, v in found.items()) and set(found) == {x for e in edges for x in e if e[0] != e[1]}


def test_blocked_nodes_are_not_crossed(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(0, 1)], "part long, id long")
    blocked = spark.createDataFrame([(2,)], "id long")
    assert sorted(r.id for r in graph.forward_closure(edges, seeds, blocked).collect()) == [1, 4]


def test_narrowed_list_is_frozen(spark):
    """A list is narrowed to what is there as it first appears; a member that comes later isn't added, and lost members aren't followed."""
    edges = spark.createDataFrame([(1, 2), (10, 3)], "src long, dst long")  # 10 is a keyed owner of 1 and brings 3
    seeds = spark.createDataFrame([(0, 1)], "part long, id long")
    keyed = spark.createDataFrame([(10, 1)], "owner long, target long")
    listed = spark.createDataFrame([(20, 0, 2), (20, 1, 3), (20, 2, 9)], "owner long, pos int, member long")
    rows, kept, ended = graph.policy_closure(edges, seeds, keyed, listed)
    assert sorted(r.id for r in rows.collect()) == [1, 2, 3, 10, 20] and ended
    assert [r.member for r in kept.collect()] == [2]
    chain = spark.createDataFrame([(k + 1, k) for k in range(1, 12)], "owner long, target long")
    _, _, ended = graph.policy_closure(edges, seeds, chain, listed.limit(0))
    assert not ended


def test_propagation_prefers_rounds_then_rows(spark):
    edges = spark.createDataFrame([(5, 1, 2), (4, 3, 2), (1, 2, 6)], "row long, a long, b long")
    owned = spark.createDataFrame([(1, 100), (3, 300)], "id long, owner long")
    assert {r.id: r.owner for r in graph.propagate(edges, owned).collect()} == {1: 100, 3: 300, 2: 300, 6: 300}


def test_paths_keep_slots_and_refuse_cycles(spark):
    tops = spark.createDataFrame([(1,)], "id long")
    edges = spark.createDataFrame([(1, 2, 0), (1, 2, 1), (2, 3, 0)], "parent long, child long, slot long")
    assert graph.paths(tops, edges).groupBy("id").count().where("id = 3").first()["count"] == 2
    assert graph.paths(tops, edges, max_depth=1).where("id = 3").count() == 0
    cyclic = edges.unionByName(spark.createDataFrame([(3, 1, 0)], "parent long, child long, slot long"))
    with pytest.raises(Exception, match="cycle"):
        graph.paths(tops, cyclic).collect()
    assert graph.paths(tops, cyclic, fail_on_cycle=False).count() == 5


def test_merkle_and_plans(spark):
    e = entities(spark, [(1, "P", "x", []), (2, "P", "x", []), (3, "L", "l", [1, 2]), (4, "L", "l", [2, 1]), (5, "L", "l", [1]), (6, "T", "t", [3, 5])])
    refs = graph.references(e).select("src", "pos", "dst")
    hashed = fingerprint.merkle(e.select("id", "text"), refs)
    h = {r.id: r.hash for r in hashed.collect()}
    assert h[1] == h[2] and h[3] == h[4] != h[5]
    plan = fingerprint.alias_plan(hashed)
    assert {r.id: r.canonical for r in plan.collect()} == {2: 1, 4: 3}
    kept, moved = fingerprint.apply_plan(e, refs, plan)
    assert fingerprint.prove_plan(e, refs, plan, kept, moved).count() == 0
    assert fingerprint.prove_plan(e, refs, plan, kept.where("id <> 5"), moved).count() > 0
    assert fingerprint.prove_plan(e, refs, plan, kept, moved.where("dst <> 5")).count() > 0
    assert fingerprint.alias_plan(hashed, spark.createDataFrame([(4,), (3,)], "id long")).count() == 1
    for bad in ([(1, "T", "", [1])], [(1, "T", "", [2])], [(1, "T", "", [2]), (2, "T", "", [1])]):
        b = entities(spark, bad)
        with pytest.raises(ValueError):
            fingerprint.merkle(b.select("id", "text"), graph.references(b).select("src", "pos", "dst"))


def test_bijection(spark):
    schema = "src long, pos int, dst long, label string"
    left = spark.createDataFrame([(1, 0, 2, "a"), (1, 1, 3, "a")], schema)
    roots = spark.createDataFrame([(1, 11)], "a long, b long")
    for right, good in (([(11, 0, 12, "a"), (11, 1, 13, "a")], True), ([(11, 0, 12, "a"), (11, 1, 12, "a")], False), ([(11, 0, 12, "a")], False), ([(11, 0, 12, "b"), (11, 1, 13, "b")], False)):
        assert graph.bijection(roots, left, spark.createDataFrame(right, schema))[1] is good


def test_conflicts_and_overlays(spark):
    items = spark.createDataFrame([(1, 5.0), (2, 15.0), (3, 99.0), (4, 10.0)], "item long, x double")
    rules = spark.createDataFrame([(0.0, 10.0, "a", 1), (10.0, 20.0, "b", 1), (14.0, 16.0, "c", 2)], "lo double, hi double, grp string, priority int")
    got = {r.item: (r.group, r.reason) for r in assign.by_priority(assign.matches(items, rules, {"x": ("lo", "hi")}), items, "item", "grp", "priority", F.lit("rest")).collect()}
    assert got == {1: ("a", "rule"), 2: ("c", "rule"), 3: ("rest", "unmatched"), 4: ("rest", "conflict")}
    base = spark.createDataFrame([("p", "x", 2.0, 0.35)], "part string, asset string, linear double, angular double")
    layers = [(spark.createDataFrame([("x", 5.0, None)], "asset string, linear double, angular double"), "asset"), (spark.createDataFrame([("p", None, 0.1)], "part string, linear double, angular double"), "part")]
    assert tuple(assign.overlay(base, layers, ["linear", "angular"]).first()) == ("p", "x", 5.0, 0.1)


def test_row_numbers(spark):
    frame = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    assert [(r.k, r.v) for r in numbered(frame, "k", "v").orderBy("k").collect()] == [(k + 1, k) for k in range(1000)]
    assert numbered(frame.limit(0), "k", "v").count() == 0


def test_boxes_grids_and_rotations(spark):
    import numpy as np

    f = spark.createDataFrame([(0.0, 1.0), (-1.0, 1.0), (5.0, 6.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in f.select(g.classify_box([(F.col("a"), F.col("b"))], [(F.lit(0.0), F.lit(1.0))])).collect()] == ["contained", "straddling", "outside", "unbounded"]
    one = spark.range(1)
    assert tuple(one.select(g.grid_cell(F.lit(1.0), -1.0, 1.0, 0.5), g.grid_cell(F.lit(-1.0), -1.0, 1.0, 0.5)).first()) == (3, 0)
    with pytest.raises(Exception, match="outside"):
        one.select(g.grid_cell(F.lit(1.1), -1.0, 1.0, 0.5)).collect()
    rng = np.random.default_rng(1)
    for _ in range(4):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        q *= np.sign(np.linalg.det(q))
        m = np.eye(4)
        m[:3, :3] = q
        col = g.doubles(m.ravel().tolist())
        x, y, z, w = one.select(g.quaternion(col)).first()[0]
        back = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
        assert np.allclose(back, q)
        r = one.select(g.roll_pitch_yaw(col).alias("r"), g.rigid(col).alias("ok"), g.scale_bound(col).alias("s"), g.valid_placement(col).alias("v")).first()
        c, s = np.cos, np.sin
        rz, ry, rx = (np.array(v) for v in ([[c(r.r.yaw), -s(r.r.yaw), 0], [s(r.r.yaw), c(r.r.yaw), 0], [0, 0, 1]], [[c(r.r.pitch), 0, s(r.r.pitch)], [0, 1, 0], [-s(r.r.pitch), 0, c(r.r.pitch)]], [[1, 0, 0], [0, c(r.r.roll), -s(r.r.roll)], [0, s(r.r.roll), c(r.r.roll)]]))
        assert np.allclose(rz @ ry @ rx, q) and r.ok and r.s >= 1 - 1e-12 and r.v
        frame = np.array(one.select(g.placement(g.doubles([1, 2, 3]), g.doubles((q[:, 2] * 3).tolist()), g.doubles((q[:, 0] * 2 + q[:, 2]).tolist()))).first()[0]).reshape(4, 4)
        assert np.allclose(frame[:3, :3], q) and np.allclose(frame[:3, 3], [1, 2, 3])
    flat = g.doubles([0.0] * 15 + [1.0])
    assert tuple(one.select(g.rigid(flat), g.valid_placement(flat)).first()) == (False, False)
    assert one.select(g.round4(F.lit(1.00005))).first()[0] == 1.0001


def test_incidence_tells_sharing_apart(spark):
    nodes = spark.createDataFrame([(k, "n") for k in range(20)], "id long, text string")
    shared = [(1, 0, 2), (1, 1, 3), (2, 0, 4), (3, 0, 4)]
    apart = [(11, 0, 12), (11, 1, 13), (12, 0, 14), (13, 0, 15)]
    again = [(5, 0, 9), (5, 1, 8), (9, 0, 7), (8, 0, 7)]
    edges = spark.createDataFrame(shared + apart + again, "src long, pos int, dst long")
    got = {r.root: r.hash for r in fingerprint.incidence(nodes, edges, spark.createDataFrame([(1,), (11,), (5,)], "id long")).collect()}
    assert got[1] == got[5] != got[11]


def test_ranks_and_quantiles(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(rng.choice("aab"), float(rng.randrange(50))) for _ in range(500)] + [("c", 1.0), (None, 4.0), ("a", None)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(6)
    got = {r.k: (r.low, r.high) for r in quantiles(frame, "k", "v", {"low": 0.25, "high": 0.99}).collect()}
    for k in ("a", "b", "c", None):
        own = [v for x, v in rows if x == k and v is not None]
        assert np.allclose(got[k], np.percentile(own, [25, 99]))
    ranks = ranked(frame, "r", "k", "v", size="n").collect()
    for k in ("a", "b", "c", None):
        own = [r for r in ranks if r.k == k]
        assert sorted(r.r for r in own) == list(range(1, len(own) + 1)) and {r.n for r in own} == {len(own)}
    assert graph.tree_lines(spark.createDataFrame([(0, i) for i in range(20)] + [(1, i) for i in range(12)], "parent long, child long")).groupBy("parent", "hidden").count().orderBy("parent").collect() == [(0, 12, 8), (1, 0, 12)]


def test_loops_end_by_themselves_or_fail(spark):
    """A chain longer than the cap is an error, never a part of the result; without a cap it is followed to its end."""
    chain = [(i, i + 1) for i in range(6)]
    edges, seeds = spark.createDataFrame(chain, "src long, dst long"), spark.createDataFrame([(0, 0)], "part long, id long")
    spread, owned = spark.createDataFrame([(a, a, b) for a, b in chain], "row long, a long, b long"), spark.createDataFrame([(0, 9)], "id long, owner long")
    side, start = spark.createDataFrame([(a, 0, b, "x") for a, b in chain], "src long, pos long, dst long, label string"), spark.createDataFrame([(0, 0)], "a long, b long")
    calls = [lambda **k: graph.forward_closure(edges, seeds, **k), lambda **k: graph.propagate(spread, owned, **k), lambda **k: graph.bijection(start, side, side, **k)[0]]
    for call in calls:
        with pytest.raises(RuntimeError, match="3 rounds"):
            call(max_rounds=3)
        assert call().count() == call(max_rounds=7).count() == 7
