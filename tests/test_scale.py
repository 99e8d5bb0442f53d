"""Queries on tables that the given ones don't show: ties, repeated keys, and what a run leaves and writes."""

import hashlib
import os
import random

import duckdb
from pyspark.sql import functions as F
from refweave import catalog
from refweave.operators import assign, fingerprint, graph
from refweave.shared import Scratch


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over ``tables``: name -> SELECT that makes it."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.execute(f"copy ({sql}) to '{folder}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [x[0] for x in want.description]
    got = catalog.QUERIES[name](spark, str(folder))
    return sorted(tuple(r) for r in got.select(*columns).collect()), sorted(want.fetchall())


def test_blocks_with_halves_and_repeated_orders(spark, tmp_path):
    """25,000 / 50,000 is rounded away from zero; order 4 is twice in a block, order 5 in two blocks."""
    rows = "(1, 7, 25000.0), (2, 7, 60000.0), (3, 7, 125000.0), (6, 7, 150000.0), (4, 7, 50000.0), (4, 7, 51000.0), (0, 8, 10.0), (5, 8, 20.0), (5, 7, 49000.0)"
    got, want = against_sql(spark, tmp_path, "j17_blocked_candidates", orders=f"SELECT a::BIGINT AS o_orderkey, b::BIGINT AS o_custkey, c::DOUBLE AS o_totalprice FROM (VALUES {rows}) t(a, b, c)")
    assert got == want == [(2, 1), (4, 1), (5, 0), (6, 3)]


def shuffled(spark, run):
    """(result, bytes that the run wrote to shuffles), with joins by shuffle as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    try:
        before = written()
        out = run()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return out, written() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_narrowed_lists_are_never_spread_out(spark):
    """300 parts with a member each of one list of 3000: 300 kept rows, not 900,000 on the way."""
    seeds = spark.range(300).select(F.col("id").alias("part"), F.col("id"))
    listed = spark.range(3000).select(F.lit(-1).cast("long").alias("owner"), F.col("id").alias("pos"), F.col("id").alias("member"))
    none = spark.createDataFrame([], "src long, dst long")

    def run():
        rows, kept, ended = graph.policy_closure(none, seeds, none.toDF("owner", "target"), listed)
        assert rows.count() == 600 and ended
        return kept.count()

    found, size = shuffled(spark, run)
    assert found == 300 and size < 1_000_000


def test_spans_tell_none_one_and_many(spark):
    """Least and greatest part against plain closures, with cycles, on a random graph."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(40), rng.randrange(40)) for _ in range(50)] + [(3, None)], "src long, dst long")
    seeds = spark.createDataFrame([(p, rng.randrange(40)) for p in range(8)], "part long, id long")
    want = {}
    for r in graph.forward_closure(edges.where("dst is not null"), seeds).collect():
        want.setdefault(r.id, set()).add(r.part)
    got = {r.id: (r.least, r.most) for r in graph.spans(edges, seeds).collect()}
    assert got == {k: (min(v), max(v)) for k, v in want.items()}
    entities = spark.range(45).select("id", F.lit("x").alias("type"))
    by_spans = assign.span_coverage(entities, graph.spans(edges, seeds)).first()
    ones = sum(len(v) == 1 for v in want.values())
    assert (by_spans.in_none, by_spans.in_one, by_spans.in_many) == (45 - len(want), ones, len(want) - ones)


def test_what_nothing_refers_to_is_hashed_in_slices(spark, tmp_path, monkeypatch):
    """Each reference is looked up once, whatever the depth, and slices give the hashes of one step. Scratch folders go."""
    monkeypatch.setattr(fingerprint, "SLICE", 100)
    depth, tops = 5, 400
    texts = [(k, str(k)) for k in range(depth)] + [(100 + k, str(k % 7)) for k in range(tops)]
    pairs = [(k, 0, k - 1) for k in range(1, depth)] + [(100 + k, pos, (k + pos) % depth) for k in range(tops) for pos in range(depth)]
    nodes, edges = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(pairs, "src long, pos int, dst long")
    h, levels = {}, {}
    for k, text in texts:
        below = [dst for src, _, dst in pairs if src == k]
        h[k] = hashlib.sha256((text + "|" + ",".join(h[x] for x in below) if below else text).encode()).hexdigest()
        levels[k] = max((levels[x] for x in below), default=-1) + 1
    with Scratch(spark) as scratch:
        kept = []

        def keep(df):
            kept.append(scratch.keep(df))
            return kept[-1]

        hashed = fingerprint.merkle(nodes, edges, keep=keep)
        assert {r.id: (r.hash, r.level) for r in hashed.collect()} == {k: (h[k], levels[k]) for k in h}
        assert sum(x.columns == ["id", "hash", "level"] and x.where("id >= 100").count() > 0 for x in kept) == len(pairs) // 100 + 1
        folder = scratch.path.removeprefix("file:")
        assert os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_small_files_of_many_rows_are_not_broadcast(spark):
    """200,000 rows in a file of well under 10 MB that takes more than that as rows: a scratch folder by rows joins it by shuffle, what a
    shuffle has measured as small may still be broadcast, and the session's settings come back."""
    conf = Scratch.BROADCAST
    before = spark.conf.get(conf)
    with Scratch(spark, by_rows=True) as scratch:
        many = scratch.keep(spark.range(0, 200_000, 1, 4).select("id", F.sha2(F.lit("x"), 256).alias("hash")))
        edges = scratch.keep(spark.range(0, 400_000, 1, 4).select(F.col("id").alias("src"), (F.col("id") % 200_000).alias("id")))
        joined = edges.join(many, "id")
        assert joined.count() == 400_000
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and spark.conf.get(Scratch.MEASURED) == before
    assert spark.conf.get(conf) == before and spark.conf.get(Scratch.MEASURED, None) is None


def test_lists_of_any_length_and_children_of_many_levels(spark, monkeypatch):
    """Lists by column and by row in one graph, a child twice, children that are done in different rounds, and no list at all."""
    rng = random.Random(9)
    monkeypatch.setattr(fingerprint, "COLUMNS", 3)
    refs = {k: [rng.randrange(k) for _ in range(rng.randrange(6))] if k > 5 else [] for k in range(24)} | {24: [23]}
    h, levels = {}, {}
    for k in sorted(refs):
        h[k] = hashlib.sha256(("|".join([f"t{k % 3}", ",".join(h[x] for x in refs[k])]) if refs[k] else f"t{k % 3}").encode()).hexdigest()
        levels[k] = max((levels[x] for x in refs[k]), default=-1) + 1
    records = spark.createDataFrame([(k, f"t{k % 3}", v or None if k % 2 else v) for k, v in refs.items()], "id long, text string, refs array<long>")
    with Scratch(spark, by_rows=True) as scratch:
        got = {r.id: (r.hash, r.level) for r in fingerprint.merkle_records(records, keep=scratch.keep).collect()}
    assert got == {k: (h[k], levels[k]) for k in refs}
