"""Line dedup by distinct-site spread.

A line (trimmed) that stands on at least ``min_sites`` different sites is boilerplate. HyperLogLog sketches of the sites per line hash merge
by aggregation and settle almost all lines; only lines whose estimate is near the threshold are counted exactly. One copy of each
boilerplate line stays, in the document with the least id, so that text which only copies hold is not lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACES, cut, row_key, sized, table

MIN_SITES = 8
#: 2 ** 12 registers: a standard error of 1.6 %.
LG_REGISTERS = 12
#: Numbers (keys and positions of removed lines) up to which they are broadcast; beyond that texts are joined to them by shuffle.
BROADCAST_NUMBERS = 4_000_000


def near_band(min_sites: int, lg_registers: int = LG_REGISTERS) -> float:
    """Half the width of the band around the threshold in which estimates don't decide: six standard errors, one site at least."""
    return max(1.0, 6 * 1.04 / 2 ** (lg_registers / 2) * min_sites)


def _lines(docs: DataFrame) -> DataFrame:
    """One row per line with something in it: hash (128 bits), site, document, position."""
    each = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("_site"), *row_key(F.col("doc_id"), F.col("text")), F.posexplode(F.split("text", "\n")).alias("_pos", "_line"))
    line = F.btrim(F.col("_line"), F.lit(SPACES))
    return each.where(line != "").select(F.xxhash64(line).alias("_h1"), F.xxhash64(F.lit(11), line).alias("_h2"), "_site", "doc_id", "_k1", "_k2", "_pos")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """(_h1, _h2, _first): the lines on ``min_sites`` sites or more; _first: where the copy that stays is (doc_id, _k1, _k2, _pos)."""
    lines = _lines(docs)
    sketched = lines.groupBy("_h1", "_h2").agg(
        F.hll_sketch_agg("_site", F.lit(lg_registers)).alias("_sketch"),
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2", "_pos")).alias("_first"),
    )
    band = near_band(min_sites, lg_registers)
    likely = cut(sketched.select("_h1", "_h2", "_first", F.hll_sketch_estimate("_sketch").alias("_sites")).where(F.col("_sites") >= min_sites - band))
    sure = likely.where(F.col("_sites") > min_sites + band).select("_h1", "_h2", "_first")
    near = likely.where(F.col("_sites") <= min_sites + band).select("_h1", "_h2", "_first")
    exact = lines.join(sized(near.select("_h1", "_h2")), ["_h1", "_h2"]).groupBy("_h1", "_h2").agg(F.count_distinct("_site").alias("_exact")).where(F.col("_exact") >= min_sites)
    return sure.unionByName(near.join(exact.select("_h1", "_h2"), ["_h1", "_h2"]))


def kept_text(text: Column, dropped: Column) -> Column:
    """The text without the lines at the (0-based) positions in ``dropped``."""
    kept = F.transform(F.array(F.split(text, "\n")), lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped), lambda i: F.get(lines, i)))
    return F.array_join(F.get(kept, F.lit(0)), "\n")


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, keep_first: bool = True, lg_registers: int = LG_REGISTERS) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines taken out of ``text``, plus n_removed (long).

    Blank lines are never boilerplate. A null source counts as one site. A null text stays null. Rows with equal id and text count as one
    document, and all of them keep what it keeps; a null id comes after all others. ``keep_first=False`` removes every copy.
    A text may become empty; its row stays. Columns named n_removed, _k1 and _k2 are replaced. An empty table gives an empty result.
    """
    found = cut(boilerplate(docs, min_sites, lg_registers))
    hits = _lines(docs).join(sized(found), ["_h1", "_h2"])
    if keep_first:
        here = F.col("_first")
        hits = hits.where(~((F.col("_k1") == here["_k1"]) & (F.col("_k2") == here["_k2"]) & (F.col("_pos") == here["_pos"]) & F.col("doc_id").eqNullSafe(here["doc_id"])))
    dropped = cut(hits.groupBy("_k1", "_k2").agg(F.collect_set("_pos").alias("_dropped")))
    if (dropped.agg(F.sum(F.size("_dropped") + 4)).first()[0] or 0) <= BROADCAST_NUMBERS:
        dropped = F.broadcast(dropped)
    names = [c for c in docs.columns if c not in ("n_removed", "_k1", "_k2")]
    keyed = docs.select(*names, *row_key(F.col("doc_id"), F.col("text")))
    joined = keyed.join(dropped, ["_k1", "_k2"], "left")
    text = F.when(F.col("_dropped").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("_dropped")))
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in names], F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_removed"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "source", "n_removed", "text")


OP1_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM d WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
b AS (SELECT bare, min((doc_id, pos)) AS place FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT site) >= {MIN_SITES}),
k AS (SELECT t.*, b.bare IS NOT NULL AND (t.doc_id, t.pos) <> b.place AS gone FROM t LEFT JOIN b USING (bare)),
j AS (SELECT r, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT coalesce(gone, false)) AS kept, count(*) FILTER (WHERE gone) AS n FROM k GROUP BY r)
SELECT d.doc_id, d.source, coalesce(j.n, 0)::BIGINT AS n_removed, CASE WHEN d.text IS NULL THEN NULL WHEN coalesce(j.n, 0) = 0 THEN d.text ELSE coalesce(j.kept, '') END AS text
FROM d LEFT JOIN j USING (r)
"""
