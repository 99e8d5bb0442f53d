"""Benchmark decontamination (DataFrame operations only).

Each window of a document that is as long as a benchmark item gets a SimHash fingerprint of its weighted word shingles; votes per bit are
packed into the lanes of a few numbers and roll from window to window. Fingerprints are cut into blocks. Items are indexed by every value
of a block that differs from theirs in up to TOLERANCE bits, so that fingerprints within the radius meet in one block at least. Pairs
within the radius are candidates, and the weighted Jaccard similarity of the shingles decides.

A shingle's weight is its number of occurrences: the second occurrence in a window is a feature of its own, and so on. So the weighted Jaccard
similarity of two windows is the plain one of their features, and fingerprints of similar windows are near whatever repeats in them.
A window that is similar to an item shares a shingle with it; so only documents that have a shingle of an item of a length are looked
through for that length, but then all of their windows of it are.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from .common import SPACES, cut, row_key, sized, table

WORDS = 5
THRESHOLD = 0.8
#: Blocks of a fingerprint, and bits by which a block may differ. Fingerprints that differ in RADIUS bits or fewer have such a block.
BLOCKS, TOLERANCE = 16, 2
RADIUS = BLOCKS * (TOLERANCE + 1) - 1
#: Windows of a document that one row holds on the way, so that a very long document is many rows.
CHUNK = 256


@dataclass(frozen=True)
class Layout:
    """How votes are packed: ``lanes`` of ``width`` bits in a number (the top one stays free, for the sign), ``shifts`` numbers a block,
    ``blocks`` a hash, ``hashes`` a feature. A lane counts to 2 ** (width - 1) - 1, the most shingles of an item.

    Sets of equal size with a similarity of 0.8 have a cosine of 0.89: a bit differs with a chance of 0.15. Of 224 bits 34 differ, with a
    deviation of 5.4; the radius of 47 is 2.4 deviations above, so at the threshold itself under 1 % are missed, and far fewer above it.
    """

    width: int
    lanes: int
    shifts: int
    blocks: int
    hashes: int

    @property
    def most(self) -> int:
        return 2 ** (self.width - 1) - 1

    @property
    def ones(self) -> int:
        return sum(1 << self.width * k for k in range(self.lanes))

    def block_bits(self) -> list[int]:
        """Bits of a hash's first block; the others' are ``shifts`` further each."""
        return sorted(self.width * k + e for k in range(self.lanes) for e in range(self.shifts))


LAYOUTS = (Layout(8, 7, 2, 4, 4), Layout(16, 3, 4, 4, 4), Layout(32, 1, 13, 2, 8))


def words_of(text: Column) -> Column:
    """Lower-cased words, in order; none for a null or blank text."""
    bare = F.btrim(F.lower(text), F.lit(SPACES))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def shingles(words: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order, with repeats."""

    def inner(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))

    one = F.transform(F.array(words), lambda w: F.when(F.size(w) >= size, inner(w)).otherwise(F.array().cast("array<bigint>")))
    return F.get(one, F.lit(0))


def _feature(shingle: Column, occurrence: Column) -> Column:
    return F.when(occurrence == 1, shingle).otherwise(F.xxhash64(shingle, occurrence))


def _occurrences(of: Column, first, length) -> Column:
    """Each shingle as a feature: the how-manieth it is, or how many there are, among ``length(i)`` shingles from ``first(i)`` (from 1) on."""

    def one(x: Column, i: Column) -> Column:
        return _feature(x, F.size(F.filter(F.slice(of, first(i), length(i)), lambda y: y == x)))

    return F.when(F.size(F.array_distinct(of)) == F.size(of), of).otherwise(F.transform(of, one))


def features(of: Column) -> Column:
    """Shingles with repeats as distinct features."""
    return _occurrences(of, lambda i: F.lit(1), lambda i: i + 1)


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two windows, from their features."""
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def _rolled(chunks: DataFrame, layout: Layout, keys: list[str]) -> DataFrame:
    """``chunks`` (``keys``, _a: shingles, _m: shingles of the item, _s: shingles of a window) with a row for each window: its _at in the
    chunk, and the numbers _v0, _v1, ... that hold the votes, as running sums of what comes less what goes."""
    m, kept = F.col("_m"), [c for c in chunks.columns if c != "_a"]
    comes = _occurrences(F.col("_a"), lambda i: F.greatest(i - m + 2, F.lit(1)), lambda i: F.least(i + 1, m))
    goes = _occurrences(F.col("_a"), lambda i: i + 1, lambda i: m)
    both = chunks.select(*kept, comes.alias("_in"), goes.alias("_out"))
    # outer: else the optimizer adds a filter on the arrays' sizes, and they are computed twice
    steps = both.select(*kept, "_out", F.posexplode_outer("_in").alias("_at", "_x")).select(*kept, "_at", "_x", F.get("_out", F.col("_at") - m).alias("_y"))
    ordered = steps.sortWithinPartitions(*keys, "_at")
    hashes = range(layout.hashes)
    zero = F.lit(0).cast("bigint")  # votes for nothing
    hashed = ordered.select(*kept, "_at", *[F.xxhash64("_x", F.lit(t)).alias(f"_i{t}") for t in hashes], *[F.when(F.col("_y").isNull(), zero).otherwise(F.xxhash64("_y", F.lit(t))).alias(f"_o{t}") for t in hashes])

    def votes(of: str, k: int) -> Column:
        return F.shiftrightunsigned(of, k).bitwiseAND(F.lit(layout.ones))

    upto = W.partitionBy(*keys).orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    numbers = [(t, k) for t in hashes for k in range(layout.shifts * layout.blocks)]
    summed = hashed.select(*kept, "_at", *[F.sum(votes(f"_i{t}", k) - votes(f"_o{t}", k)).over(upto).alias(f"_v{j}") for j, (t, k) in enumerate(numbers)])
    return summed.withColumn("_at", F.col("_at") - F.col("_s") + 1).where("_at >= 0")


def fingerprints(chunks: DataFrame, layout: Layout, keys: list[str]) -> DataFrame:
    """``chunks`` as for ``_rolled``, without _a, with _at and _p0, _p1, ...: bits that more than half of a window's features have."""
    rolled = _rolled(chunks, layout, keys)
    numbers = layout.shifts * layout.blocks
    # Lanes above half get their top bit.
    lift = (F.lit(layout.most) - F.floor(F.col("_s") / 2)) * F.lit(layout.ones)

    def one(t: int) -> Column:
        out = F.lit(0).cast("bigint")
        for k in range(numbers):
            top = F.shiftrightunsigned(F.col(f"_v{t * numbers + k}") + F.col("_lift"), layout.width - 1).bitwiseAND(F.lit(layout.ones))
            out = out.bitwiseOR(F.shiftleft(top, k))
        return out

    names = [c for c in rolled.columns if not c.startswith("_v")]
    return rolled.withColumn("_lift", lift.cast("bigint")).select(*names, *[one(t).alias(f"_p{t}") for t in range(layout.hashes)])


def _masks(layout: Layout) -> list[int]:
    """Of the blocks of one hash."""
    first = sum(1 << b for b in layout.block_bits())
    return [first << layout.shifts * j for j in range(layout.blocks)]


def block_values(layout: Layout) -> Column:
    """array of (block, value) from _p0, _p1, ..."""
    return F.array(*[F.struct(F.lit(t * layout.blocks + j).alias("_block"), F.col(f"_p{t}").bitwiseAND(F.lit(mask)).alias("_value")) for t in range(layout.hashes) for j, mask in enumerate(_masks(layout))])


def near_values(prints: DataFrame, layout: Layout) -> DataFrame:
    """``prints`` with a row for each block and each value that differs from its own in up to TOLERANCE bits: _block and _value."""
    bits = layout.block_bits()
    changes = [sum(1 << b for b in some) for n in range(TOLERANCE + 1) for some in combinations(bits, n)]
    spread = prints.withColumn("_b", F.explode(block_values(layout))).withColumn("_change", F.explode(F.array(*[F.lit(c).cast("bigint") for c in changes])))
    # The same change, moved to the block's own bits.
    moved = F.call_function("shiftleft", F.col("_change"), F.col("_b._block") % layout.blocks * layout.shifts)
    return spread.withColumn("_block", F.col("_b._block")).withColumn("_value", F.col("_b._value").bitwiseXOR(moved)).drop("_b", "_change")


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(_k1, _k2, doc_id, item_id, similarity, start_word, n_windows): a row for each document and item with a window that is similar enough;
    the best similarity, the first window that has it, and how many windows pass.

    Items and texts without words match nothing. Items of under five words are one shingle, as are documents' windows of that length. A
    document shorter than an item is one window. Rows with equal id and text count as one document; a repeated item_id is a further item.
    Null ids are kept. Other columns go. Empty tables give an empty result.
    """
    items = cut(benchmark.select("item_id", words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0).select("item_id", "_w", F.least(F.size("_w"), F.lit(WORDS)).alias("_size"), F.monotonically_increasing_id().alias("_item_row")))
    found = None
    for size in sorted(r[0] for r in items.select("_size").distinct().collect()):  # 1 to 5
        own = cut(items.where(F.col("_size") == size).select("item_id", "_item_row", shingles(F.col("_w"), size).alias("_item")).withColumn("_m", F.size("_item")))
        part = _leaks(docs, own, size, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id").limit(0).select("_k1", "_k2", "doc_id", F.lit(None).cast(benchmark.schema["item_id"].dataType).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("int").alias("start_word"), F.lit(None).cast("long").alias("n_windows"))
    return found


def suspects(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """((_doc, _k1, _k2, doc_id, _all), (_doc, _m)): documents with a shingle of an item, their shingles, and these items' lengths."""
    keyed = docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")
    anchors = cut(items.select("_m", F.explode("_item").alias("_sh")).distinct())
    listed = keyed.select("_k1", "_k2", F.explode_outer(shingles(words_of(F.col("text")), size)).alias("_sh"))
    met = cut(listed.join(sized(anchors), "_sh").select("_k1", "_k2", "_m").distinct())
    numbered = cut(met.select("_k1", "_k2").distinct().withColumn("_doc", F.monotonically_increasing_id()))
    # By _doc, not by the join's keys: a row that is repeated very often is cut down before the shuffle, and the join's rows can be split.
    texts = keyed.join(sized(numbered), ["_k1", "_k2"]).dropDuplicates(["_doc"])
    shingled = cut(texts.select("_doc", "_k1", "_k2", "doc_id", shingles(words_of(F.col("text")), size).alias("_all")))
    return shingled, cut(met.join(sized(numbered), ["_k1", "_k2"]).select("_doc", "_m"))


def candidates(shingled: DataFrame, lengths: DataFrame, items: DataFrame, layout: Layout) -> DataFrame:
    """(_doc, _start, _item_row): windows and items of one length whose fingerprints differ in RADIUS bits or fewer."""
    whole = items.select("_item_row", "_m", F.col("_item").alias("_a"), F.col("_m").alias("_s"))
    prints = cut(fingerprints(whole, layout, ["_item_row"]).drop("_s", "_at"))
    key = F.xxhash64("_m", "_block", "_value").alias("_key")
    index = cut(near_values(prints.select("_item_row", "_m", *[f"_p{t}" for t in range(layout.hashes)]), layout).select(key, "_item_row"))
    n = F.size("_all")
    room = F.greatest(F.lit(0), n - F.col("_m"))
    chunks = shingled.join(lengths, "_doc").select("_doc", "_m", F.least(n, "_m").alias("_s"), "_all", F.explode(F.sequence(F.lit(0), room, F.lit(CHUNK))).alias("_c"))
    cutouts = chunks.select("_doc", "_m", "_s", "_c", F.slice("_all", F.col("_c") + 1, F.col("_m") + (CHUNK - 1)).alias("_a"))
    width = int(shingled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["_doc", "_m", "_c"]
    windows = fingerprints(cutouts.repartition(width, *place), layout, place).withColumn("_start", F.col("_c") + F.col("_at"))
    p = [f"_p{t}" for t in range(layout.hashes)]
    windows = cut(windows.select("_doc", "_m", "_start", *p))  # also keeps the optimizer from copying a fingerprint's expression into each block
    looked = windows.select("_doc", "_m", "_start", *p, F.inline(block_values(layout))).select("_doc", "_m", "_start", *p, "_block", key)
    own = prints.select("_item_row", F.col("_m").alias("_im"), *[F.col(x).alias(f"_q{x}") for x in p])
    met = looked.join(sized(index), "_key").join(sized(own), "_item_row").where("_m = _im")
    differ = [F.col(x).bitwiseXOR(F.col(f"_q{x}")) for x in p]
    apart = sum((F.bit_count(d) for d in differ[1:]), F.bit_count(differ[0]))
    return met.where(apart <= RADIUS).select("_doc", "_start", "_item_row").distinct()


def _leaks(docs: DataFrame, items: DataFrame, size: int, threshold: float) -> DataFrame:
    shingled, lengths = suspects(docs, items, size)
    pairs, least = None, 0
    longest = items.agg(F.max("_m")).first()[0]
    for layout in LAYOUTS:
        if least < longest:
            here = F.col("_m").between(least + 1, layout.most)
            part = candidates(shingled, lengths.where(here), items.where(here), layout)
            pairs = part if pairs is None else pairs.unionByName(part)
        least = layout.most
    sets = items.select("_item_row", "item_id", "_m", features(F.col("_item")).alias("_features"))
    checked = cut(pairs).join(shingled, "_doc").join(sized(sets), "_item_row")
    alike = similarity(features(F.col("_win")), F.col("_features"))
    similar = checked.withColumn("_win", F.slice("_all", F.col("_start") + 1, F.col("_m"))).withColumn("_sim", alike).where(F.col("_sim") >= threshold)
    best = similar.groupBy("_doc", "_item_row").agg(
        F.first("_k1").alias("_k1"), F.first("_k2").alias("_k2"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"), F.max("_sim").alias("similarity"), F.max(F.struct("_sim", (-F.col("_start")).alias("s"))).alias("_best"), F.count("*").alias("n_windows")
    )
    return best.select("_k1", "_k2", "doc_id", "item_id", "similarity", (-F.col("_best.s")).alias("start_word"), "n_windows")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, without documents in which ``find_leaks`` finds an item. Columns named _k1 and _k2 are replaced."""
    bad = cut(find_leaks(docs, benchmark, threshold).select("_k1", "_k2").distinct())
    names = [c for c in docs.columns if c not in ("_k1", "_k2")]
    return docs.select(*names, *row_key(F.col("doc_id"), F.col("text"))).join(sized(bad), ["_k1", "_k2"], "left_anti").select(*names)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "start_word", "n_windows")


#: All windows, of an item's length, of all documents that share a shingle with it.
OP5_SQL = rf"""
WITH i AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
it AS (SELECT row_number() OVER () AS r, item_id, least(len(w), {WORDS}) AS k, list_transform(range(0, len(w) - least(len(w), {WORDS}) + 1), lambda p: array_to_string(w[p + 1 : p + least(len(w), {WORDS})], ' ')) AS s FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS q, doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
ds AS (SELECT q, doc_id, k, list_transform(range(0, len(w) - k + 1), lambda p: array_to_string(w[p + 1 : p + k], ' ')) AS s FROM d, (SELECT DISTINCT k FROM it) WHERE len(w) >= k),
sharing AS (SELECT DISTINCT q, k, r FROM (SELECT q, k, unnest(s) AS g FROM ds) JOIN (SELECT r, k, unnest(s) AS g FROM it) USING (k, g)),
win AS (SELECT q, k, r, unnest(range(0, greatest(0, len(ds.s) - len(it.s)) + 1)) AS start FROM sharing JOIN ds USING (q, k) JOIN it USING (r, k)),
pair AS (SELECT q, doc_id, r, item_id, start, it.s AS a, ds.s[start + 1 : start + len(it.s)] AS b FROM win JOIN ds USING (q, k) JOIN it USING (r, k)),
sim AS (SELECT q, doc_id, r, item_id, start, list_sum(list_transform(list_intersect(a, b), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS o, len(a) + len(b) AS t FROM pair),
ok AS (SELECT q, doc_id, r, item_id, start, o / (t - o) AS sim FROM sim WHERE o > 0 AND o / (t - o) >= {THRESHOLD})
SELECT any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, round(max(sim), 6) AS similarity, arg_max(start, (sim, -start))::INT AS start_word, count(*)::BIGINT AS n_windows FROM ok GROUP BY q, r
"""
