"""N-gram Jaccard join: MinHash banding finds candidates, full n-gram sets decide.

Texts with the same n-gram set are one class member from the start, so copies are never paired. Members that share a band form a bucket;
bands that gather exactly the same members are one bucket. A large bucket is cut into blocks, and each pair of blocks is a cell of bounded
size, dealt over the cluster. In a cell, pairs are compared as a matrix product of n-gram incidences; what leaves it is a number of links
per member and a spanning set of edges, never the pairs. A pair that shares several bands is counted in the first of them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from .common import cut, map_in_arrow, row_key, sized, table
from .textvec import U64, Words, buffer_of, mix, pieces

WORDS = 5
THRESHOLD = 0.8
#: Chance that a pair at the threshold shares a band.
RECALL = 0.99999
#: Chance allowed for a pair at half the threshold.
NOISE = 0.3
#: Members of a block.
BLOCK = 256


def choose_bands(threshold: float, recall: float = RECALL, noise: float = NOISE) -> tuple[int, int]:
    """(bands, rows): the fewest rows a band, with the bands that they need for the recall, that let pass no more than ``noise`` of the
    pairs at half the threshold."""
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if 1 - (1 - (threshold / 2) ** rows) ** bands <= noise:
            break
    return bands, rows


def ngram_sets(raw: np.ndarray, offsets: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each text, sorted, end to end; n + 1 offsets. A text of 1 to n - 1 words is one n-gram."""
    words = Words(raw, offsets)
    grams, at = words.ngrams(n)
    of = np.searchsorted(at, words.of)
    counts = words.counts
    parts, size = [], np.zeros(len(counts), np.int64)
    for i in range(len(counts)):
        if counts[i] >= n:
            part = np.unique(grams[of[i] : of[i + 1]])
        elif counts[i]:
            total = U64(counts[i])
            for h in words.hash[words.of[i] : words.of[i + 1]]:
                total = mix(np.array([total ^ h], U64))[0]
            part = np.array([total], U64)
        else:
            part = np.zeros(0, U64)
        parts.append(part)
        size[i] = len(part)
    return (np.concatenate(parts) if parts else np.zeros(0, U64)), np.concatenate([[0], np.cumsum(size)])


def signatures(grams: np.ndarray, of: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """texts x bands: a 64-bit hash of the ``rows`` minima of each band. Texts without n-grams get zeros."""
    full = np.flatnonzero(np.diff(of) > 0)
    out = np.zeros((len(of) - 1, bands), U64)
    if not len(full):
        return out
    low, high = (grams & U64(0xFFFFFFFF)).astype(np.uint32), (grams >> U64(32)).astype(np.uint32)
    seeds = mix(np.arange(1, 2 * bands * rows + 1, dtype=U64))
    starts = of[full]
    for b in range(bands):
        key = np.full(len(full), b + 1, U64)
        for r in range(rows):
            k = b * rows + r
            values = low * np.uint32((seeds[2 * k] | U64(1)) & U64(0xFFFFFFFF))
            values += high * np.uint32((seeds[2 * k + 1] | U64(1)) & U64(0xFFFFFFFF))
            values ^= values >> np.uint32(15)
            values *= np.uint32(0x2C1B3C6D)
            key = mix(key ^ np.minimum.reduceat(values, starts).astype(U64)) + U64(k)
        out[full, b] = key
    return out


def _sign(bands: int, rows: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                grams, of = ngram_sets(*buffer_of(piece.column(3)), n)
                sign = signatures(grams, of, bands, rows)
                sums = np.zeros(len(grams) + 1, U64)
                np.cumsum(mix(grams ^ U64(0x5BD1E995)), out=sums[1:], dtype=U64)
                more = np.zeros(len(grams) + 1, U64)
                np.cumsum(mix(grams + U64(0x1B873593)), out=more[1:], dtype=U64)
                flat = pa.array(sign.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, flat.__len__() + 1, bands, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), piece.column(2), pa.array((sums[of[1:]] - sums[of[:-1]]).view(np.int64)), pa.array((more[of[1:]] - more[of[:-1]]).view(np.int64)), pa.array(np.diff(of)), lists],
                    names=["_k1", "_k2", "doc_id", "_f1", "_f2", "_n", "_bands"],
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                grams, of = ngram_sets(*buffer_of(piece.column(1)), n)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(pa.array(of.astype(np.int32)), pa.array(grams.view(np.int64)))], names=["_rep", "_set"])

    return run


def overlap_cell(values: np.ndarray, owner: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the ``left`` with the ``right`` of ``n`` sets; ``owner``: whose each value is."""
    _, inverse, seen = np.unique(values, return_inverse=True, return_counts=True)
    # A value of one owner can't be shared; the rest goes through in strips of bounded size.
    column = np.cumsum(seen > 1) - 1
    keep = seen[inverse] > 1
    columns, owners = column[inverse[keep]], owner[keep]
    order = np.argsort(columns, kind="stable")
    columns, owners = columns[order], owners[order]
    shared = np.zeros((len(left), len(right)), np.float32)
    total = int(columns[-1]) + 1 if len(columns) else 0
    strip = 8192
    for at in range(0, total, strip):
        lo, hi = np.searchsorted(columns, [at, at + strip])
        grid = np.zeros((n, min(strip, total - at)), np.float32)
        grid[owners[lo:hi], columns[lo:hi] - at] = 1
        shared += grid[left] @ grid[right].T
    return np.rint(shared).astype(np.int64)


def compare_cell(rep: np.ndarray, copies: np.ndarray, side: np.ndarray, mask: list[int], bands: np.ndarray, values: np.ndarray, of: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each member of a cell, weighted by copies, and edges that connect what its links connect.

    ``side`` is 0 or 1; where all are 0 the cell is a block against itself. ``mask``: the bands whose bucket this is, 64 a number; a pair counts here if
    the first band that it shares is one of them. ``values``, ``of``: the n-gram sets end to end.
    """
    n = len(rep)
    left = np.flatnonzero(side == 0)
    own = len(left) == n
    right = left if own else np.flatnonzero(side == 1)
    links = np.zeros(n, np.int64)
    if not len(left) or not len(right):
        return links, []
    size = np.diff(of)
    shared = overlap_cell(values, np.repeat(np.arange(n), size), n, left, right)
    similar = shared >= threshold * (size[left][:, None] + size[right][None, :] - shared) - 1e-9
    if own:
        similar = np.triu(similar, 1)
    a, b = np.nonzero(similar)
    a, b = left[a], right[b]
    inside = np.array([mask[k // 64] >> k % 64 & 1 for k in range(bands.shape[1])], bool)
    here = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        p, q = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        here[at : at + len(p)] = inside[np.argmax(bands[p] == bands[q], axis=1)]  # all members of a bucket share a band
    a, b = a[here], b[here]
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    for i, j in zip(a.tolist(), b.tolist()):
        i, j = root(i), root(j)
        if i != j:
            parent[max(i, j)] = min(i, j)
            edges.append((int(rep[i]), int(rep[j])))
    return links, edges


def _compare(threshold: float):
    """Rows come ordered by cell; one cell is held at a time."""

    def told(links: list, edges: list) -> pa.RecordBatch:
        one, two = [x[0] for x in links], [x[1] for x in links]
        return pa.RecordBatch.from_arrays(
            [pa.array(one + [e[0] for e in edges], pa.int64()), pa.array([None] * len(one) + [e[1] for e in edges], pa.int64()), pa.array(two + [None] * len(edges), pa.int64())], names=["_a", "_b", "_links"]
        )

    def cell(batch: pa.RecordBatch, links: list, edges: list) -> None:
        bands, sets = batch.column(7), batch.column(8)
        of = np.concatenate([[0], np.cumsum(np.diff(sets.offsets.to_numpy()))])
        rep = batch.column(3).to_numpy()
        n, made = compare_cell(
            rep, batch.column(4).to_numpy(), batch.column(5).to_numpy(), batch.column(6)[0].as_py(), bands.flatten().to_numpy().reshape(batch.num_rows, -1), sets.flatten().to_numpy(), of, threshold
        )
        at = np.flatnonzero(n)
        links.extend(zip(rep[at].tolist(), n[at].tolist()))
        edges.extend(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        links: list = []
        edges: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                now = tuple(keys[lo].tolist())
                if now != key and held:
                    cell(pa.Table.from_batches(held).combine_chunks().to_batches()[0], links, edges)
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
            if len(links) + len(edges) > 10_000:
                yield told(links, edges)
                links, edges = [], []
        if held:
            cell(pa.Table.from_batches(held).combine_chunks().to_batches()[0], links, edges)
        yield told(links, edges)

    return run


def link_near(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """(_k1, _k2, doc_id, class_id, n_links, is_first): one row per row of ``docs``, with its 128-bit ``row_key``.

    Two rows are linked if the sets of their n-word runs have a Jaccard similarity of ``threshold`` or more; texts of 1 to n - 1 words have
    one run. A null, empty or blank text has none and links to nothing. n_links: rows linked to this one. class_id: the least doc_id of all
    that links connect it with (a null id counts as above all others, and is null if alone). is_first: whether this row is the one to keep
    of its class (equal rows share it). Repeated rows are linked rows. Other columns go. An empty table gives an empty result.
    """
    bands, rows = choose_bands(threshold, recall)
    keyed = docs.select(*row_key(F.col("doc_id"), F.col("text")), "doc_id", "text")
    signed = cut(map_in_arrow(keyed, _sign(bands, rows, n), f"_k1 long, _k2 long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, _f1 long, _f2 long, _n long, _bands array<long>"))
    # A member: all rows with one n-gram set. Its name is a number that no other member has, fixed as it is written.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")).alias("_least")
    members = signed.where("_n > 0").groupBy("_f1", "_f2", "_n").agg(F.count("*").alias("_copies"), least, F.min("_bands").alias("_bands"))
    members = cut(members.withColumn("_rep", F.monotonically_increasing_id()))
    keys = members.select("_rep", F.posexplode("_bands").alias("_band", "_key"))
    buckets = keys.groupBy("_band", "_key").agg(F.count("*").alias("_m"), F.bit_xor(F.xxhash64(F.lit(2), "_rep")).alias("_s1"), F.bit_xor(F.xxhash64(F.lit(3), "_rep")).alias("_s2")).where("_m > 1")
    buckets = cut(buckets)
    mask = [F.expr(f"bit_or(if(_band div 64 = {k}, shiftleft(1L, _band % 64), 0L))") for k in range(-(-bands // 64))]
    merged = cut(
        buckets.groupBy("_m", "_s1", "_s2").agg(F.min(F.struct("_band", "_key")).alias("_name"), F.array(*mask).alias("_mask"))
        .select("_name.*", "_m", "_mask", F.monotonically_increasing_id().alias("_bucket"), F.ceil(F.col("_m") / BLOCK).cast("int").alias("_blocks"))
    )
    inside = keys.join(sized(merged), ["_band", "_key"]).select("_rep", "_bucket", "_mask", "_blocks", F.pmod(F.xxhash64(F.lit(5), "_rep"), F.col("_blocks")).cast("int").alias("_block"))
    inside = cut(inside)
    wanted = members.join(sized(cut(inside.select("_rep").distinct())), "_rep", "left_semi")
    source = cut(wanted.select("_rep", F.col("_least._k1").alias("_k1"), F.col("_least._k2").alias("_k2")))
    # By _rep, not by the join's keys: a row that is repeated very often is cut down before the shuffle, and the join's rows can be split.
    texts = keyed.select("_k1", "_k2", "text").join(sized(source), ["_k1", "_k2"]).select("_rep", "text").dropDuplicates(["_rep"])
    sets = map_in_arrow(texts, _sets(n), "_rep long, _set array<long>")
    profile = members.select("_rep", "_copies", "_bands").join(sets, "_rep")
    cells = inside.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "_rep", "_bucket", "_mask", F.least("_block", "_other").alias("_x"), F.greatest("_block", "_other").alias("_y"), F.when(F.col("_block") <= F.col("_other"), 0).otherwise(1).alias("_side")
    )
    dealt = cells.join(profile, "_rep").select("_bucket", "_x", "_y", "_rep", "_copies", "_side", "_mask", "_bands", "_set")
    dealt = dealt.repartition("_bucket", "_x", "_y").sortWithinPartitions("_bucket", "_x", "_y")
    compared = cut(map_in_arrow(dealt, _compare(threshold), "_a long, _b long, _links long"))
    links = compared.where("_links is not null").groupBy(F.col("_a").alias("_rep")).agg(F.sum("_links").alias("_other_links"))
    rooted = components(compared.where("_b is not null").select("_a", "_b"), "_a", "_b").toDF("_rep", "_root")
    found = cut(links.join(rooted, "_rep", "full_outer"))
    placed = members.join(sized(found), "_rep", "left").select("_f1", "_f2", "_n", "_least", F.coalesce("_root", "_rep").alias("_root"), (F.coalesce("_other_links", F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    placed = cut(placed)
    heads = cut(placed.groupBy("_root").agg(F.min("_least").alias("_head"), F.count("*").alias("_size")).where("_size > 1").drop("_size"))
    classed = placed.join(sized(heads), "_root", "left").select("_f1", "_f2", "_n", F.coalesce("_head", "_least").alias("_head"), "n_links")
    joined = signed.select("_k1", "_k2", "doc_id", "_f1", "_f2", "_n").join(classed, ["_f1", "_f2", "_n"], "left")
    alone = F.col("_n") == 0
    return joined.select(
        "_k1",
        "_k2",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("_head.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (alone | ((F.col("_k1") == F.col("_head._k1")) & (F.col("_k2") == F.col("_head._k2")))).alias("is_first"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, n: int = WORDS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs``, all columns, without all but the first of each class of ``link_near``; equal rows are one. Columns named _k1 and
    _k2 are replaced. Texts go through a shuffle only where equal rows are thinned to one, or where too many rows go for a broadcast."""
    rows = link_near(docs, threshold, n, recall).groupBy("_k1", "_k2").agg(F.count("*").alias("_rows"), F.min("is_first").alias("_first"))
    others = cut(rows.where("_rows > 1 or not _first").withColumn("_which", F.monotonically_increasing_id()))
    names = [c for c in docs.columns if c not in ("_k1", "_k2")]
    keyed = docs.select(*names, *row_key(F.col("doc_id"), F.col("text")))
    kept = keyed.join(sized(others.select("_k1", "_k2")), ["_k1", "_k2"], "left_anti").select(*names)
    again = others.where("_first").select("_k1", "_k2", "_which")
    if again.isEmpty():
        return kept
    return kept.unionByName(keyed.join(sized(again), ["_k1", "_k2"]).dropDuplicates(["_which"]).select(*names))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_near(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
