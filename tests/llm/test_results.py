"""Results against brute force, the queries' SQL, exact round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from refweave.llm import chat, decontaminate, gru, langid, linededup, lm, mixing, nearjoin, quality, registry, rules, textvec, toxicity

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def near(a, b, rel=1e-9):
    return abs(a - b) <= rel * max(1, abs(a), abs(b))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "labels"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    want = sorted(map(str, ({k: v for k, v in sorted(zip(columns, r))} for r in want.fetchall())))
    got = sorted(map(str, ({k: v for k, v in sorted(r.asDict().items())} for r in registry.QUERIES[name](spark, DATA).collect())))
    assert got == want


def base_by_hand(text):
    text = text or ""
    words = re.findall(WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    count = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)]


def test_base_counts_by_hand(spark, rows):
    texts = ["", "  ", "\n\n a\na\n a\n", None, "a b c a b c\n", "x\n", "x", "x\nx\n\nx", "é b\x85c d", "a\r\na\r\n", "\n", "a b a b a b", "#*$ |<> &%"] + [r[1] for r in rows]
    texts += [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    got = []
    for piece in textvec.pieces(batch, max_bytes=20_000):
        counts = rules.base_counts(textvec.Words(*textvec.buffer_of(piece.column(0))))
        got += [[int(v[i]) for v in counts.values()] for i in range(piece.num_rows)]
    assert got == [base_by_hand(t) for t in texts]


def test_rules_ratio_by_hand(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    grams, failed = {}, {}
    for d, t in texts.items():
        words = textvec.Words(*textvec.buffer_of(pa.array([t])))
        grams[d] = np.concatenate([ids for ids, _ in rules.grams(words)])
        n = base_by_hand(t)
        failed[d] = n[0] < 50 or 100 * n[4] > 50 * n[0]
    raw = sum(np.bincount(g, minlength=1 << rules.BITS) for g in grams.values()).astype(float)
    target = sum(np.bincount(grams[d], minlength=1 << rules.BITS) for d in grams if d in good and not failed[d]).astype(float)
    share = (raw + 1) / (raw.sum() + len(raw))
    ratio = np.log((target + 8 * len(raw) * share) / (target.sum() + 8 * len(raw)) / share)
    for r in rules.op2(spark, DATA).collect():
        llr = ratio[grams[r.doc_id]].mean() if len(grams[r.doc_id]) else 0
        assert r.base_failed == failed[r.doc_id] and near(r.llr, llr) and r.kept == (not failed[r.doc_id] and r.llr >= rules.LEAST_RATIO)


def sets_by_hand(texts, n=5):
    out = {}
    for k, t in texts.items():
        w = re.findall(WORD, t or "")
        out[k] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def classes_by_hand(texts, threshold=0.8):
    sets, parent, links = sets_by_hand(texts), {k: k for k in texts}, dict.fromkeys(texts, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) >= threshold * max(len(x), len(y)) and len(x & y) >= threshold * len(x | y) - 1e-9:
                links[a] += 1
                links[b] += 1
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {k: (root(k), links[k]) for k in texts}


def test_jaccard_join_by_hand(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.op9(spark, DATA).collect()}
    assert got == classes_by_hand(texts)


def test_jaccard_join_of_large_group(spark, monkeypatch):
    """A group larger than a block, of copies, near copies and texts just below the threshold."""
    monkeypatch.setattr(nearjoin, "BLOCK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(90):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(60)] = f"x{rng.randrange(500)}"
        texts[i] = " ".join(words)
    texts |= {100 + i: "short one" for i in range(3)} | {200: "", 201: None, 202: " "}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.link_near(frame).collect()}
    assert got == classes_by_hand(texts)
    kept = sorted(r.doc_id for r in nearjoin.keep_one(frame).collect())
    assert kept == sorted({c for c, _ in classes_by_hand(texts).values()})


def test_jaccard_join_with_many_bands(spark):
    """A lower threshold needs more than 64 bands."""
    assert nearjoin.choose_bands(0.6)[0] > 64
    rng = random.Random(6)
    texts = {}
    for i in range(240):
        if i % 2 == 0:
            words = [f"w{i}x{k}" for k in range(80)]
        else:
            words = list(words)
            words[: 14 + rng.randrange(10)] = [f"y{i}"]
        texts[i] = " ".join(words)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links) for r in nearjoin.link_near(frame, 0.6).collect()}
    assert got == classes_by_hand(texts, 0.6)
    # Pairs are counted by their first shared band, wherever it is.
    bands = np.array([[2 * k, 2 * k + 1] for k in range(100)]).T.copy()
    bands[:, 70] = 7
    values, of = np.array([1, 2, 3, 1, 2, 3]), np.array([0, 3, 6])
    for own, want in ((70, [1, 1]), (6, [0, 0])):
        mask = [(1 << own) if own < 64 else 0, (1 << own - 64) if own >= 64 else 0]
        assert nearjoin.compare_cell(np.arange(2), np.ones(2, int), np.zeros(2, int), mask, bands, values, of, 0.6)[0].tolist() == want


def test_bands_reach_recall():
    bands, rows = nearjoin.choose_bands(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= nearjoin.RECALL and 1 - (1 - 0.4**rows) ** bands <= nearjoin.NOISE


def test_leaks_with_edits(spark):
    """Whole and slightly edited passages are found, wherever they stand; parts of passages and loose words are not."""
    rng = random.Random(9)
    item = [f"b{i}" for i in range(50)]
    filler = lambda n: [f"f{rng.randrange(1000)}" for _ in range(n)]
    edited = item[:49] + ["other"]
    far = [w if i % 4 else "z" for i, w in enumerate(item)]
    docs = {1: item, 2: filler(300) + item + filler(200), 3: filler(7) + edited + filler(9), 4: item[:25] + filler(100), 5: far, 6: filler(400), 7: [w.upper() for w in item], 8: item[:46]}
    frame = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(7, "\n".join(item)), (8, " ".join(filler(20)))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert set(got) == {(1, 7), (2, 7), (3, 7), (7, 7), (8, 7)} and got[(1, 7)] == got[(2, 7)] == 1 and near(got[(3, 7)], 45 / 47)
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(frame, benchmark).collect()) == [4, 5, 6]


def test_leaks_with_repeated_words(spark):
    """Passages of 200 words that end in a run of one word, and items that do: similar enough, though fingerprints are far apart."""
    item = lambda k: [f"b{k}x{i}" for i in range(200)]
    tail = lambda k: item(k)[:179] + ["junk"] * 21
    docs = [(k, " ".join(tail(k) if k < 6 else item(k))) for k in range(12)]
    items = [(k, " ".join(item(k) if k < 6 else tail(k))) for k in range(12)]
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(frame, benchmark).collect()}
    assert set(got) == {(k, k) for k in range(12)} and all(near(s, 175 / 217) for s in got.values())


def test_leaks_in_any_order(spark):
    """A passage whose halves are swapped shares nearly all shingles, at other offsets."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    filler = lambda k: [f"f{k}x{i}" for i in range(30)]
    docs = [(1, " ".join(filler(1) + b + a + filler(2))), (2, " ".join(filler(3) + b[:30] + a[:30] + filler(4)))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.find_leaks(frame, spark.createDataFrame([(9, " ".join(a + b))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_windows) for r in got] == [(1, 9, 17)] and near(got[0].similarity, 112 / 120)


def windows_by_hand(text, item, size=5):
    """{start: weighted Jaccard similarity} of all windows of the item's length."""
    cut = lambda w: [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
    doc, of = cut(text.lower().split()), cut(item.lower().split())
    out, a = {}, Counter(of)
    for k in range(max(1, len(doc) - len(of) + 1)):
        b = Counter(doc[k : k + len(of)])
        shared = sum((a & b).values())
        out[k] = shared / (len(of) + sum(b.values()) - shared)
    return out


def test_leaks_by_hand_for_short_and_long_items(spark):
    """Items of two layouts, documents of several chunks, words that repeat: windows at the threshold and above."""
    rng = random.Random(12)
    word = lambda k, n: [f"w{k}x{rng.randrange(n)}" for _ in range(rng.randrange(20, 60))]
    items = {k: " ".join(word(k, 400) + (["again"] * 9 if k % 3 == 0 else []) + word(k, 9)) for k in range(12)}
    items |= {100 + k: " ".join(f"l{k}x{i % 150}" for i in range(190)) for k in range(3)}
    docs = {}
    for k in items:
        for d in range(4):
            words = items[k].split()
            for _ in range(d * len(words) // 60):
                words[rng.randrange(len(words))] = "other"
            docs[10 * k + d] = " ".join([f"f{rng.randrange(99)}" for _ in range(rng.randrange(600))] + words + ["tail"] * rng.randrange(40))
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    want = {}
    for d, text in docs.items():
        item = d // 10
        passing = {k: s for k, s in windows_by_hand(text, items[item]).items() if s >= 0.8}
        if passing:
            want[d, item] = (max(passing.values()), len(passing))
    assert set(got) == set(want) and len(want) > 20
    assert all(near(got[k].similarity, s) for k, (s, _) in want.items())
    assert sum(got[k].n_windows for k in want) >= 0.99 * sum(n for _, n in want.values())


@pytest.mark.parametrize("layout", decontaminate.LAYOUTS)
def test_fingerprints_roll(spark, layout):
    """Rolled votes give what counting each window's features gives, and blocks find all within the radius."""
    from pyspark.sql import functions as F

    rng = random.Random(layout.width)
    rows = [(d, [rng.randrange(-9, 9) * (1 << 40) + rng.randrange(n) for _ in range(30)], m, min(30, m)) for d, (m, n) in enumerate([(5, 9), (12, 3), (40, 999)])]
    frame = spark.createDataFrame(rows, "_doc long, _a array<long>, _m int, _s int")
    got = {(r["_doc"], r["_at"]): r for r in decontaminate.fingerprints(frame, layout, ["_doc"]).collect()}
    single = spark.createDataFrame([(d, at, a[at : at + m]) for d, a, m, s in rows for at in range(30 - s + 1)], "_doc long, _at int, _a array<long>")
    some = single.select("_doc", "_at", F.explode(decontaminate.features(F.col("_a"))).alias("f")).select("_doc", "_at", *[F.xxhash64("f", F.lit(t)).alias(f"h{t}") for t in range(layout.hashes)]).collect()
    assert set(got) == {(r["_doc"], r["_at"]) for r in some}
    votes = {k: [Counter() for _ in range(layout.hashes)] for k in got}
    for r in some:
        for t in range(layout.hashes):
            votes[r["_doc"], r["_at"]][t].update(b for b in range(64) if r[f"h{t}"] >> b & 1)
    bits = [b + layout.shifts * j for j in range(layout.blocks) for b in layout.block_bits()]
    for k, v in votes.items():
        half = rows[k[0]][3] / 2
        assert [got[k][f"_p{t}"] for t in range(layout.hashes)] == [sum(1 << b for b in bits if c[b] > half) for c in v]
    assert len(bits) == len(set(bits)) and layout.blocks * layout.hashes == decontaminate.BLOCKS
    names = [f"_p{t}" for t in range(layout.hashes)]
    prints, moved = [], []
    for i in range(60):
        p = [sum(1 << b for b in bits if rng.random() < 0.5) for _ in names]
        q = list(p)
        for t, b in rng.sample([(t, b) for t in range(layout.hashes) for b in bits], decontaminate.RADIUS):
            q[t] ^= 1 << b
        prints.append((i, *p))
        moved.append((i, *q))
    schema = "i int, " + ", ".join(f"{n} long" for n in names)
    index = decontaminate.near_values(spark.createDataFrame(prints, schema), layout).select(F.col("i").alias("j"), "_block", "_value")
    looked = spark.createDataFrame(moved, schema).select("i", F.inline(decontaminate.block_values(layout)))
    assert looked.join(index, ["_block", "_value"]).where("i = j").select("i").distinct().count() == 60


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * n + s, f"line on {n} sites", f"site{s}") for n in range(1, 40) for s in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for lg in (4, 12):  # with 16 registers only the exact counts can be right
        found = linededup.dedup_lines(frame, min_sites=20, lg_registers=lg)
        got = Counter(r.text for r in found.collect() if r.text)
        assert got == {f"line on {n} sites": n if n < 20 else 1 for n in range(1, 40)}
    assert linededup.dedup_lines(frame, min_sites=20, keep_first=False).where("text <> ''").count() == sum(range(1, 20))


def test_chat_round_trip_and_masks(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> [\\INST]", "a\nb", "", "<s", "s>", "[/INST", " ] [INST] <s></s>"]
    rows = [(1, i, ["user", "assistant", "system"][i % 3], t) for i, t in enumerate(texts)]
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("example").collect()
    assert [e.target_turn for e in examples] == [1, 4, 7]
    from pyspark.sql import functions as F

    back = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("example", chat.read_back(F.col("text")).alias("t")).orderBy("example").collect()
    for e, b in zip(examples, back):
        turns = rows[: e.target_turn + 1]
        assert [(t.role, t.text) for t in b.t] == [(r[2], r[3]) for r in turns]
        masked = e.text[e.loss_start : e.loss_start + e.loss_chars]
        assert e.text.endswith(masked + "</s>") and re.sub(r"([<\[])\\(\\*)(/?s>|/?INST\])", r"\1\2\3", masked) == turns[-1][3]


def test_mix_meets_targets(spark):
    from pyspark.sql import functions as F

    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "small").when(F.col("id") % 10 == 1, F.lit(None)).otherwise("big").alias("source"))
    targets = spark.createDataFrame([("small", 3.0), ("big", 1.0), (None, 1.0), ("absent", 9.0)], "source string, weight double")
    out = mixing.mix_sources(docs, targets).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    # 14 is the weights' sum: an absent source's share stays unfilled only if it isn't among the documents, so weights are over those present
    for source, want in {"small": 12_000, "big": 4_000, None: 4_000}.items():
        assert abs(n[source] - want) < 5 * math.sqrt(want), source
    by = out.where("source = 'small'").groupBy("doc_id").count().groupBy("count").count().collect()
    seen = {r["count"]: r[1] for r in by}
    for k in range(1, 12):
        want = 2000 * math.exp(-6) * 6**k / math.factorial(k)
        assert abs(seen.get(k, 0) - want) < 6 * math.sqrt(want) + 3
    assert out.groupBy("doc_id", "copy").count().where("count > 1").count() == 0
    assert mixing.mix_sources(docs, spark.createDataFrame([("small", 1.0)], "source string, weight double"), epochs=50.0).where("source <> 'small'").count() == 0


def test_language_accuracy(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    out = langid.op3(spark, "/root/testdata/sf0.01").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_windows_cover_all_bytes():
    for n in (0, 1, 5, 124, 125, 126, 128, 129, 250, 251, 1000):
        raw, offsets = np.zeros(n + 7, np.uint8), np.array([0, n, n + 7])
        starts, number = langid.windows(raw, offsets)
        own = starts[: number[0]]
        covered = {p for s in own for p in range(s, min(s + langid.WINDOW, n))}
        filters = {p for s in own for p in range(s, min(s + langid.WINDOW, n) - 3)}
        assert covered == set(range(n)) and filters >= set(range(max(0, n - 3)))


def test_undetermined(spark):
    network = langid.train(pa.chunked_array([["ab cd ef", "xy zw uv"] * 5]), ["aa", "bb"] * 5)
    assert network.predict(pa.array(["12 3", "", None, "ab", "中"]))[0][:3] == ["und"] * 3
    assert "und" not in network.predict(pa.array(["12 3", "", None, "ab", "中"]))[0][3:]
    assert langid.train(pa.chunked_array([pa.array([], pa.string())]), []).predict(pa.array(["a"]))[0] == ["und"]


def test_quality_held_out(spark):
    marks = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    out = [r for r in quality.op6(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in out if r.held_out and r.doc_id in marks]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in out)
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.97 * len(held)


def test_toxicity_held_out_and_pairs(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in toxicity.op7(spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in held) >= 0.94 * len(held)
    # Two terms that are harmless alone: only their product tells, which no sum of weights can.
    rng = random.Random(4)
    texts, y = [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([f"n{rng.randrange(50)}" for _ in range(8)] + ["insult"] * a + ["group"] * b))
        y.append(int(a and b))
    machine = toxicity.train(pa.chunked_array([texts]), np.array(y), {0: 2250, 1: 750})
    alone = machine.score(pa.array(["n1 n2 insult", "n1 n2 group", "n1 n2", "n1 n2 insult group"]))
    assert max(alone[:3]) < 0.5 < alone[3]
    total = machine.factor[toxicity.terms(*textvec.buffer_of(pa.array(["insult group"])), machine.known)[0]]
    assert float((total[0] * total[1]).sum()) != 0


def test_toxicity_calibration_is_the_least_weighted_loss():
    rng = np.random.default_rng(3)
    labels = np.array([0] * 300 + [1] * 200)
    odds = rng.normal(0, 1, 500) + 1.5 * labels
    slope, shift = toxicity.calibrate(odds, labels, {0: 3000, 1: 200})
    many = np.where(labels == 1, 1.0, 10.0)
    target = np.where(labels == 1, 201 / 202, 1 / 302)
    loss = lambda a, b: (many * (np.logaddexp(0, a * odds + b) - target * (a * odds + b))).sum()
    grid = [(loss(slope + da, shift + db), da, db) for da in (-0.02, 0, 0.02) for db in (-0.02, 0, 0.02)]
    assert min(grid)[1:] == (0, 0)
    apart = toxicity.calibrate(np.where(labels == 1, 1.0, -3.0), labels, {0: 3000, 1: 200})
    assert 0 < apart[0] < 50 and -3 < -apart[1] / apart[0] < 1


def test_toxicity_hears_pairs_and_rare_terms_that_one_term_counts_hide():
    rng = random.Random(4)
    noise = lambda: [f"n{rng.randrange(50)}" for _ in range(8)]
    # Each of the two is as frequent in clean as in toxic documents.
    kinds = [(["insult", "group"], 1), (["slur"], 1), (["insult"], 0), (["group"], 0)] * 200
    machine = toxicity.train(pa.chunked_array([[" ".join(noise() + w) for w, _ in kinds]]), np.array([y for _, y in kinds]), {0: 400, 1: 400})
    alone = machine.score(pa.array(["n1 n2 insult", "n1 n2 group", "n1 n2 insult group"]))
    assert max(alone[:2]) < 0.5 < alone[2]
    # Ten toxic documents of 6000, and no clean one, have the rare slur.
    kinds = [([["clear"], []][y < 1] if i >= 20 else ["rareslur"] * y, y) for i in range(6000) for y in [i % 2]]
    machine = toxicity.train(pa.chunked_array([[" ".join(noise() + w) for w, _ in kinds]]), np.array([y for _, y in kinds]), {0: 3000, 1: 3000})
    assert machine.score(pa.array(["n1 n2 n3"]))[0] < 0.5 < machine.score(pa.array(["n1 n2 n3 rareslur"]))[0]


def test_language_model_base_by_hand(spark):
    low = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s or "")
    tokens = {r.doc_id: re.findall(WORD, low(r.text)) + [None] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in tokens}
    count = Counter(w for k, v in tokens.items() if not held[k] for w in v)
    n, v = sum(count.values()), len(count)
    out = lm.op10(spark, DATA).collect()
    for r in out:
        own = tokens[r.doc_id]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(count[w] > 0 for w in own), n) and near(r.base_score, base)
    assert sum(r.score - r.base_score for r in out if r.held_out) > 0


def test_language_model_learns_from_every_training_document(spark):
    """Whichever training documents there are, the model learns from them: none is left out by its id."""
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(40)]
    docs = spark.range(48).select(F.col("id").alias("doc_id"), F.lit(" ".join(words)).alias("text"))
    lexicon = lm.make_lexicon(lm.count_words(docs), docs)
    start = gru.Model(lexicon.id_counts, lm.SEED)
    for k in range(4):
        part = docs.where(F.pmod(F.xxhash64(F.lit(lm.SEED + 1), F.col("doc_id")), F.lit(4)) == k)
        assert part.count() and not np.array_equal(lm.learn_everywhere(part, lexicon, start).flat(), start.flat()), k


def test_language_model_is_a_distribution():
    """Probabilities of all words after any state add up to 1, and a document's score doesn't depend on its neighbours or its batch."""
    rng = np.random.default_rng(2)
    model = gru.Model(np.array([50, 200] + [int(500 / k) for k in range(1, 99)]))
    of = np.array([0, 7, 7, 90, 400, 401])
    tokens = rng.integers(0, 100, 401)
    model.learn(tokens, of, 0.1)
    h = rng.normal(0, 0.5, (3, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(model.log_probability(h, np.full(3, w))[0]) for w in range(100))
    assert np.allclose(total, 1, atol=1e-4)
    together = textvec.sum_by(model.score(tokens, of), of)
    for i in range(5):
        own = tokens[of[i] : of[i + 1]]
        assert abs(model.score(own, np.array([0, len(own)])).sum() - together[i]) < 1e-2


def test_language_model_does_not_depend_on_the_layout(spark, monkeypatch):
    """The same rows in other partitions and orders give the same model and scores."""
    monkeypatch.setattr(lm, "TOKENS_A_TASK", 20_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: (r.score, r.base_score) for r in lm.score_documents(docs.repartition(2)).collect()}
    two = {r.doc_id: (r.score, r.base_score) for r in lm.score_documents(docs.orderBy("text").repartition(9)).collect()}
    assert set(one) == set(two) and all(near(a, b, 1e-4) for k in one for a, b in zip(one[k], two[k]))


def test_language_model_step_by_step():
    """One token at a time, with plain loops over the gates and over all words of the class."""
    rng = np.random.default_rng(5)
    model = gru.Model(np.array([30, 40] + [int(300 / k) for k in range(1, 60)]), seed=2)
    of = np.array([0, 40, 41, 130])
    tokens = rng.integers(0, 61, 130)
    model.learn(tokens, of, 0.1)
    n, got = gru.HIDDEN, model.score(tokens, of)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))
    for d in range(3):
        h, before = [0.0] * n, gru.END
        for place in range(of[d], of[d + 1]):
            a, g = model.x[before].astype(float), [sum(h[i] * float(model.u[i, j]) for i in range(n)) for j in range(3 * n)]
            z, r = [sigmoid(a[j] + g[j]) for j in range(n)], [sigmoid(a[n + j] + g[n + j]) for j in range(n)]
            m = [math.tanh(a[2 * n + j] + r[j] * g[2 * n + j]) for j in range(n)]
            h = [z[j] * h[j] + (1 - z[j]) * m[j] for j in range(n)]
            word = int(tokens[place])
            k = model.of_class[word]
            classes = [math.exp(sum(h[i] * float(model.class_w[i, c]) for i in range(n)) + float(model.class_b[c])) for c in range(len(model.starts) - 1)]
            words = {w: math.exp(sum(h[i] * float(model.word_w[w, i]) for i in range(n)) + float(model.word_b[w])) for w in range(model.starts[k], model.starts[k + 1])}
            assert abs(got[place] - math.log(classes[k] / sum(classes) * words[word] / sum(words.values()))) < 1e-3
            before = word


def test_stretches():
    assert gru.stretches(np.array([0, 3, 3, 13]), 4).tolist() == [0, 3, 7, 11, 13]


def test_convolution_by_hand():
    """Every window, filter and position in plain loops."""
    rng = np.random.default_rng(4)
    network = langid.Network(["aa", "bb", "cc"], rng)
    network.bias[:] = rng.normal(0, 0.1, len(network.bias))
    texts = ["short", "é" * 100 + " and more " * 30, "x" * 125]
    langs, scores = network.predict(pa.array(texts))
    for text, lang, score in zip(texts, langs, scores):
        raw, total = text.encode(), [0.0] * 3
        for at in range(0, max(1, len(raw) - (langid.WINDOW - langid.STEP)), langid.STEP):
            own = raw[at : at + langid.WINDOW]
            x = list(own) + [0] * (langid.WINDOW - len(own))
            pooled = []
            for f in range(langid.FILTERS * len(langid.WIDTHS)):
                width = langid.WIDTHS[f // langid.FILTERS]
                best = max(sum(float(network.bytes[x[p + k], d]) * float(network.filters[k * langid.DIM + d, f]) for k in range(width) for d in range(langid.DIM)) for p in range(langid.STEP))
                pooled.append(max(best + float(network.bias[f]), 0))
            logits = [sum(pooled[f] * float(network.out[f, c]) for f in range(len(pooled))) + float(network.out_bias[c]) for c in range(3)]
            whole = sum(map(math.exp, logits))
            for c in range(3):
                total[c] += math.exp(logits[c]) / whole * len(own) / langid.WINDOW
        assert lang == "abc"[int(np.argmax(total))] * 2 and near(score, max(total) / sum(total), 1e-3)


def test_factorization_by_hand():
    """A double loop over the pairs of a text's terms."""
    rng = np.random.default_rng(6)
    size = 1 << toxicity.BITS
    machine = toxicity.Machine(rng.normal(0, 0.3, size).astype(np.float32), rng.normal(0, 0.3, (size, toxicity.FACTORS)).astype(np.float32), np.ones(size, bool), -0.2)
    texts = pa.array(["You, great insult of a Group", "", "one one one", "some longer words everywhere here"])
    for k, text in enumerate(texts.to_pylist()):
        ids = toxicity.terms(*textvec.buffer_of(texts.slice(k, 1)))[0].tolist()
        low = [w for w in re.split(r"[^0-9a-z]+", text.lower()) if w]
        assert len(ids) == len({w for w in low} | {(w[:n], n) for w in low for n in toxicity.PREFIXES if len(w) > n})
        odds = machine.bias + sum(float(machine.weight[i]) for i in ids)
        odds += sum(float(machine.factor[i] @ machine.factor[j]) for a, i in enumerate(ids) for j in ids[a + 1 :])
        assert near(machine.score(texts)[k], 1 / (1 + math.exp(-odds)), 1e-4)


def test_subword_average_by_hand():
    """The mean of a text's numbers, feature by feature; and fused numbers equal averaging the vectors first."""
    rng = np.random.default_rng(8)
    vectors, layer = rng.normal(0, 1, (1 << quality.BITS, quality.DIM)), rng.normal(0, 1, quality.DIM)
    texts = pa.array(["a small text, of words", "", "é\tü", "the same the same"])
    got = quality.score_piece(texts, (vectors @ layer).astype(np.float32), 0.1)
    for k in range(len(texts)):
        ids = np.concatenate([f for f, _ in quality.features(*textvec.buffer_of(texts.slice(k, 1)))]).tolist()
        words = re.findall(WORD, texts[k].as_py())
        assert len(ids) == len(words) + max(0, len(words) - 1) + sum(max(0, len(w) - n + 1) for w in words for n in quality.CHARS)
        mean = sum((vectors[i] for i in ids), np.zeros(quality.DIM)) / max(1, len(ids))
        assert near(got[k], 1 / (1 + math.exp(-(float(mean @ layer) + 0.1))), 1e-4)


def test_backpropagation_by_differences():
    rng = np.random.default_rng(3)
    model = gru.Model(np.array([5, 9, 8, 7, 6, 5, 4, 3, 2, 1]), seed=1)
    for name in model.NAMES:
        setattr(model, name, getattr(model, name).astype(np.float64) + rng.normal(0, 0.3, getattr(model, name).shape))
    inputs, targets = rng.integers(0, 10, (5, 2)), rng.integers(0, 10, 10)
    fresh = np.zeros((5, 2), bool)
    fresh[0] = True

    def loss():
        states = model.run(inputs, fresh, np.zeros((2, gru.HIDDEN), np.float32))
        return -model.log_probability(states.reshape(-1, gru.HIDDEN), targets)[0].sum()

    kept = []
    states = model.run(inputs, fresh, np.zeros((2, gru.HIDDEN), np.float32), kept)
    grads = [None] + [np.zeros_like(p) for p in model.parameters()[1:]]
    _, back = model.log_probability(states.reshape(-1, gru.HIDDEN), targets, grads)
    for k in range(2, 6):
        p = model.parameters()[k]
        at = tuple(rng.integers(0, n) for n in p.shape)
        old = p[at]
        p[at] = old + 1e-3
        up = loss()
        p[at] = old - 1e-3
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at]))
