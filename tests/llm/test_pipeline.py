"""The pipeline against plain Python, stage by stage, on whole tables."""

import hashlib
import math
import re
from collections import defaultdict

import corpus_pipeline
import pyarrow as pa
import pytest
from refweave.llm import linededup, mixing, quality

from test_results import WORD, classes_by_hand

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows after each stage, {doc_id: row}; the last one by (doc_id, copy)."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [{r.doc_id: r for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        out.append({r.doc_id: r for r in docs.collect()})
    out.append({(r.doc_id, r["copy"]): r for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()})
    return out


def test_quality_stage(spark, stages):
    model = quality.fit(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {d for d, r in stages[0].items() if quality.score_piece(pa.array([r.text]), *model)[0] >= quality.KEEP}
    assert set(stages[1]) == want and all(stages[1][d] == stages[0][d] for d in want)


def test_line_stage(stages):
    sites, place = defaultdict(set), {}
    for d, r in sorted(stages[1].items()):
        for k, line in enumerate((r.text or "").split("\n")):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if bare:
                sites[bare].add(r.source)
                place.setdefault(bare, (d, k))
    want = {}
    for d, r in stages[1].items():
        lines = (r.text or "").split("\n")
        kept = [x for k, x in enumerate(lines) for b in [x.strip(" \t\n\x0b\x0c\r")] if not b or len(sites[b]) < linededup.MIN_SITES or place[b] == (d, k)]
        if kept == lines or "\n".join(kept).strip(" \t\n\x0b\x0c\r"):
            want[d] = "\n".join(kept)
    assert {d: r.text for d, r in stages[2].items()} == want
    assert all(r.n_chars == (len(r.text) if r.text != stages[1][d].text else stages[1][d].n_chars) for d, r in stages[2].items())


def test_near_stage(stages):
    classes = classes_by_hand({d: r.text for d, r in stages[2].items()})
    assert set(stages[3]) == {c for c, _ in classes.values()} and all(stages[3][d] == stages[2][d] for d in stages[3])


def test_benchmark_stage(spark, stages):
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    words = lambda t: re.findall(WORD, (t or "").lower())
    items = [shingles(words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]

    def count(s):
        out = defaultdict(int)
        for x in s:
            out[x] += 1
        return out

    def leaks(text):
        doc = shingles(words(text))
        for item in items:
            if not set(item) & set(doc):
                continue
            a = count(item)
            for k in range(max(1, len(doc) - len(item) + 1)):
                b = count(doc[k : k + len(item)])
                shared = sum(min(n, b[x]) for x, n in a.items() if x in b)
                if shared >= 0.8 * (len(item) + sum(b.values()) - shared):
                    return True
        return False

    assert set(stages[4]) == {d for d, r in stages[3].items() if not leaks(r.text)} and len(stages[4]) < len(stages[3])


def test_mixing_stage(stages):
    size = defaultdict(int)
    for r in stages[4].values():
        size[r.source] += 1
    weight = {s: n**mixing.ALPHA for s, n in size.items()}
    want = set()
    for d, r in stages[4].items():
        rate = weight[r.source] / sum(weight.values()) * len(stages[4]) / size[r.source]
        u = (int(hashlib.md5(f"{mixing.SEED}:{d}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        k, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        want |= {(d, c) for c in range(1, k + 1)}
    assert set(stages[5]) == want and all(r.text == stages[4][d].text for (d, _), r in stages[5].items())


def test_run_is_the_stages(spark, stages):
    assert {(r.doc_id, r["copy"]) for r in corpus_pipeline.run(spark, DATA).collect()} == set(stages[5])
