"""Every operator and pipeline stage on awkward rows, on an empty table, and with further columns of clashing names."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from refweave.llm import chat, decontaminate, langid, linededup, lm, mixing, nearjoin, quality, rules, toxicity


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "tiny item"), (3, None), (4, ""), (None, "nu xi omicron pi rho sigma tau upsilon"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")], "item_id long, text string")


@pytest.fixture(scope="module")
def run_all(labels, no_labels, benchmark):
    def run(docs, with_labels=True):
        marks = labels if with_labels else no_labels
        return {
            "op1": linededup.dedup_lines(docs),
            "op2": rules.apply_rules(docs, rules.ratios(docs, marks)),
            "op3": langid.identify(docs, langid.fit(docs)),
            "op5": decontaminate.find_leaks(docs, benchmark),
            "op6": quality.score_quality(docs, quality.fit(docs, marks)),
            "op7": toxicity.score_toxicity(docs, toxicity.fit(docs, marks)),
            "op8": mixing.mix_sources(docs),
            "op9": nearjoin.link_near(docs),
            "op10": lm.score_documents(docs),
        }

    return run


PER_ROW = ("op1", "op2", "op3", "op6", "op7", "op9", "op10")


def test_awkward_rows_have_a_result_each(docs, run_all):
    n = docs.count()
    for name, out in run_all(docs).items():
        got = out.collect()
        if name in PER_ROW:
            assert len(got) == n, name
            assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect()), name


def test_empty_table(empty, run_all):
    for name, out in run_all(empty).items():
        assert out.collect() == [], name


def test_without_labels(docs, run_all):
    for name, out in run_all(docs, with_labels=False).items():
        if name in ("op2", "op6", "op7"):
            assert out.count() == docs.count(), name


def test_clashing_columns_change_nothing(docs, clashing, run_all):
    plain, other = run_all(docs), run_all(clashing)
    for name in plain:
        columns = [c for c in plain[name].columns if c not in ("_row", "_k1", "_k2")]
        a = sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in plain[name].select(columns).collect())))
        b = sorted(map(str, (tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in other[name].select(columns).collect())))
        assert a == b, name


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, docs, empty, clashing, labels, benchmark, stage, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.write.parquet(str(tmp_path / "benchmark.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    out = run(spark, docs, str(tmp_path))
    assert set(docs.columns) <= set(out.columns) if stage == "source mixing" else out.columns == docs.columns
    assert out.count() > 50
    assert run(spark, empty, str(tmp_path)).count() == 0
    more = run(spark, clashing, str(tmp_path))
    assert more.count() == out.count()


def test_pipeline_on_empty_tables(spark, empty, benchmark, no_labels, tmp_path):
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    no_labels.write.parquet(str(tmp_path / "labels.parquet"))
    benchmark.limit(0).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_conversations_with_awkward_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", "</s>[INST] x [/INST]"), (2, None, None, "t"), (None, 0, "assistant", "no id"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"),
            (4, 0, "odd\nrole\\n <s>", "[\\/INST] [INST]<\\\\s>"), (4, 1, "assistant", "x" * 50_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("_turns", F.lit("mine"))
    got = {r.conv_id: r for r in chat.digest(chat.expand(frame)).collect()}
    import hashlib

    for conv, turns in {1: rows[:3], 2: rows[3:4], None: rows[4:5], 3: rows[5:7], 4: rows[7:]}.items():
        said = "".join((t[2] or "") + "\n" + (t[3] or "") + "\n" for t in turns)
        told = "".join(t[3] or "" for t in turns if t[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest()), conv
        assert (r.loss_chars, r.loss_sha256) == (len(told), hashlib.sha256(told.encode()).hexdigest()), conv
    assert chat.digest(chat.expand(frame.limit(0))).count() == 0
