"""Learning in tasks: each learner sees all rows, in order, in a task of its own."""

import os
import time

from refweave.llm.common import learn_in_task, learn_in_tasks


def test_each_learner_has_all_rows(spark):
    def seen(rows):
        return rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()

    rows = spark.createDataFrame([(3, "c"), (1, "a"), (2, None), (1, "a"), (None, "d")], "doc_id long, text string").repartition(3)
    whole = ([1, 1, 2, 3, None], ["a", "a", None, "c", "d"])
    assert learn_in_task(rows, seen) == whole
    told = learn_in_tasks(rows, [seen, lambda r: r.num_rows, seen, lambda r: "last"])
    assert told == [whole, 5, whole, "last"]
    assert learn_in_tasks(rows.limit(0), [seen, lambda r: r.num_rows]) == [([], []), 0]


def test_learners_run_side_by_side(spark):
    def slow(rows):
        began = time.time()
        time.sleep(2)
        return os.getpid(), began, time.time()

    rows = spark.createDataFrame([(k, str(k)) for k in range(20)], "doc_id long, text string")
    (p, _, end), (q, began, _) = sorted(learn_in_tasks(rows, [slow, slow]), key=lambda x: x[1])
    assert p != q and began < end
