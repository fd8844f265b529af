"""What near copies are paired by, and what the disk holds meanwhile."""

from __future__ import annotations

import random
import subprocess
import time

import corpus_pipeline
from pyspark.sql import functions as F

from tallyframe.llm import jaccard_join
from tallyframe.sources import staging


def _words(chance, n):
    return " ".join(f"w{chance.randrange(1 << 40):x}" for _ in range(n))


def test_a_passage_that_many_documents_hold_makes_no_pairs(spark, monkeypatch):
    chance, n = random.Random(3), 300
    passage = _words(chance, 60)
    rows = [(k, f"{_words(chance, 70)} {passage} {_words(chance, 70)}") for k in range(n)]
    rows += [(n + k, f"{rows[k][1]} {_words(chance, 5)}") for k in range(20)]  # near copies
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 160), "doc_id long, text string")  # two in a task
    met = []

    def counted(df, name):
        out = staging.staged(df, name)
        met.extend([out.count()] if name == "pairs" else [])
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    got = {r.doc_id: r.component_id for r in jaccard_join.ngram_groups(docs).collect()}
    assert got == {k: k if k < n else k - n for k in range(n + 20)}
    assert len(met) == 1 and met[0] < n  # not about n * n / 2


def test_staged_tables_leave_no_shuffle_files(spark):
    top = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    found = lambda: {x for d in top for x in subprocess.run(["find", d, "-name", "shuffle_*.data"], capture_output=True, text=True).stdout.split()}
    before, was = found(), spark.conf.get(setting, None)
    out = staging.staged(spark.range(100_000).repartition(7, "id").groupBy((F.col("id") % 9_000).alias("k")).count(), "counts")
    until = time.time() + 10
    while found() - before and time.time() < until:
        time.sleep(0.2)
    assert not found() - before and spark.conf.get(setting, None) == was
    assert out.count() == 9_000


def test_texts_stay_where_they_are_when_copies_go(spark):
    chance = random.Random(5)
    rows = [(k, _words(chance, 30), "en", "h", 1) for k in range(40)]
    rows += [(40 + k, rows[k][1], "en", "h", 1) for k in range(10)] + rows[:3] + [(None, rows[39][1], "en", "h", 1), (None, "alone", "en", "h", 1), (None, "alone", "en", "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set(name, "-1")
        out = corpus_pipeline.one_of_each_group(spark, docs, "")
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert got == sorted([(False, k, rows[k][1]) for k in range(40)] + [(True, 0, "alone")])
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
