"""Filter interaction audit, exact duplicates and collocations: against SQL, plain versions, and odd tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import normal

from tallyframe.llm import phrases
from tallyframe.llm.exact_dedup import deduplicated, with_copies
from tallyframe.llm.filter_audit import interaction_audit, verdicts
from tallyframe.llm.oracles import ORACLE_SQL
from tallyframe.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_filter_interaction_audit", "op12_exact_dedup", "op13_phrase_collocations"])
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normal(ours) == normal(theirs)


# -- exact duplicates --------------------------------------------------------------------------------------------------

ROWS = [(5, "a"), (3, "a"), (9, "a"), (4, None), (2, ""), (None, "a"), (None, "z"), (7, "a "), (8, "A"), (6, "é"), (1, "é"), (11, "x" * 300_000), (12, "x" * 300_000), (9, "a")]


@pytest.mark.parametrize("largest", [True, False])
def test_copies_of_odd_rows(spark, largest):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("H", F.lit(1)).withColumn("keep", F.lit("own")).withColumn("size", F.lit(0))
    groups: dict[str, list] = {}
    for i, t in ROWS:
        groups.setdefault(t or "", []).append(i)
    best = {t: (max if largest else min)((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in ROWS]
    got = with_copies(docs, largest=largest).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    once = deduplicated(docs, largest=largest)
    assert once.columns == docs.columns
    assert sorted((r.text or "", r.doc_id or -1, r.keep) for r in once.collect()) == sorted((t, b or -1, "own") for t, b in best.items())


def test_equal_hashes_are_told_apart_by_bytes(spark):
    """A hash of the first hex digit only: nearly all texts share theirs with others."""
    rows = [(i, f"text {i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = lambda sha: F.encode(F.substring(sha, 1, 1), "utf-8")
    strong = with_copies(docs, carry={"t": F.col("text")}).collect()
    assert sorted(with_copies(docs, carry={"t": F.col("text")}, digest=weak).collect()) == sorted(strong)
    assert all(r.keep_id == int(r.t.split()[1]) and r.group_size == 5 for r in strong)


def test_a_text_of_a_third_of_all_rows(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"cold {i // 2}") for i in range(3000)]
    got = with_copies(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("keep_id").agg(F.count("*").alias("n"), F.first("group_size").alias("g")).collect()
    assert all(r.n == r.g for r in got) and max(r.n for r in got) == 1000


def test_copies_of_an_empty_table_and_no_worker(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert with_copies(docs).count() == 0 and deduplicated(docs).count() == 0
    plan = deduplicated(spark.createDataFrame(ROWS, "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# -- filter audit ------------------------------------------------------------------------------------------------------


def plain_audit(rows: list[tuple]) -> set[tuple]:
    """The contract's rows from (part, good, toxic, flags) by walking every order."""
    out, shapley = [], Counter()
    for order in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            left = [r for r in rows if r[0] == part]
            gone: list[tuple] = []
            for k, f in enumerate(order):
                hit = [r for r in left if r[3]["ABCDE".index(f)]]
                left = [r for r in left if not r[3]["ABCDE".index(f)]]
                alone = [r for r in rows if r[0] == part and r[3]["ABCDE".index(f)] and sum(r[3]) == 1]
                out.append((part, "".join(order), k + 1, len(left), len(hit), sum(r[3]["ABCDE".index(f)] for r in gone), len(alone), sum(r[1] for r in hit), sum(r[2] for r in hit), f))
                shapley[part, f] += len(hit)
                gone += hit
    return {(*r[:9], shapley[r[0], r[9]]) for r in out}


def test_audit_of_odd_documents(spark):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [
        (1, long, "en"), (2, long, "de"), (3, None, None), (4, "", ""), (5, "A B C " * 80, "en"), (6, long + " #", "en"), (7, "same same " * 120, "xx"), (None, long, "en"),
        (8, long.upper(), "en"), (9, " " + long + "\x0b", "de"), (10, long + " Same", None), (10, long + " Same", None), (11, long + " | A", "de"),
    ]
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS).withColumn("A", F.lit(True)).withColumn("part", F.lit("own"))
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (2, 0, None), (6, 1, 1), (6, 0, 0), (None, 1, 1), (10, 1, 0)], "doc_id long, quality int, toxic int")
    good, toxic = {1, 6, 10}, {2, 6}
    judged = []
    for i, t, g in rows:
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)]
        judged.append((g or "", i in good, i in toxic, fails))
    got = {tuple(r) for r in interaction_audit(verdicts(docs, labels)).collect()}
    assert got == plain_audit(judged)
    empty = interaction_audit(verdicts(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0 and empty.columns[:3] == ["part", "filter_order", "step"]


# -- collocations ------------------------------------------------------------------------------------------------------


def plain_collocations(rows: list[tuple], least: int, top: int, max_n: int = 5) -> list[tuple]:
    counts: dict[str, Counter] = {}
    for lang, text in rows:
        held = counts.setdefault("und" if lang is None else lang, Counter())
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            held.update(tuple(w[i : i + k]) for k in range(1, max_n + 1) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        whole = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        found = []
        for p, a in whole.items():
            if any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in whole.items()):
                continue
            s, _, l, r = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            found.append((-s, -a, " ".join(p).encode(), l, r, n))
        out += [(lang, k + 1, x[2].decode(), -x[1], x[3], x[4], x[5], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out)


def _corpus() -> list[tuple]:
    import random

    chance = random.Random(7)
    words = ["the", "The", "a", "of", "café", "x\x01", "x", "new", "York", "city", " ", "\U0001f600", "là", "b|c", "STRAßE"]
    ends = [" ", " ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", " ? "]
    rows = [(chance.choice(["en", "de", None, "x\ty z", ""]), "".join(chance.choice(words) + chance.choice(ends) for _ in range(chance.randrange(60)))) for _ in range(300)]
    return rows + [("en", None), (None, ""), ("en", "the the " * 3000), ("fr", "one two three four five six. " * 9), ("fr", "y" * 100_000 + " z"), ("zz", " . ")]


@pytest.mark.parametrize(("held", "made", "hot", "block"), [(400_000, 4_000_000, 512, 20_000), (50, 70, 4, 40), (50, 1, 40, 1)])
def test_collocations_equal_plain_counts(spark, monkeypatch, held, made, hot, block):
    """Also with much passed on early, words that are hot at a quarter of all suffixes, and blocks of few suffixes."""
    for name, value in (("HELD", held), ("MADE", made), ("HOT", hot), ("BLOCK", block)):
        monkeypatch.setattr(phrases, name, value)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    monkeypatch.setattr(phrases, "small_batches", lambda spark: spark.conf.set(batch, min(block, 2_000)))
    rows = _corpus()
    docs = spark.createDataFrame([(1, t, g, "s", 0) for g, t in rows], DOCS).repartition(3).withColumn("a", F.lit(1)).withColumn("phrase", F.lit("own"))
    for least, top in ((9, 2000), (30, 5)):
        got = sorted(map(tuple, phrases.collocations(docs, least=least, top=top).collect()))
        spark.conf.set(batch, before)
        assert got == plain_collocations(rows, least, top)


def test_collocations_of_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "s", 0), (2, "alone", "en", "s", 0)], DOCS), least=1).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    """One word makes nearly the whole corpus, so 1000 a n passes 2^63 in a made-up count table."""
    from pyspark.sql import DataFrame

    a, n, left, right = 9_007_199_254_740_993, 10**16 + 7, 9_007_199_254_740_999, 9_007_199_254_741_111
    counts = spark.createDataFrame([("en", "u v", ["u", "v"], a), ("en", "u", ["u"], left), ("en", "v", ["v"], right)], "lang string, phrase string, words array<string>, c long")
    sizes = spark.createDataFrame([("en", n)], "lang string, n long")

    def known(*_: object) -> tuple[DataFrame, DataFrame]:
        return sizes, counts

    before, phrases.phrase_counts = phrases.phrase_counts, known
    try:
        (row,) = phrases.collocations(counts).collect()
    finally:
        phrases.phrase_counts = before
    assert row.score == 1000 * a * n // (left * right)
