"""Long texts in linear time, spans over many blocks, and how many planted names go and how many rare words stay."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from test_llm_operators import spans_by_hand

from tallyframe.llm import pii


def test_spans_over_many_blocks(spark):
    rng = random.Random(18)
    bits = ["a", "b.c", "@", ".", "1", "4111 1111 1111 1111", "4111-1111-1111-1111", "192.168.0.1", "999.1.1.1", "+1 212 555 0123", "+", "(", ") ", " ", "-", "é", "😀", " x@y.zz ", "_", "0", "\n"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(n))) for k, n in enumerate([255, 256, 257, 512, 3000, 9000])]
    got = pii.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("text", pii.spans_text(F.col("base")).alias("s")).collect()
    assert all(r.s == spans_by_hand(r.text) for r in got) and max(r.s.count(",") for r in got) > 700


def test_sixty_thousand_spans_in_one_text(spark):
    text = " ".join(f"😀user{k}@mail.example.com" for k in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "x" * 1_200_000 + " a@b.com " + "y" * 1_200_000)], "doc_id long, text string")
    docs.limit(1).count()
    began = time.perf_counter()
    counts = {r.doc_id: r.n for r in pii.with_spans(docs).select("doc_id", F.size("base").alias("n")).collect()}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert counts == {1: 60_000, 2: 1}
    assert clean[1] == " ".join(["😀[EMAIL]"] * 60_000) and clean[2] == "x" * 1_200_000 + " [EMAIL] " + "y" * 1_200_000
    assert time.perf_counter() - began < 60


@pytest.mark.parametrize("size", [3, 700])
def test_cutting_and_replacing(spark, monkeypatch, size):
    """Parts of a text, and overlapping spans of all kinds replaced up to the end of the last, against a plain loop."""
    monkeypatch.setattr(pii, "CHUNK", 7)
    rng = random.Random(4)
    rows = []
    for k in range(30):
        text = "".join(rng.choice("ab é😀1.") for _ in range(size))
        spans = sorted((a, rng.randrange(6), min(len(text), a + rng.randrange(1, 9))) for a in (rng.randrange(len(text)) for _ in range(size // 2)))
        rows.append((k, text, [(a, r, z, text[a:z]) for a, r, z in spans]))
    df = spark.createDataFrame(rows, f"doc_id long, text string, found {pii._SPAN}")
    parts = pii._let(pii._chunks(F.col("text")), lambda c: F.transform("found", lambda s: pii._cut(c, s["start"], s["end"])))
    assert all(r.cut == [s.value for s in r.found] for r in df.withColumn("cut", parts).collect())
    monkeypatch.setattr(pii, "with_spans", lambda docs, *_: docs.withColumn("base", F.col("found")).withColumn("spans", F.col("found")))
    shown = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    shape = lambda v: "[NUMBER]" if v.isnumeric() else "[CODE]" if any(c.isnumeric() for c in v) else "[TERM]"
    for k, text, spans in rows:
        at, out = 0, ""
        for a, r, z, v in spans:
            if a >= at:
                out += text[at:a] + (shape(v) if pii.KINDS[r] == "term" else pii.REPLACEMENTS[pii.KINDS[r]])
            at = max(at, z)
        assert shown[k] == out + text[at:]


def corpus(seed: int) -> tuple[list[tuple], set[str], set[str]]:
    """Texts full of words that occur once, and people: their names stand beside their addresses, in one to three documents of
    their own, and once in a while short ones. (rows, names, rare words)."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(n))
    common, rare, names = [make(2) for _ in range(200)], set(), set()

    def say(n: int, inside: bool = False) -> str:
        out = []
        for _ in range(n):
            if rng.random() < 0.08:
                out.append(make(5))
                rare.add(out[-1])
            else:
                out.append(rng.choice(common))
        if n > 4:  # sentences
            for k in range(0, n, 9):
                out[k] = out[k].title()
                if k:
                    out[k - 1] += "."
        if inside:
            out[0] = out[0].lower()
        return " ".join(out)

    rows = [say(60) for _ in range(1500)]
    for k in range(120):
        name = make(rng.choice([2, 3, 4])) + rng.choice("kmz") if k % 6 else rng.choice("BKLTZ").lower() + make(1)[1] + rng.choice("mnxy")
        name = f"{name}" if name not in common else name + "q"
        names.add(name)
        for _ in range(1 + k % 3):
            rows.append(f"{say(25)}. Then {rng.choice(common)} {name.title()} wrote to me from p{k}@mail{k % 5}.example.com about {say(25, True)}")
    for _ in range(200):  # addresses without a name
        rows.append(f"{say(25)}. More from box{rng.randrange(10**6)}@mail{rng.randrange(5)}.example.com about {say(25, True)}")
    rng.shuffle(rows)
    return list(enumerate(rows)), names, rare


@pytest.mark.parametrize("seed", [1, 2])
def test_names_go_and_rare_words_stay(spark, seed):
    rows, names, rare = corpus(seed)
    shown = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.with_spans(shown).select(F.explode("spans").alias("s")).where(F.col("s.rank") >= pii.KINDS.index("term")).select(F.lower("s.value").alias("v")).collect()
    values = {r.v for r in found}
    right = len(values & names)
    assert right / len(names) >= 0.9, (right, len(names), sorted(names - values)[:20])
    assert right / len(values) >= 0.9, (right, len(values), sorted(values - names)[:20])
    short = {n for n in names if len(n) <= 3}
    assert len(short & values) >= 0.8 * len(short) and len(short) > 5
    clean = pii.sanitised(shown).collect()
    left = sum(bool(re.search(rf"\b{n}\b", r.text.lower())) for r in clean for n in names)
    assert left <= 0.1 * len(names)
    assert len(rare) > 5000
