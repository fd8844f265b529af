"""The pipeline's stages on a small corpus, each against a brute-force version of its own input."""

from __future__ import annotations

import random
import re
import sys
import zlib

import numpy as np
import pytest
from tallyframe.llm import tokens
from tallyframe.llm.storage import staged

sys.path.insert(0, __file__.rsplit("/", 1)[0])
from test_llm_operators import CARD, EMAIL, IP, PHONE, groups_by_hand, spans_by_hand  # noqa: E402

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
REPLACED = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("sf")
    syllables = {"en": "th er on an re he in ed nd ha".split(), "de": "ei ch en sch ung ä ö ber ge te".split()}
    word = {lang: ["".join(rng.choice(s) for _ in range(rng.randint(2, 4))) for _ in range(1500)] for lang, s in syllables.items()}
    text = lambda lang, n: " ".join(rng.choice(word[lang]) for _ in range(n))
    items = [(k, text("en", 30)) for k in range(6)]
    rows = []
    for k in range(120):
        lang = "de" if k % 3 == 0 else "en"
        body = text(lang, rng.randint(20, 200))
        if k % 10 == 1:
            body = f"{body} {items[k % 6][1]} {text(lang, 20)}"
        if k % 8 == 2:
            body = f"{body} mail me{k}@host{k}.example.com or +1 212 555 {1000 + k}, from 10.0.0.{k} {text(lang, 5)}"
        rows.append((k, body, lang))
    rows += [(200 + k, rows[k][1], rows[k][2]) for k in range(0, 30, 5)]  # copies
    rows += [(300, None, "en"), (301, "", "en"), (302, "12 34 !!", "de"), (None, text("en", 40), "en")]
    spark.createDataFrame([(i, t, lang, "src", len(t or "")) for i, t, lang in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def replaced(text):
    spans = [s.split(":") for s in spans_by_hand(text).split(",") if s]
    out, at = [], 0
    for kind, a, z in spans:
        if int(a) >= at:
            out += [text[at : int(a)], REPLACED[kind]]
        at = max(at, int(z))
    return "".join(out) + text[at:]


def test_each_stage_equals_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {i: t for i, t, _ in rows}
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, folder), name)
        if name == "language_id":
            kept = {i: t for i, t in kept.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "near_duplicates":
            groups = groups_by_hand(list(kept.items()))
            kept = {i: t for i, t in kept.items() if i is None or groups[i][1] == i}
        elif name == "decontamination":
            kept = {i: t for i, t in kept.items() if i is None or not any(item in t for _, item in items)}
        elif name == "pii":
            kept = {i: replaced(t) for i, t in kept.items()}
        if name != "packing":
            assert docs.columns == columns
            got = {r.doc_id: r for r in docs.collect()}
            assert {i: r.text for i, r in got.items()} == kept, name
            assert all(r.n_chars == len(r.text) for r in got.values())
    enc = tokens.Encoder(tokens.vocabulary())
    crc = {(-1 if i is None else i): zlib.crc32(np.append(np.frombuffer(enc.whole([t])[0], enc.dtype), 0).astype("<u4").tobytes()) for i, t in kept.items()}
    packed = docs.fillna({"doc_id": -1}).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == crc
    fills = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fills.get(r.sequence_id, 0)
        fills[r.sequence_id] = r.offset + r.length
    assert max(fills.values()) <= 2048
    assert EMAIL and IP and CARD and PHONE


def test_run_gives_the_last_stage(spark, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
