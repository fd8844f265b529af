"""Terms that disclose entities of one, two or three contexts."""

from __future__ import annotations

import random

from tallyframe.llm import pii


def test_a_name_beside_an_address_in_few_documents_goes(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, text(40)) for k in range(900)]
    people = [("ottoline", 1), ("peregrin", 2), ("zenobia", 3)]
    for name, many in people:
        rows += [(1000 + len(rows) + j, f"{text(15)} {name} has {name}@mail.example.com {text(15)} {name} says") for j in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    said = {(r.entity, r.term) for r in pii.disclosing_terms(docs).collect()}
    assert said == {(f"0:{name}@mail.example.com", name) for name, _ in people}
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    for i, t in rows:
        held = next((name for name, _ in people if name in t), None)
        assert clean[i] == (t if held is None else t.replace(f"{held}@mail.example.com", "[EMAIL]").replace(held, ""))


def test_common_words_and_small_corpora_are_no_evidence(spark):
    rows = [(k, f"word{k % 7}x and mail a{k}@b.com from friends{k} here") for k in range(12)]
    assert pii.disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
