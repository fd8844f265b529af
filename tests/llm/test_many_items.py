"""Decontamination against a benchmark of thousands of items."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from tallyframe.llm import decontaminate


def test_copies_and_paraphrases_of_thousands_of_items_are_found(spark):
    rng = random.Random(21)
    names = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(4000)]
    text = lambda n: " ".join(names[int(len(names) * rng.random() ** 3)] for _ in range(n))
    items = [(k, text(rng.randint(15, 60))) for k in range(2500)]
    rows, copies, paraphrases = [(9000 + k, text(150)) for k in range(50)], set(), set()
    for k in range(0, 2500, 5):
        words = items[k][1].split()
        if k % 2:  # every fifth word is another, the answer stays
            words[: -decontaminate.ANSWER : 5] = [rng.choice(names) for _ in words[: -decontaminate.ANSWER : 5]]
        rows.append((k, f"{text(rng.randint(0, 90))} {' '.join(words)} {text(rng.randint(0, 90))}"))
        (paraphrases if k % 2 else copies).add((k, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    got = {(r.doc_id, r.item_id) for r in found.select("doc_id", "item_id").where(F.col("doc_id") == F.col("item_id")).collect()}
    assert copies <= got
    assert len(paraphrases & got) >= 0.98 * len(paraphrases)


def test_every_item_keeps_its_length(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for _ in range(600):
        u = np.unique(rng.integers(1, 3000, 40))
        w = rng.uniform(1, 9, len(u))
        vectors.append((u, w / np.linalg.norm(w)))
    for blocks in decontaminate._blocks(vectors):
        for (a, z, terms), space in zip(blocks, decontaminate.latent_spaces(spark, vectors, blocks), strict=True):
            assert np.allclose(space.T @ space, np.eye(space.shape[1]))
            assert min(((w @ space[np.searchsorted(terms, u)]) ** 2).sum() for u, w in vectors[a:z]) >= decontaminate.RETAINED - 1e-9
