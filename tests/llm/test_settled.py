"""How a candidate is settled, against sets."""

from __future__ import annotations

import numpy as np

from tallyframe.llm import decontaminate as dc


def test_words_in_common_are_marked_and_cleared():
    rng = np.random.default_rng(5)
    idf = rng.uniform(0.5, 9, 400)
    marks = np.zeros(400, bool)
    kinds = set()
    for _ in range(300):
        item = rng.integers(1, 400, rng.integers(12, 60))
        text = np.concatenate([rng.integers(0, 400, rng.integers(0, 40)), item[rng.random(len(item)) < rng.choice([0.0, 0.6, 0.9, 1.0])], rng.integers(0, 400, 9)])
        got = dc._settled(item, idf[item], text, idf, marks)
        there = np.isin(item, text)
        enough = idf[item[there]].sum() >= dc.PARAPHRASE * idf[item].sum()
        answer = item[-dc.ANSWER :]
        known = bool(idf[answer[np.isin(answer, text)]].sum() >= dc.ANSWERED * idf[answer].sum())
        assert got == ((dc.common_weight(item, text, idf), known) if enough else (0.0, False))
        assert not marks.any()
        kinds.add((enough, known))
    assert len(kinds) >= 3
