"""Memoised ids against a tokenizer of its own, in texts with added tokens' contents."""

from __future__ import annotations

import random

import numpy as np
from tallyframe.llm import tokens
from tokenizers import Tokenizer


def test_ids_equal_a_fresh_tokenizer():
    fresh = Tokenizer.from_file(tokens.vocabulary())
    contents = [t.content for t in fresh.get_added_tokens_decoder().values()]
    assert contents
    rng = random.Random(6)
    bits = [*contents, contents[0][:-1], contents[0][1:], "a", "Bc", "é", "1", ".", " ", " ", "\n", "<", "|>", "漢"]
    texts = ["", f"a {contents[0]} b", *("".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(2000))]
    enc = tokens.Encoder(tokens.vocabulary())
    want = [np.array(fresh.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes() for t in texts]
    for _ in range(2):
        assert enc.encode([t.encode() for t in texts]) == want
