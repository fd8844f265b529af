"""What the text models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import language_id as li


def test_models_are_fitted_on_all_labelled_rows(spark):
    n = 9_000  # each with a trigram of its own among those of its language
    own = lambda k: "".join(chr(97 + k // 26**p % 26) for p in (2, 1, 0))
    rows = [(k if k % 10 else None, own(k), ("aa", "bb")[k % 2]) for k in range(n)] + [(n, None, "aa"), (n + 1, "zzz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = li.train_languages(docs)
    assert model.languages == ("aa", "bb")
    for lang, table in enumerate(np.exp(model.table.astype(np.float64))):
        grams = np.bincount([int(li._trigrams(np.frombuffer(own(k).encode(), np.uint8))[0]) for k in range(lang, n, 2)], minlength=64**3)
        want = (grams + 0.1) / (grams + 0.1).sum()
        assert np.allclose(table, want, rtol=1e-4)


def test_a_language_of_one_row_among_many_is_known(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("the other words").alias("text"), F.when(F.col("id") == 77, "fi").otherwise("en").alias("lang"))
    assert li.train_languages(docs).languages == ("en", "fi")
