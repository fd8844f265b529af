"""How many rows a Python worker holds while languages are found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import language_id as li


@pytest.mark.parametrize("step", ["train", "identify"])
def test_workers_get_few_rows_at_a_time(spark, step):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a few words of text").alias("text"), F.lit("en").alias("lang")).coalesce(1)
    try:
        spark.conf.set(name, 10_000)
        if step == "train":
            li.train_languages(docs)
        else:
            model = li.LanguageModel(("en", "fr"), np.zeros((2, 64**3), np.float32))
            assert li.identified(docs, model).where("language = 'en'").count() == 4_000

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

        assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= li.BATCH_ROWS
    finally:
        spark.conf.set(name, before)
