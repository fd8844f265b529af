"""A result file with many rows."""

from __future__ import annotations

import json
import time

from pyspark.sql import functions as F

from tallyframe.sources import records as src


def test_a_file_of_many_rows_is_not_carried_beside_each(spark):
    n = 40_000
    text = json.dumps({"name": "own", "left_out": [1], "note": None, "runs": [{"k": k, "name": "x"} if k % 4 else {"k": k} for k in range(n)]})
    began = time.time()
    rows = src.flattened(spark.createDataFrame([("a", text)], "id string, text string"), "text", "id")
    got = {r.name: (r.n, r.own) for r in rows.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("value") == "own").alias("own")).collect()}
    assert time.time() - began < 60
    assert got == {"k": (n, 0), "name": (n, n // 4), "note": (n, 0)}
