"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's features are the hashes of its words, pairs of words, and runs of one to three word shapes (case, last byte,
whether the word repeats the one before). Each family's features are relative frequencies, so a text's length does not
matter. Shards of the training rows are learnt side by side and their weights averaged; the model is a table of at
most ``BUCKETS`` rows. A score is the sparse dot product of a text's frequencies with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged
from .textarrays import mix64, pieces, word_hashes, word_spans

BUCKETS = 1 << 18
#: Labelled rows that a model is fitted on at most, those with the smallest hashed ids; and the shards they are dealt to.
TRAIN_ROWS, SHARDS = 16_000, 8
#: Learning rate, its damping, and the two regularisers of the updates.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
EPOCHS = 4
#: What a family's relative frequencies are multiplied by.
SCALE = 4.0
FAMILIES = 5
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_BUCKET = np.uint64(BUCKETS - 1)


def _shapes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A number for each word's shape: the kinds of its first two bytes, its last byte, and whether the word before is
    the same."""
    last = body[ends - 1].astype(np.uint64)
    second = np.where(ends - starts > 1, _CLASS[body[np.minimum(starts + 1, len(body) - 1)]], np.uint64(5))
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    plain = np.where(_CLASS[last.astype(np.intp)] == 1, np.uint64(1), last + np.uint64(8))
    return (_CLASS[body[starts]] * np.uint64(8) + second) * np.uint64(1024) + plain * np.uint64(2) + again


def _families(words: np.ndarray, shapes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length of the run, bucket of each run by its first word) of each family."""
    two = lambda x, salt: mix64(x[:-1] * np.uint64(3) + x[1:] + np.uint64(salt))
    yield 1, (mix64(words + np.uint64(11)) & _BUCKET).astype(np.intp)
    yield 2, (two(words, 22) & _BUCKET).astype(np.intp)
    yield 1, (mix64(shapes + np.uint64(33)) & _BUCKET).astype(np.intp)
    pairs = two(shapes, 44)
    yield 2, (pairs & _BUCKET).astype(np.intp)
    yield 3, (mix64(pairs[:-1] * np.uint64(5) + shapes[2:]) & _BUCKET).astype(np.intp)


def _batches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """(first row, index of each row's first word, families) for pieces of a text column."""
    for row, _, body, off in pieces(column):
        starts, ends, first = word_spans(body, off)
        words = word_hashes(body, starts, ends)
        with np.errstate(over="ignore"):
            found = list(_families(words, _shapes(body, starts, ends, words)))
        yield row, first, found


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, label, buckets, values) of (id, label, text)."""
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False)
        shards = (mix64(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)) % np.uint64(SHARDS)).astype(np.int32)
        keys, values, sizes = [], [], []
        for _, first, families in _batches(batch.column(2)):
            for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                k, v = [], []
                for n, buckets in families:
                    if z - a >= n:
                        u, c = np.unique(buckets[a : z - n + 1], return_counts=True)
                        k.append(u), v.append(c * (SCALE / (z - a - n + 1)))
                k, v = (np.concatenate(k), np.concatenate(v)) if k else (np.zeros(0, np.intp), np.zeros(0))
                keys.append(k), values.append(v), sizes.append(len(k))
        off = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
        yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(labels.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off), flat(keys, np.int32)), pa.ListArray.from_arrays(pa.array(off), flat(values, np.float32))], ["shard", "label", "buckets", "frequencies"])


def _sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, x))))


def _learn(table: pa.Table) -> pa.Table:
    """The weights that one shard's rows give; bucket ``BUCKETS`` is the constant, and -1 counts the shard."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    rows = []
    for label, k, v in zip(table["label"].to_pylist(), table["buckets"], table["frequencies"], strict=True):
        rows.append((label, np.append(k.values.to_numpy().astype(np.intp), BUCKETS), np.append(v.values.to_numpy().astype(np.float64), 1.0)))
    rng = np.random.default_rng(7)
    rows.sort(key=lambda r: (len(r[1]), r[0], int(r[1].sum())))  # the same order whichever way the rows came

    def weights(k):
        zk, nk = z[k], n[k]
        return np.where(np.abs(zk) <= L1, 0.0, -(zk - np.sign(zk) * L1) / ((BETA + np.sqrt(nk)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for r in rng.permutation(len(rows)):
            label, k, v = rows[r]
            w = weights(k)
            g = (_sigmoid(float(w @ v)) - label) * v
            s = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / ALPHA
            np.add.at(z, k, g - s * w)
            np.add.at(n, k, g * g)
    w = weights(np.arange(BUCKETS + 1))
    at = np.flatnonzero(w)
    return pa.table({"bucket": pa.array(np.append(at, -1).astype(np.int32)), "weight": pa.array(np.append(w[at], 1.0))})


def train_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The model (bucket, weight) learnt from ``labels`` (id, 0 or 1) of texts in ``docs``.

    At most ``rows`` labelled ids are used, those with the smallest hash. Null ids and labels are left out; an id with
    several labels counts with their mean, rounded up from a half. With no labelled rows the model is empty and every
    score is 0.5.
    """
    picked = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    picked = picked.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(picked), "id").select("id", "label", "text")
    features = sample.mapInArrow(_features, "shard int, label int, buckets array<int>, frequencies array<float>")
    learnt = features.groupBy("shard").applyInArrow(_learn, "bucket int, weight double")
    summed = staged(learnt.groupBy("bucket").agg(F.sum("weight").alias("weight")), "quality-model")
    shards = summed.where("bucket = -1").first()  # those that had rows to learn from
    return summed.where("bucket >= 0").select("bucket", (F.col("weight") / (shards["weight"] if shards else 1.0)).alias("weight"))


def _scores(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            out = np.full(batch.num_rows, w[BUCKETS])
            for row, first, families in _batches(batch.column(1)):
                count = len(first) - 1
                for n, buckets in families:
                    total = np.concatenate([[0.0], np.cumsum(w[buckets])])
                    runs = first[1:] - n + 1 - first[:-1]
                    full = np.flatnonzero(runs > 0)
                    a, z = first[:-1][full], first[1:][full] - n + 1
                    out[row : row + count][full] += SCALE * (total[z] - total[a]) / runs[full]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], ["id", "score"])

    return run


def quality_scores(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row: the probability of label 1.

    A null text counts as empty; an empty one scores as the model's constant. Rows that repeat an id or have none are
    each scored; an empty table gives an empty result; further columns are ignored.
    """
    table = model.toPandas()  # at most BUCKETS + 1 rows
    w = np.zeros(BUCKETS + 1)
    w[table["bucket"].to_numpy(np.intp)] = table["weight"].to_numpy(np.float64)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(_scores(docs.sparkSession.sparkContext.broadcast(w)), "id long, score double").withColumnRenamed("id", id_col)
