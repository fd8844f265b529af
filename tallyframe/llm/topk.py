"""Exact top-k search by inner product, with pivot-table elimination.

The distances of all vectors to a set of pivots are computed once and stored with them. For a query at distances ``a``
from the pivots, a vector at distances ``b`` is at least ``max |a - b|`` away, which bounds their inner product from
above. Each task takes its vectors in the order of that bound and scores them until no bound left reaches the query's
kth best score so far, which starts at that among the vectors the pivots were picked from; what is skipped cannot be
among the results. Queries stand in files of the shared folder, from which the tasks read them block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import new_path, staged

#: Pivots, and the vectors that they are picked from (those with the smallest hashed ids).
PIVOTS, SAMPLE = 48, 2_000
#: Vectors that a task holds, queries that it reads at a time, and vectors and queries that it scores at a time.
HELD_ROWS, QUERY_BLOCK, ROW_BLOCK, STEP = 131_072, 4_096, 8_192, 256
#: Inner products are exact in double precision up to here.
_EXACT = float(1 << 53)
_LOWEST, _NONE = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, x): vectors with each component floored after scaling, as double. Vectors that are null or hold null, NaN or
    infinite components are left out; so are those without an id."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double"))
    fit = F.forall(F.col(vec_col).cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fit).select(F.col(id_col).cast("long").alias("id"), v.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are padded with 0, which adds nothing to an inner product."""
    flat, off = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    sizes = np.diff(off)
    if len(column) and (sizes == width).all():
        return np.ascontiguousarray(flat.reshape(len(column), width))
    out = np.zeros((len(column), width))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], sizes)] = flat
    return out


def _far_apart(x: np.ndarray, count: int) -> np.ndarray:
    """Pivots: the row furthest from the mean, then again and again the row furthest from all pivots so far."""
    if not len(x):
        return x
    left = ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    chosen = []
    near = np.full(len(x), np.inf)
    for _ in range(min(count, len(x))):
        k = int(np.argmax(left))
        if chosen and left[k] <= 0:
            break
        chosen.append(k)
        near = np.minimum(near, ((x - x[k]) ** 2).sum(axis=1))
        left = near
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def pivot_table(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(id, x, to_pivots): the vectors of ``quantised`` with their distances to the pivots."""
    held = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1), width), held.value)
            off = np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(d.ravel()))], ["id", "x", "to_pivots"])

    return vectors.mapInArrow(run, "id long, x array<double>, to_pivots array<double>")


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; too large for double precision, they are summed as 64-bit integers."""
    if exact:
        return (q @ x.T).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        return q.astype(np.int64) @ x.astype(np.int64).T


def _asked(folder: str) -> Iterator[pa.RecordBatch]:
    """Blocks of queries from their files."""
    store, at = pafs.FileSystem.from_uri(folder)
    for info in sorted(store.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                yield from pq.ParquetFile(file).iter_batches(QUERY_BLOCK)


def _with_floors(k: int, width: int, pivots: np.ndarray, ids: np.ndarray, sample: np.ndarray):
    """Adds to queries (id, x) their distances to the pivots and the kth best score in the sample, their own id excepted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                block = batch.slice(at, STEP)
                own, q = block.column(0).to_numpy(), _matrix(block.column(1), width)
                floor = np.full(len(own), _LOWEST)
                if len(ids) > k:
                    scores = _products(q, sample, _fits(q, sample, width))
                    scores[own[:, None] == ids[None, :]] = _LOWEST
                    floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
                d = _distances(q, pivots)
                off = np.arange(len(d) + 1, dtype=np.int32) * d.shape[1]
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.ListArray.from_arrays(pa.array(off), pa.array(d.ravel())), pa.array(floor)], ["id", "x", "to_pivots", "floor"])

    return run


def _fits(q: np.ndarray, x: np.ndarray, width: int) -> bool:
    return float(np.abs(q).max(initial=0.0)) * float(np.abs(x).max(initial=0.0)) * width < _EXACT


def _search(k: int, width: int, n_pivots: int, folder: str):
    def found(own: np.ndarray, x: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        norms = (x * x).sum(axis=1)
        for block in _asked(folder):
            ids, q, to = block.column(0).to_numpy(), _matrix(block.column(1), width), _matrix(block.column(2), n_pivots)
            square = (q * q).sum(axis=1)
            # whatever scores less than the floor is no result
            best_s = np.repeat(np.maximum(block.column(3).to_numpy(), _LOWEST + 1)[:, None] - 1, k, axis=1)
            best_i = np.full((len(ids), k), _NONE, np.int64)
            for at in range(0, len(own), ROW_BLOCK):
                some = slice(at, at + ROW_BLOCK)
                exact = _fits(q, x[some], width)
                for a in range(0, len(ids), STEP):
                    _block(ids[a : a + STEP], q[a : a + STEP], square[a : a + STEP], to[a : a + STEP], own[some], x[some], norms[some], d[some], exact, best_s[a : a + STEP], best_i[a : a + STEP], k)
            at, col = np.nonzero(best_i != _NONE)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(best_i[at, col]), pa.array(best_s[at, col])], ["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), _matrix(batch.column(1), width), _matrix(batch.column(2), n_pivots)))
            n += batch.num_rows
            if n >= HELD_ROWS:
                yield from found(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from found(*map(np.concatenate, zip(*held, strict=True)))

    return run


def _block(ids, q, square, to, own, x, norms, d, exact, best_s, best_i, k):
    """Score a block's vectors for some queries, in the order of their bounds, until none can enter the best k."""
    least = np.zeros((len(ids), len(own)), np.float32)
    for p in range(d.shape[1]):
        np.maximum(least, np.abs((to[:, p : p + 1] - d[:, p]).astype(np.float32)), out=least)
    bound = (square[:, None] + norms[None, :] - np.square(least.astype(np.float64) * (1 - 1e-6))) / 2
    bound += 1 + 1e-9 * np.abs(bound)  # no rounding may hide a vector
    bound[ids[:, None] == own[None, :]] = -np.inf
    order = np.argsort(-bound, axis=1, kind="stable") if len(own) <= STEP else np.argpartition(-bound, STEP, axis=1)
    first = order[:, :STEP]
    for r in range(len(ids)):
        cols = first[r][np.isfinite(bound[r, first[r]]) & (bound[r, first[r]] >= best_s[r, -1])]
        _keep(q[r : r + 1], x, cols, own, best_s, best_i, r, exact, k)
        if len(own) > STEP:
            rest = order[r, STEP:]
            rest = rest[(bound[r, rest] >= best_s[r, -1]) & np.isfinite(bound[r, rest])]
            rest = rest[np.argsort(-bound[r, rest])]
            for c in range(0, len(rest), 4 * STEP):
                some = rest[c : c + 4 * STEP]
                if bound[r, some[0]] < best_s[r, -1]:
                    break
                _keep(q[r : r + 1], x, some, own, best_s, best_i, r, exact, k)


def _keep(q, x, cols, own, best_s, best_i, r, exact, k):
    if not len(cols):
        return
    s = np.concatenate([best_s[r], _products(q, x[cols], exact)[0]])
    i = np.concatenate([best_i[r], own[cols]])
    if len(s) > 4 * k:  # the kth best score bounds what can stay
        floor = np.partition(s, len(s) - k)[len(s) - k]
        s, i = s[s >= floor], i[s >= floor]
    top = np.lexsort((i, -s))[:k]
    best_s[r], best_i[r] = s[top], i[top]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its ``k`` best rows of ``vectors`` by inner product,
    its own id excepted; equal scores go to the smaller id. Both tables are of ``quantised``.

    Queries with fewer than ``k`` candidates get all of them, those with none no row. Rows of either table that repeat
    id and vector count once; those of one id with different vectors count each. Vectors of unlike lengths are compared as if padded with
    0. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    unique = vectors.dropDuplicates(["id", "x"])
    width = unique.agg(F.max(F.size("x"))).first()[0] or 0
    sample = unique.orderBy(F.xxhash64("id"), "id", "x").limit(SAMPLE).toArrow()
    xs = _matrix(sample["x"].combine_chunks(), width) if sample.num_rows else np.zeros((0, width))
    chosen = _far_apart(xs, pivots)
    if not len(chosen):
        chosen = np.zeros((1, width))
    table = staged(pivot_table(unique, chosen, width), "pivots")
    folder = new_path(spark, "queries")
    ids = sample["id"].to_numpy() if sample.num_rows else np.zeros(0, np.int64)
    asked = queries.dropDuplicates(["id", "x"]).mapInArrow(_with_floors(k, width, chosen, ids, xs), "id long, x array<double>, to_pivots array<double>, floor long")
    asked.write.parquet(folder)
    found = table.mapInArrow(_search(k, width, len(chosen), folder), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
