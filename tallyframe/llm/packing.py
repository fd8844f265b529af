"""Best-fit packing of token pieces into sequences, by hierarchical residual packing.

Every input partition packs its own pieces best-fit, longest first, and emits the bins that are nearly full. The
underfull ones become items of the next level, where several partitions' items meet and are packed best-fit again, and
so on up the tree. Where more items are left than one task should hold, a level keeps as many groups as they need, and
deals them anew, until one group is left or a level no longer saves bins. No item is capped and no piece is lost.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import staged
from .textarrays import lean
from .tokens import encoder, vocabulary

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_BIN = "grp int, fill int, pieces array<struct<doc_id: long, piece: int, start: long, length: long, ids_crc32: long>>"


def document_pieces(docs: DataFrame, capacity: int = 2048, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part): a document's ids and the end id, cut only if longer than
    ``capacity``; of a cut document the first piece takes the rest, all others are full. Null text counts as empty."""
    path = path or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        for batch in batches:
            own = batch.column(0).to_pylist()
            for row, ids, off in enc.ids(batch.column(1)):
                raw, off = memoryview(np.insert(ids, off[1:], end_id).astype("<u4").view(np.uint8)), (off + np.arange(len(off))).tolist()
                out = []
                for i, begin, n in zip(own[row:], off[:-1], np.diff(off).tolist(), strict=False):
                    a, k = 0, 0
                    while a < n:
                        z = (n % capacity or capacity) if a == 0 else a + capacity
                        out.append((i, k, a, z - a, zlib.crc32(raw[4 * (begin + a) : 4 * (begin + z)])))
                        a, k = z, k + 1
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), pa.array([part] * len(out), pa.int32())], ["doc_id", "piece", "start", "length", "ids_crc32", "part"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), PIECE + ", part int")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each item and the fill of each bin: longest first, each into the bin with the least room that holds it."""
    bins = np.empty(len(sizes), np.int64)
    fill: list[int] = []
    rooms: dict[int, list[int]] = {}
    known: list[int] = []  # rooms that some bin has, ascending
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        at = bisect.bisect_left(known, n)
        if at < len(known):
            room = known[at]
            b = rooms[room].pop()
            if not rooms[room]:
                known.pop(at)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[k] = b
        fill[b] += n
        room -= n
        if room:
            stack = rooms.setdefault(room, [])
            if not stack:
                bisect.insort(known, room)
            stack.append(b)
    return bins, np.array(fill, np.int64)


def _tables(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept).combine_chunks() if kept else None


def _packed(pieces: pa.Array, bins: np.ndarray, fill: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Bins as lists of pieces: ``pieces`` flat, ``inner`` how many of them each item holds."""
    order = np.argsort(bins, kind="stable")
    first = np.concatenate([[0], np.cumsum(inner)])
    counts = inner[order]
    ends = np.cumsum(counts)
    flat = np.repeat(first[order] - (ends - counts), counts) + np.arange(int(counts.sum()))
    per_bin = np.bincount(bins, weights=inner, minlength=len(fill)).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
    return fill, pa.ListArray.from_arrays(pa.array(off), pieces.take(pa.array(flat))), order


def _local(capacity: int):
    def run(batches):
        table = _tables(batches)
        if table is not None:
            sizes = table["length"].to_numpy()
            bins, fill = best_fit(sizes, capacity)
            arrays = [table[c].combine_chunks() if table[c].num_chunks != 1 else table[c].chunk(0) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            fill, lists, _ = _packed(pa.StructArray.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"]), bins, fill, np.ones(len(sizes), np.int64))
            part = table["part"][0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fill), part, np.int32)), pa.array(fill.astype(np.int32)), lists], ["grp", "fill", "pieces"])

    return run


def _merge(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        sizes = table["fill"].to_numpy().astype(np.int64)
        lists = table["pieces"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        inner = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        bins, fill = best_fit(sizes, capacity)
        fill, merged, _ = _packed(lists.flatten(), bins, fill, inner)
        group = table["grp"][0].as_py()
        return pa.table({"grp": pa.array(np.full(len(fill), group, np.int32)), "fill": pa.array(fill.astype(np.int32)), "pieces": merged})

    return run


def packed_sequences(pieces: DataFrame, capacity: int = 2048, near: int = 16, held: int = 100_000, fan_in: int = 4, least_saved: float = 0.01) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every row of ``document_pieces``.

    Bins with less than ``near`` ids of room are done; the others meet at least ``fan_in`` groups at a time, and about
    ``held`` to a group. The levels end with one group, or when dealing the same number of groups anew has saved less
    than ``least_saved`` of the bins. Lengths are at least 1 (the end id), so an empty text still has a piece; rows that
    repeat are pieces of their own; an empty table gives no rows.
    """
    level = staged(pieces.mapInArrow(_local(capacity), _BIN), "bins")
    full = F.col("fill") > capacity - near
    count = lambda df: df.agg(F.max("grp"), F.count(F.when(~full, 1))).first()
    top, many = count(level)
    groups, done, k = (top or 0) + 1, [], 0
    while groups > 1 and many:
        done.append(level.where(full))
        after = max(-(-groups // fan_in), -(-many // held))
        if after < groups:
            to = (F.col("grp") * F.lit(after) / F.lit(groups)).cast("int")  # neighbours meet
        else:
            to = F.pmod(F.xxhash64(F.col("pieces")[0], F.lit(k)), F.lit(groups)).cast("int")
        items = level.where(~full).select(to.alias("grp"), "fill", "pieces")
        level = staged(items.groupBy("grp").applyInArrow(_merge(capacity), _BIN), "bins")
        _, left = count(level)
        stuck = after >= groups and left > (1 - least_saved) * many
        groups, many, k = min(after, groups), left, k + 1
        if stuck:
            break
    for d in done:
        level = level.unionByName(d)
    level = level.select("pieces", F.monotonically_increasing_id().alias("sequence_id"))
    run = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("all")),
        lambda acc, p: F.struct((acc["at"] + p["length"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")),
        lambda acc: acc["all"],
    )
    flat = level.select("sequence_id", F.explode(F.arrays_zip("pieces", run.alias("offset"))).alias("x"))
    return flat.select("x.pieces.*", "sequence_id", F.col("x.offset").alias("offset"))
