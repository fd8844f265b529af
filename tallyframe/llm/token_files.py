"""Token-id files: documents in ascending id order, coded in checksummed blocks, with a table of documents.

A file holds the ids of one range of documents: ``CMT2``, then sections of coded blocks, then the table of documents
(id, flag for null, number of ids; deflated), then the table's length and crc32 and ``CMT2`` again. Each block has the
crc32 of its ids as little-endian 32-bit integers, and decodes by itself.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .storage import new_path, staged
from .textarrays import lean
from .tokens import encoder, vocabulary

_MAGIC, _HEAD = b"CMT2", struct.Struct("<II")
#: Ids that a writer or reader holds at once.
HELD = 4096 * rangecoder.BLOCK


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _flush(file, ids: np.ndarray) -> None:
    """A section: its size, (bytes, ids, crc32) of each block, then the blocks."""
    if not len(ids):
        return
    coded = rangecoder.encode(ids)
    blocks = [ids[k : k + rangecoder.BLOCK] for k in range(0, len(ids), rangecoder.BLOCK)]
    heads = np.array([(len(c), len(b), _crc(b)) for c, b in zip(coded, blocks, strict=True)], "<u4").tobytes()
    file.write(_HEAD.pack(len(coded), zlib.crc32(heads)) + heads + b"".join(coded))


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0) -> DataFrame:
    """Write (doc_id, text) and return the manifest: (part, file, ids). A task that runs again writes a new file; only
    the file of the attempt that ended is in the manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        if enc.dtype.itemsize != 2:
            raise ValueError("the coder takes vocabularies of up to 65,536 ids")
        file, name, table, held, n_held, total = None, f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.cmt", [], [], 0, 0
        store, at = pafs.FileSystem.from_uri(name)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                block = batch.slice(k, 1000)
                if file is None:
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    file = store.open_output_stream(at)
                    file.write(_MAGIC)
                own = block.column(0).to_pylist()
                for row, ids, off in enc.ids(block.column(1)):
                    table += [(i or 0, i is None, n + 1) for i, n in zip(own[row : row + len(off) - 1], np.diff(off).tolist(), strict=True)]
                    held.append(np.insert(ids, off[1:], end_id))
                    n_held += len(held[-1])
                    total += len(held[-1])
                if n_held >= HELD:
                    ids = np.concatenate(held)
                    whole = len(ids) // HELD * HELD
                    _flush(file, ids[:whole])
                    held, n_held = [ids[whole:].copy()], len(ids) - whole
        if file is not None:
            _flush(file, np.concatenate(held))
            body = zlib.compress(np.array(table, dtype=[("id", "<i8"), ("null", "u1"), ("n", "<i8")]).tobytes(), 1)
            file.write(body + struct.pack("<QI", len(body), zlib.crc32(body)) + _MAGIC)
            file.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "ids": pa.array([total], pa.int64())})

    dealt = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    return dealt.mapInArrow(lean(run), "part long, file string, ids long")


def read_documents(name: str) -> tuple[np.ndarray, int, object, object]:
    """The table of documents of a file, where its blocks end, and the open file."""
    store, at = pafs.FileSystem.from_uri(name)
    file = store.open_input_file(at)
    size = file.size()
    file.seek(size - 16)
    tail = file.read(16)
    length, crc = struct.unpack("<QI", tail[:12])
    file.seek(size - 16 - length)
    body = file.read(length)
    if tail[12:] != _MAGIC or zlib.crc32(body) != crc:
        raise OSError(f"{name}: the table of documents is damaged")
    return np.frombuffer(zlib.decompress(body), dtype=[("id", "<i8"), ("null", "u1"), ("n", "<i8")]), size - 16 - length, file, store


def read_ids(name: str) -> Iterator[np.ndarray]:
    """The ids of a file, some blocks at a time; every block is checked."""
    _, end, file, _ = read_documents(name)
    file.seek(0)
    if file.read(4) != _MAGIC:
        raise OSError(f"{name}: not a token file")
    at = 4
    while at < end:
        n, crc = _HEAD.unpack(file.read(_HEAD.size))
        heads = file.read(12 * n)
        if zlib.crc32(heads) != crc:
            raise OSError(f"{name}: a section's head is damaged")
        sizes, counts, sums = np.frombuffer(heads, "<u4").reshape(n, 3).T.tolist()
        ids = rangecoder.decode([file.read(k) for k in sizes], counts)
        ends = np.cumsum(counts).tolist()
        for a, z, crc in zip([0, *ends[:-1]], ends, sums, strict=True):
            if _crc(ids[a:z]) != crc:
                raise OSError(f"{name}: a block is damaged")
        at += _HEAD.size + 12 * n + sum(sizes)
        yield ids
    file.close()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            table, _, file, _ = read_documents(name)
            file.close()
            ends = np.cumsum(table["n"])
            starts = ends - table["n"]
            at, k, crc, crcs = 0, 0, 0, np.zeros(len(table), np.int64)
            for ids in read_ids(name):
                raw = ids.astype("<u4").tobytes()
                a = at
                while k < len(table) and ends[k] <= at + len(ids):
                    z = int(ends[k])
                    crcs[k] = zlib.crc32(raw[4 * (a - at) : 4 * (z - at)], crc)
                    a, k, crc = z, k + 1, 0
                if a < at + len(ids):
                    crc = zlib.crc32(raw[4 * (a - at) :], crc)
                at += len(ids)
            if at != (int(ends[-1]) if len(ends) else 0):
                raise OSError(f"{name}: ids are missing")
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(table["id"], mask=table["null"].astype(bool)), "start": pa.array(starts + before), "n_tokens": pa.array(table["n"]), "ids_crc32": pa.array(crcs)})


def token_id_files(docs: DataFrame, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, as read back from the files that this writes.

    A null text counts as empty and still has its end id. Null ids come first; rows that repeat an id follow each other in
    any order. Extra columns are ignored. An empty table writes no file and gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    manifest = staged(write_token_files(docs, new_path(spark, "tokens"), path or vocabulary(), end_id), "manifest")
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("before"))
    count = max(1, manifest.count())
    return files.repartition(count, "file").mapInArrow(lean(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")
