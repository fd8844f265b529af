"""WARC archives packaged in ZIP files: written by Spark tasks, and read back through their directories by ranges.

A package holds two members, both stored without compression: ``archive/data.warc.gz``, one gzip member a record, and
``indexes/index.cdx``, one JSON line a record with its offset and length in the archive. The reader takes the end of the
file, follows the central directory (ZIP64 where sizes or counts ask for it) to the members, and reads each record by
its range. Nothing is extracted.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import new_path, staged

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
#: Records that a page's digest may be spread over when equal payloads are matched.
SALTS = 16
#: Bytes of an archive that one range read takes at most, unless a record is longer.
RANGE = 4 << 20
_DATE = "2020-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    tail = urn.strip("<>").rpartition(":")[2]
    return None if tail == "null" else int(tail)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP header, which tells the full payload's length, and no payload."""
    uri = (url or "").translate({k: f"%{k:02X}" for k in (*range(33), 127)})
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {_DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {uri}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    """What a record says: headers by lower-case name, and its block."""

    headers: dict[str, str]
    block: bytes

    @property
    def http(self) -> tuple[dict[str, str], bytes]:
        head, _, body = self.block.partition(b"\r\n\r\n")
        return _headers(head.split(b"\r\n")[1:]), body


def _headers(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines)}


def parse_record(raw: bytes) -> Record:
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = _headers(lines[1:])
    size = int(headers["content-length"])
    if len(rest) < size:
        raise ValueError("the record is cut short")
    return Record(headers, rest[:size])


@dataclass(frozen=True)
class Member:
    """A stored member of a package: where its bytes are."""

    name: str
    offset: int
    size: int


_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"


def members(file, size: int) -> list[Member]:
    """The members that a ZIP file's central directory lists; ``file`` needs seek and read."""

    def take(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    tail = min(size, 22 + 65535)
    end = take(size - tail, tail)
    at = end.rfind(_END)
    while at >= 0 and at + 22 + int.from_bytes(end[at + 20 : at + 22], "little") != len(end):
        at = end.rfind(_END, 0, at)
    if at < 0:
        raise ValueError("no end of a central directory")
    count, length, start = struct.unpack("<HII", end[at + 10 : at + 20])
    if count == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
        place = size - tail + at - 20
        locator = take(place, 20)
        if locator[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end64 = take(int.from_bytes(locator[8:16], "little"), 56)
        if end64[:4] != _END64:
            raise ValueError("no ZIP64 end of a central directory")
        count, length, start = struct.unpack("<QQQ", end64[32:56])
    directory = take(start, length)
    found, at = [], 0
    for _ in range(count):
        if directory[at : at + 4] != _ENTRY:
            raise ValueError("a damaged central directory")
        flags, method = struct.unpack("<HH", directory[at + 8 : at + 12])
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        local = int.from_bytes(directory[at + 42 : at + 46], "little")
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                wide, k = extra[4 : 4 + n], 0
                values = {"full": full, "packed": packed, "local": local}
                for key in values:
                    if values[key] == 0xFFFFFFFF:
                        values[key] = int.from_bytes(wide[k : k + 8], "little")
                        k += 8
                full, packed, local = values["full"], values["packed"], values["local"]
            extra = extra[4 + n :]
        if method != 0 or packed != full or flags & 1:
            raise ValueError(f"{name} isn't stored plainly")
        header = take(local, 30)
        if header[:4] != _LOCAL:
            raise ValueError(f"{name}: no local header")
        a, b = struct.unpack("<HH", header[26:30])
        found.append(Member(name, local + 30 + a + b, full))
        at += 46 + n_name + n_extra + n_comment
    return found


def read_package(name: str) -> Iterator[tuple[dict, Record]]:
    """(index line, record) of every record that a package's indexes list, each read by its range."""
    store, at = pafs.FileSystem.from_uri(name)
    with store.open_input_file(at) as file:
        listed = {m.name: m for m in members(file, file.size())}
        archive = listed[ARCHIVE]
        index = listed[INDEX]
        start, held = 0, b""
        done, rest = 0, b""
        while done < index.size or rest:
            file.seek(index.offset + done)
            part = file.read(min(1 << 20, index.size - done))
            done += len(part)
            lines = (rest + part).split(b"\n")
            rest = lines.pop()
            if not part and not lines:
                lines, rest = [rest], b""
            for line in filter(None, lines):
                entry = json.loads(line)
                a, n = entry["offset"], entry["length"]
                if a + n > archive.size:
                    raise ValueError(f"{name}: a record beyond the archive")
                if not start <= a <= a + n <= start + len(held):
                    file.seek(archive.offset + a)
                    start, held = a, file.read(max(n, min(RANGE, archive.size - a)))
                yield entry, parse_record(zlib.decompress(held[a - start : a - start + n], 31))


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
        package = member = None
        offset, count = 0, 0
        lines: list[bytes] = []
        for batch in batches:
            for page_id, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if package is None:
                    store, at = pafs.FileSystem.from_uri(name)
                    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
                    stream = store.open_output_stream(at)
                    package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                    member = package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
                payload = html.encode()
                digest = digest_of(payload)
                revisit = first is not None and first != page_id
                gzip = zlib.compressobj(4, zlib.DEFLATED, 31)
                raw = gzip.compress(record(page_id, url, payload, digest, first, revisit)) + gzip.flush()
                member.write(raw)
                lines.append(zlib.compress(json.dumps({"url": url, "digest": digest, "offset": offset, "length": len(raw)}).encode() + b"\n", 1))
                offset += len(raw)
                count += 1
        if package is not None:
            member.close()
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as index:
                for line in lines:
                    index.write(zlib.decompress(line))
            package.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": pa.array([count], pa.int64())})

    return run


def write_packages(pages: DataFrame, folder: str, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row and return the manifest (file, records).

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id is a response and the others
    revisit it; shorter payloads are all responses. A task that runs again writes a new file, and only the file of the
    attempt that ended is in the manifest. Null html counts as empty. Rows without an id are responses of their own and
    no one revisits them; rows that repeat the smallest id are all responses. Extra columns are ignored; an empty table
    writes no file.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("sha", F.sha1("html"))
    slim = rows.where(F.col("id").isNotNull() & (F.octet_length("html") >= least)).select("id", "sha")
    firsts = slim.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    firsts = staged(firsts, "firsts").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    known = salted.join(firsts, ["sha", "salt"], "left")
    first = F.when(F.col("id").isNotNull() & (F.octet_length("html") >= least), F.col("first"))
    return staged(known.select("id", "url", "html", first.alias("first")).mapInArrow(_write(folder), "file string, records long"), "packages")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            out: list[tuple] = []
            seen = 0
            for _, r in read_package(name):
                http, body = r.http
                kind, size = r.headers["warc-type"], int(http["content-length"])
                digest = r.headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and (len(body) != size or digest_of(body) != digest):
                    raise ValueError(f"{name}: a payload is damaged")
                refers = _page_of(r.headers["warc-refers-to"]) if kind == "revisit" else None
                out.append((_page_of(r.headers["warc-record-id"]), r.headers.get("warc-target-uri"), size, digest, kind, refers, body.decode() if kind == "response" else None))
                seen += 1
                if len(out) == 500:
                    yield _rows(out)
                    out = []
            if seen != count:
                raise ValueError(f"{name}: records are missing")
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    cols = list(zip(*out, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_packages(manifest: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of every record of the packages; a
    revisit has no payload of its own. Damaged payloads and missing records raise an error."""
    count = max(1, manifest.count())
    return manifest.repartition(count, "file").mapInArrow(_read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string")


def warc_round_trip(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every row of ``pages`` as its record, written by ``write_packages`` and read back by ``read_packages``."""
    return read_packages(write_packages(pages, new_path(pages.sparkSession, "warc"), least, id_col, url_col, html_col))
