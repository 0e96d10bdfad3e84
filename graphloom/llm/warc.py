"""WARC records in ZIP-packaged archives, and a reader that works by range.

An archive is a ZIP file with stored members: archive/data.warc.gz (each record its own gzip member),
indexes/index.cdxj (one line for each record with its offset and length) and datapackage.json. The reader finds the
end-of-central-directory record, follows the ZIP64 locator where there is one, reads the central directory, and
locates stored members through their local headers. It reads the index by range, then runs of records by range, and
never unpacks a member as a whole.

Payloads: null counts as empty. Of records with equal payloads of REVISIT_FROM bytes or more, that with the smallest
page_id is the response and the others revisit it; rows that share this page_id are all responses, and rows
without an id revisit it too (if no row has an id, all are responses). Smaller payloads are all responses. An empty
table makes no archive. Other columns are ignored; an url may be null.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import struct
import zipfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, dealt_evenly, files_of, make_folder, new_folder, opened, remove
from .tokencounts import settle

REVISIT_FROM, READ = 100, 1 << 20
DATE = "2024-01-01T00:00:00Z"
#: Fixed value: the profile of a revisit for an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if " " < c < "\x7f" else f"%{b:02X}" if len(c.encode()) == 1 else "".join(f"%{x:02X}" for x in c.encode()) for c in url for b in c.encode()[:1]))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers by lower-case name, and the HTTP block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(headers["content-length"])
    if rest[size : size + 4] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers | {"block": rest[:size]}


def row_of(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a stored payload must match its digest."""
    r = parse_record(raw)
    http, _, payload = r["block"].partition(b"\r\n\r\n")
    size = next(int(x.split(":")[1]) for x in http.decode("latin-1").split("\r\n") if x.lower().startswith("content-length:"))
    digest = r["warc-payload-digest"].removeprefix("sha256:")
    kind = r["warc-type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda name: int(x) if (x := r.get(name, "<urn:page:>")[10:-1]) else None
    return number("warc-record-id"), size, digest, kind, number("warc-refers-to") if kind == "revisit" else None


class Packer:
    """Writes one archive to a stream, record by record."""

    def __init__(self, out, name: str):
        self.zip, self.name, self.lines, self.at = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True), name, [], 0
        self.member = self.zip.open(zipfile.ZipInfo("archive/data.warc.gz"), "w", force_zip64=True)

    def add(self, raw: bytes, about: dict) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        data = packer.compress(raw) + packer.flush()
        self.member.write(data)
        self.lines.append(json.dumps(about | {"offset": self.at, "length": len(data)}))
        self.at += len(data)

    def close(self) -> None:
        self.member.close()
        for name, text in (("indexes/index.cdxj", "\n".join(self.lines)), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"path": "archive/data.warc.gz", "bytes": self.at}]}))):
            self.zip.writestr(zipfile.ZipInfo(name), text)
        self.zip.close()


def stored_members(f, size: int) -> dict[str, tuple[int, int]]:
    """Place and size of every stored member of a ZIP file, from its central directory."""

    def read(at: int, n: int) -> bytes:
        f.seek(at)
        return f.read(n)

    tail_at = max(0, size - 22 - 65_535)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("not a ZIP file")
    count, length, start = struct.unpack("<HII", tail[end + 10 : end + 20])
    locator = tail_at + end - 20
    if locator >= 0 and (found := read(locator, 20))[:4] == b"PK\x06\x07":
        (wide,) = struct.unpack("<Q", found[8:16])
        count, length, start = struct.unpack("<QQQ", read(wide, 56)[32:56])
    directory, at, out = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is broken")
        (method,) = struct.unpack("<H", directory[at + 10 : at + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20 : at + 34])
        (offset,) = struct.unpack("<I", directory[at + 42 : at + 46])
        name = directory[at + 46 : at + 46 + n_name].decode("utf-8")
        extra, i = directory[at + 46 + n_name : at + 46 + n_name + n_extra], 0
        while i + 4 <= len(extra):
            tag, n = struct.unpack("<HH", extra[i : i + 4])
            if tag == 1:  # ZIP64: only the fields that are all ones above, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[i + 4 : i + 4 + n // 8 * 8]))
                plain = next(wide) if plain == 0xFFFFFFFF else plain
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                offset = next(wide) if offset == 0xFFFFFFFF else offset
            i += 4 + n
        if method == 0:
            own = read(offset, 30)
            if own[:4] != b"PK\x03\x04":
                raise ValueError("a local header is broken")
            out[name] = (offset + 30 + sum(struct.unpack("<HH", own[26:30])), packed)
        at += 46 + n_name + n_extra + n_note
    return out


def write_archives(pages: DataFrame, folder: str) -> None:
    """Each task packs its rows (page_id, url, html, revisit, first) into one archive, under its name once it is whole."""

    def each(batches):
        task = TaskContext.get()
        store, path = opened(folder)
        store.create_dir(path)
        part, n = task.partitionId(), 0
        draft = f"{path}/_draft-{part}-{task.taskAttemptId()}-{os.getpid()}"
        with store.open_output_stream(draft) as raw:
            out = Packer(_Forward(raw), f"part-{part}")
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first", "revisit")), strict=True):
                    out.add(record(r[0], r[1], (r[2] or "").encode(), r[3], r[4]), {"page": r[0], "mime": "text/html"})
                    n += 1
            out.close()
        if n:
            settle(store, draft, f"{path}/part-{part:06d}.wacz")
        else:
            store.delete_file(draft)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    pages.mapInArrow(each, "n long").agg(F.sum("n")).first()


class _Forward(io.RawIOBase):
    """A stream that zipfile takes as one it cannot seek in."""

    def __init__(self, out):
        self.out, self.at = out, 0

    def writable(self):
        return True

    def seekable(self):
        return False

    def write(self, data):
        self.out.write(bytes(data))
        self.at += len(data)
        return len(data)

    def flush(self):
        pass


def _locate():
    """Runs of records that lie side by side: (name, at, sizes)."""

    def each(batches):
        for batch in batches:
            for name, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                store, path = opened(name)
                with store.open_input_file(path) as f:
                    members = stored_members(f, size)
                    at, n = members["indexes/index.cdxj"]
                    f.seek(at)
                    lines = f.read(n).decode("utf-8").split("\n") if n else []
                base, runs = members["archive/data.warc.gz"][0], []
                for entry in map(json.loads, lines):
                    start = base + entry["offset"]
                    if runs and runs[-1][0] + runs[-1][2] == start and runs[-1][2] < READ:
                        runs[-1][1].append(entry["length"])
                        runs[-1][2] += entry["length"]
                    else:
                        runs.append([start, [entry["length"]], entry["length"]])
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()), pa.array([r[1] for r in runs], pa.list_(pa.int64()))], names=["name", "at", "sizes"])

    return each


def _read():
    def each(batches):
        for batch in batches:
            for name, at, sizes in zip(*(batch.column(c).to_pylist() for c in ("name", "at", "sizes")), strict=True):
                store, path = opened(name)
                with store.open_input_file(path) as f:
                    f.seek(at)
                    data = f.read(sum(sizes))
                ends = np.cumsum(sizes).tolist()
                rows = [row_of(zlib.decompress(data[e - n : e], 31)) for e, n in zip(ends, sizes, strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return each


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each record of the folder's archives; runs of records are dealt out over the executors."""
    files = files_of(spark, folder, ".wacz")
    total = files.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    runs = dealt_evenly(files, total, 1 << 30).mapInArrow(_locate(), "name string, at long, sizes array<long>")
    return dealt_evenly(runs, total, 32 << 20).mapInArrow(_read(), SCHEMA)


def through_archives(pages: DataFrame) -> DataFrame:
    """Writes a record for every row and reads all of them back."""
    spark = pages.sparkSession
    folder, small = make_folder(spark, new_folder(spark, "wacz")), new_folder(spark, "digests")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit(""))
    try:
        rows.where(F.octet_length(payload) >= REVISIT_FROM).select("page_id", F.sha2(payload, 256).alias("digest")).write.parquet(f"{small}/all")
        digests = spark.read.parquet(f"{small}/all")
        # written before the join, so that the skew join can split a payload that very many pages have
        firsts = cut(digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
        twice = digests.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
        twice.select("page_id", "digest", "first").distinct().write.parquet(f"{small}/twice")
        again = spark.read.parquet(f"{small}/twice")
        # a page's own digest is needed only where a page_id has several payloads
        known = rows.join(again.withColumnRenamed("page_id", "again_id"), rows["page_id"].eqNullSafe(F.col("again_id")) & (F.sha2(payload, 256) == F.col("digest")), "left")
        write_archives(known.select("page_id", "url", "html", "first", F.col("first").isNotNull().alias("revisit")), folder)
        return cut(read_archives(spark, folder))
    finally:
        remove(spark, folder)
        remove(spark, small)
