"""WARC archives of gzip members: a writer, and a splittable reader that finds its own first record in a byte range."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.runtime import fresh_path, written

MAGIC = b"\x1f\x8b\x08"
#: Bytes that a reading task owns.
SPLIT_BYTES = 4 << 20
#: Bytes of ranges that a task reads, where there are more ranges than cores need.
TASK_BYTES = 128 << 20
#: Bytes read or unpacked at once.
CHUNK = 1 << 18
#: An archive file is closed beyond this size.
FILE_BYTES = 1 << 30
LEVEL = 2
#: A member whose WARC or HTTP header is longer is not taken for a record.
HEADER_BYTES = 1 << 20


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, length: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """One record as a gzip member of its own. A revisit holds the HTTP header of its payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + http) + z.compress(payload) + z.compress(b"\r\n\r\n") + z.flush()


class Bytes:
    """A file read forward in chunks, of which only what is still needed is kept."""

    def __init__(self, file, start: int, size: int):
        self.file, self.at, self.data, self.size = file, start, b"", size
        file.seek(start)

    def upto(self, end: int) -> None:
        """Hold the bytes before `end`, as far as the file has them."""
        while self.at + len(self.data) < min(end, self.size):
            more = self.file.read(CHUNK)
            if not more:
                break
            self.data += more

    def drop(self, to: int) -> None:
        self.data, self.at = self.data[to - self.at :], to

    def find_magic(self, start: int, end: int) -> int:
        """The first place of the magic that starts in start..end-1, or -1."""
        while start < end:
            self.drop(start)
            self.upto(min(end, start + CHUNK) + len(MAGIC) - 1)
            stop = min(end, self.at + len(self.data) - len(MAGIC) + 1)
            if (i := self.data.find(MAGIC, 0, stop - self.at + len(MAGIC) - 1)) >= 0:
                return self.at + i
            if stop <= start:
                return -1
            start = stop
        return -1


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def member_at(data: Bytes, at: int, keep: bool) -> tuple[int, dict] | None:
    """The record whose gzip member starts at `at`, and where the member ends; None if there is none. Payloads are hashed as they pass."""
    z, out, warc, http, left, n, sha, body = zlib.decompressobj(31), b"", None, None, 0, 0, hashlib.sha1(), []
    pos = at
    while not z.eof:
        data.upto(pos + 1)
        chunk = z.unconsumed_tail or data.data[pos - data.at : pos - data.at + CHUNK]
        if not chunk:
            return None
        fresh = not z.unconsumed_tail
        try:
            out += z.decompress(chunk, CHUNK)
        except zlib.error:
            return None
        if fresh:
            pos += len(chunk)
        if warc is None:
            if not out.startswith(b"WARC/1."[: len(out)]):
                return None
            if (i := out.find(b"\r\n\r\n")) < 0:
                continue
            warc, out = headers(out[:i]), out[i + 4 :]
            if not warc.get("content-length", "").isdigit():
                return None
            left = int(warc["content-length"])
        if http is None:
            if (i := out.find(b"\r\n\r\n", 0, min(left, HEADER_BYTES))) >= 0 and warc.get("content-type", "").startswith("application/http"):
                http, out, left = headers(out[:i]), out[i + 4 :], left - i - 4
            elif len(out) < min(left, HEADER_BYTES) and not z.eof:
                continue
            else:
                http = {}
        part = out[:left]
        sha.update(part)
        n, left, out = n + len(part), left - len(part), out[len(part) :]
        if keep:
            body.append(part)
    if warc is None or left:
        return None
    end = pos - len(z.unused_data)
    return end, {"warc": warc, "http": http or {}, "bytes": n, "sha1": base64.b32encode(sha.digest()).decode(), "payload": b"".join(body)}


def records_in(file, start: int, end: int, size: int, keep: bool = False) -> Iterator[tuple[int, dict]]:
    """(offset, record) of all records that start in start..end-1; the last may end beyond."""
    data, at = Bytes(file, start, size), start
    while 0 <= (at := data.find_magic(at, end)):
        if (found := member_at(data, at, keep)) is None:
            at += 1
        else:
            yield at, found[1]
            at = found[0]


def page_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) to gzip archives in `folder`; returns the manifest (path, bytes, records).

    The payload is html in UTF-8 (null: empty). Of rows with equal payloads those with the largest page_id are responses and the others
    revisit them; a null page_id counts as the smallest, and where all are null, or page_ids repeat, all that tie are responses.
    An attempt writes files of its own name; only those that the manifest of finished tasks lists count, so tasks can be repeated.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(body, "UTF-8").alias("payload"))
    shared = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(F.encode(body, "UTF-8")).alias("_hex")).groupBy("_hex").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null").drop("_n")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"page_id": [], "url": [], "hex": [], "n": [], "member": []}
            for page_id, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sha = hashlib.sha1(payload).digest()
                member = record("response", page_id, url, base64.b32encode(sha).decode(), len(payload), payload)
                for k, v in zip(rows, (page_id, url, sha.hex(), len(payload), member), strict=True):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)], names=list(rows))

    joined = p.mapInArrow(packed, "page_id long, url string, hex string, n long, member binary").join(shared.hint("shuffle_hash"), F.col("hex") == F.col("_hex"), "left")
    joined = joined.select("page_id", "hex", "n", F.when(F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last")).alias("refers_to"), "url", "member")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, top = opened(folder)
        system.create_dir(top, recursive=True)
        done, out = [], None
        for batch in batches:
            for page_id, hexed, n, refers_to, url, member in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or done[-1][1] > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done)}.warc.gz"
                    out = system.open_output_stream(f"{top}/{name}", compression=None)
                    done.append([f"{folder}/{name}", 0, 0])
                if refers_to is not None:
                    member = record("revisit", page_id, url, base64.b32encode(bytes.fromhex(hexed)).decode(), n, b"", refers_to)
                out.write(member)
                done[-1][1] += len(member)
                done[-1][2] += 1
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return written(joined.mapInArrow(stored, "path string, bytes long, records long"), "warc-manifest")


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = False) -> DataFrame:
    """Records of the archives that manifest lists (path, bytes), read in byte ranges: path, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload.

    Each range looks for the gzip magic, takes a candidate if it unpacks to a WARC header, and owns the records that start inside.
    payload_bytes and payload_digest are those of the full payload: counted and hashed, or a revisit's as its header has them.
    A task reads TASK_BYTES of ranges or less. payload is null unless asked for. What unpacks to no whole record is passed over.
    """
    splits = manifest.where("bytes > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))))
    size = manifest.agg(F.sum("bytes")).first()[0] or 0
    n = min(splits.count(), max(4 * manifest.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, name = opened(path)
                rows = []
                with system.open_input_file(name) as file:
                    for offset, r in records_in(file, start, min(size, start + split_bytes), size, payloads):
                        kind, digest, length = r["warc"].get("warc-type"), r["sha1"], r["bytes"]
                        if kind == "revisit":
                            digest, length = r["warc"].get("warc-payload-digest", "").removeprefix("sha1:"), int(r["http"].get("content-length", 0))
                        rows.append((path, offset, kind, page_of(r["warc"].get("warc-record-id")), r["warc"].get("warc-target-uri"), length, digest, page_of(r["warc"].get("warc-refers-to")), r["payload"] if payloads else None))
                        if len(rows) >= 1000:
                            yield batch_of(rows)
                            rows = []
                if rows:
                    yield batch_of(rows)

    kinds = {"path": pa.string(), "offset": pa.int64(), "record_type": pa.string(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    return splits.select("path", "bytes", "start").repartition(max(1, n)).mapInArrow(read, "path string, offset long, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    return read_warc(write_warc(pages, fresh_path(pages.sparkSession, "warc")))
