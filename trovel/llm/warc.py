"""WARC archives with a two-level capture index: sorted reversed-host keys in compressed blocks, a sparse block directory, and
binary search before range reads."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import batches, cut, pick, remove, shared_dir

#: Lines of an index block, payload bytes from which equal records are stored once, and bytes after which a task starts
#: another archive.
BLOCK_LINES, LEAST_BYTES, ARCHIVE_BYTES = 256, 100, 1 << 30
#: Bytes of an archive that one task reads.
READ_BYTES = 1 << 26


@lru_cache(maxsize=4)
def _store(folder: str):
    """The file system of a folder's address, and the folder's path in it: local disks, HDFS and object stores alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _join(folder: str, name: str) -> str:
    return f"{_store(folder)[1].rstrip('/')}/{name}"


def surt(url: str | None, page_id: int | None) -> str:
    """The index key of a capture: host parts reversed, path and query as they are, then the page's id; white space and
    control characters escaped, so that a key is one word."""
    url = url or ""
    after = url.partition("://")[2] or url
    cut_at = min((k for k in map(after.find, "/?#") if k >= 0), default=len(after))
    host, rest = after[:cut_at].lower(), after[cut_at:]
    return quote(",".join(reversed(host.split("."))) + ")" + rest, safe="!#$%&'()*+,/:;=?@[]~|^`{}\"<>\\") + f" {page_id if page_id is not None else -1:020d}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record: a response with its payload, or a revisit that names the response of the same payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if refers_to is None else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"Content-Type: application/http; msgtype={'response'}", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and payload (None for a revisit) of a record. A
    response's digest and length are those of the payload as read, and must be the recorded ones."""
    head, _, body = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda k: int(x) if (x := fields.get(k, "<urn:page:>")[10:-1]) else None
    http, _, payload = body[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size, digest = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not hold its payload")
    return {"page_id": number("WARC-Record-ID"), "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload_bytes": size, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None}


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row, each a gzip member of its own, and returns the captures: key, page_id, file, offset, length.

    A payload is the html in UTF-8, empty for null. Of rows with equal payloads of at least 100 bytes the one of the smallest
    id is a response, the others revisit it (rows of that id too are responses; a null id counts as the largest). Each task
    writes files under names of its own and the captures, once checkpointed, name those of the attempt that counts; files of
    lost attempts are never named. No rows write nothing; other columns are ignored.
    """
    own = pick(pages, page_id=id_col, url=url_col, html=html_col).select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha2("html", 256))
    again = own.where(F.octet_length("html") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    rows = own.join(again, "digest", "left").select("page_id", "url", "html", "digest", F.expr("CASE WHEN page_id IS NULL OR page_id <> first_id THEN first_id END").alias("refers_to"))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, out, name, at = _store(folder)[0], None, "", 0
        for batch in batches(source, 500):
            found = []
            for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(_join(folder, name), compression=None)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                member = packer.compress(record(page_id, url, html.encode(), digest, refers_to)) + packer.flush()
                out.write(member)
                found.append((surt(url, page_id), page_id, name, at, len(member)))
                at += len(member)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    _store(folder)[0].create_dir(_store(folder)[1], recursive=True)
    return cut(rows.mapInArrow(run, "key string, page_id long, file string, offset long, length long"))


def write_index(captures: DataFrame, folder: str) -> list[dict]:
    """Sorts the captures' keys into ranges, each a file of compressed blocks of lines and a sparse directory of the blocks'
    first keys; returns the ranges' first keys and file names, a row for each task, in order."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row for batch in source for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        store, name, directory, at, out = _store(folder)[0], uuid.uuid4().hex, [], 0, None
        while block := list(islice(lines, BLOCK_LINES)):
            out = out or store.open_output_stream(_join(folder, f"{name}.idx"), compression=None)
            raw = gzip.compress("".join(f"{key} {file} {offset} {length}\n" for key, file, offset, length in block).encode(), 6, mtime=0)
            out.write(raw)
            directory.append([block[0][0], at, len(raw)])
            at += len(raw)
        if out is not None:
            out.close()
            with store.open_output_stream(_join(folder, f"{name}.dir"), compression=None) as f:
                f.write(json.dumps(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first_key", "name"])

    ranged = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    return sorted((r.asDict() for r in cut(ranged.mapInArrow(run, "first_key string, name string")).collect()), key=lambda r: r["first_key"])


class Reader:
    """Looks keys up in the index and reads records; keeps its last directory, block and files open."""

    def __init__(self, folder: str, ranges: list[dict]):
        self.folder, self.ranges, self.firsts = folder, ranges, [r["first_key"] for r in ranges]
        self.files: dict = {}
        self.at = (None, None)

    def _read(self, name: str, offset: int | None = None, length: int | None = None) -> bytes:
        if offset is None:
            with _store(self.folder)[0].open_input_stream(_join(self.folder, name), compression=None) as f:
                return f.read()
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = _store(self.folder)[0].open_input_file(_join(self.folder, name))
        return self.files[name].read_at(length, offset)

    def part(self, key: str) -> int:
        return max(0, bisect_right(self.firsts, key) - 1)

    def _block(self, part: int, key: str) -> list[str]:
        if self.at[0] != part:
            self.directory = json.loads(self._read(f"{self.ranges[part]['name']}.dir"))
            self.keys = [d[0] for d in self.directory]
            self.at = (part, None)
        k = max(0, bisect_right(self.keys, key) - 1)
        if self.at[1] != k:
            _, offset, length = self.directory[k]
            self.lines = gzip.decompress(self._read(f"{self.ranges[part]['name']}.idx", offset, length)).decode().splitlines()
            self.at = (part, k)
        return self.lines

    def find(self, key: str) -> list[dict]:
        """The records of a capture key (several if a page was given more than once), parsed."""
        return [self.record(*at) for at in self.locate(key)]

    def record(self, file: str, offset: int, length: int) -> dict:
        return parse(zlib.decompress(self._read(file, offset, length), 31))

    def locate(self, key: str) -> list[tuple[str, int, int]]:
        """File, offset and length of the records of a capture key, by binary search in the directory and then in the block."""
        if not self.ranges:
            return []
        lines, out = self._block(self.part(key + " ~"), key + " ~"), []
        part, k = self.at
        while True:  # equal keys lie side by side, and may begin in a block before
            at = bisect_right(lines, key + " ~")
            while at and lines[at - 1].startswith(key + " "):
                at -= 1
                file, offset, length = lines[at].split(" ")[-3:]
                out.append((file, int(offset), int(length)))
            if at or (part == 0 and k == 0):
                return out
            if k:
                lines = self._block(part, self.keys[k - 1])
            else:
                self._block(part - 1, self.ranges[part - 1]["first_key"])
                lines = self._block(part - 1, self.keys[-1])
            part, k = self.at


def read_records(wanted: DataFrame, folder: str, ranges: list[dict], *, payload: bool = False) -> DataFrame:
    """The records of distinct capture keys (column key): page_id, record_type, refers_to, payload_bytes, payload_digest, and
    the payload if asked for. Keys are looked up in order, range by range of the index; the places found are then dealt by
    archive and stretch of READ_BYTES, so that each task reads its records front to back. Keys that the index lacks, or null,
    yield nothing; no keys yield no rows."""
    kinds = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), *([("payload", pa.binary())] if payload else [])]
    places = [("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]

    def parted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, ranges)
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.part(k) for k in batch.column(0).to_pylist()], pa.int32())], names=["key", "part"])

    def placed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, ranges)
        for batch in source:
            found = [at for k in batch.column(0).to_pylist() for at in reader.locate(k)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, (_, t) in enumerate(places)], names=[c for c, _ in places])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(folder, ranges)
        for batch in batches(source, 500):
            found = [reader.record(*at) for at in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in kinds], names=[c for c, _ in kinds])

    keys = wanted.where("key IS NOT NULL").select("key").mapInArrow(parted, "key string, part int")
    keys = keys.repartition(max(1, len(ranges)), "part").sortWithinPartitions("part", "key").select("key")
    located = cut(keys.mapInArrow(placed, "file string, offset long, length long"))
    stretch = F.expr(f"offset div {READ_BYTES}")
    tasks = located.select("file", stretch).distinct().count()
    return located.repartition(max(1, tasks), "file", stretch).sortWithinPartitions("file", "offset").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payload)


def archive_and_read(pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes archives and their index, then reads every capture back through the index. Without a folder they stand in the
    shared folder only until they are read."""
    spark, own = pages.sparkSession, folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    captures = write_archives(pages, own, **columns)
    found = read_records(captures.select("key").distinct(), own, write_index(captures, own))
    if folder is None:
        found = cut(found)
        remove(spark, own)
    return found
