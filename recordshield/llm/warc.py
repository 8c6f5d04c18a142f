"""Operator 10, WARC: index first.

Writing gives the archives and an index: file, offset, length, URL and payload digest of every record. Reading starts from the index: the records asked
for are dealt out by (file, stretch of STRETCH bytes) and sorted by offset; ranges that lie close together are read in one go and cut apart again. Records are
gzip members of their own, so each range can be read alone.

A payload that stands in several rows is stored once, in the response of the smallest page id; the other rows become revisit records that refer to it and carry
the digest and, in their HTTP header, the length of the payload. Shared payloads are found on digests; the payloads themselves move at most once, to meet them.

Each task writes files of its own names, new ones at every attempt; the index, written at once to the shared folder, names only those of the attempt that
succeeded. Files are reached by URI through pyarrow's file systems.

Defined cases: a null payload is written as an empty one, and empty payloads are equal payloads; of rows that repeat page id and payload all are responses;
a null page id sorts last, so it is the response only where all ids of a payload are null; a null URL leaves out its header, control characters in one are
percent-encoded; a payload that does not match its digest raises an error; an empty table gives an empty index.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from hashlib import sha1
from uuid import uuid4

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, store

FILE_BYTES = 256 << 20
STRETCH = 64 << 20
GAP = 64 << 10
READ_BYTES = 8 << 20
DATE = "2020-01-01T00:00:00Z"
_LEVEL = 3

INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string, refers_to long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, digest: str) -> bytes:
    """The bytes of one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; the payload of a response is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where the index has one")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page_of(fields["warc-refers-to"]) if revisit else None,
        "payload": None if revisit else payload,
    }


def _digest(payload: bytes) -> str:
    return base64.b32encode(sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write a record per row below ``folder`` and return the index, read back from the shared folder."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    marked = rows.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload")})
    shared = marked.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    shared = store(shared.select(F.col("sha").alias("s_sha"), F.col("size").alias("s_size"), "first"), "payloads")
    joined = marked.join(shared, (F.col("sha") == F.col("s_sha")) & (F.col("size") == F.col("s_size")), "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    joined = joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for start in range(0, batch.num_rows, 256):
                    for page, target, body, refers, again in zip(*[c.to_pylist() for c in batch.slice(start, 256).columns]):
                        if out is None or at >= FILE_BYTES:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid4().hex}.warc.gz", 0
                            out = files.open_output_stream(f"{root}/{name}", compression=None)
                        digest = _digest(body)
                        pack = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                        raw = pack.compress(record(page, target, body, refers, again, digest)) + pack.flush()
                        out.write(raw)
                        index.append((page, target, name, at, len(raw), digest, "revisit" if again else "response", refers))
                        at += len(raw)
                if index:
                    yield pa.RecordBatch.from_pylist([dict(zip(_INDEX.names, r)) for r in index], schema=_INDEX)
        finally:
            if out is not None:
                out.close()

    return store(joined.mapInArrow(write, INDEX), "warc-index")


_INDEX = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string()),
    ("record_type", pa.string()), ("refers_to", pa.int64()),
])


def coalesced(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(begin, end, members) of sorted (offset, length) ranges put together across gaps of up to GAP and up to READ_BYTES."""
    members: list[tuple[int, int]] = []
    begin = end = 0
    for offset, length in ranges:
        if members and (offset - end > GAP or max(end, offset + length) - begin > READ_BYTES):
            yield begin, end, members
            members = []
        if not members:
            begin = end = offset
        members.append((offset, length))
        end = max(end, offset + length)
    if members:
        yield begin, end, members


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the index rows given, any choice of them; ``payloads`` false leaves the payload column null."""
    spark = index.sparkSession
    wanted = index.select("file", "offset", "length", F.floor(F.col("offset") / STRETCH).alias("stretch"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = wanted.repartition(n, "file", "stretch").sortWithinPartitions("file", "offset")
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        for batch in batches:
            by_file: dict[str, list[tuple[int, int]]] = {}
            for file, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")]):
                by_file.setdefault(file, []).append((offset, length))
            for file, ranges in by_file.items():
                with files.open_input_file(f"{root}/{file}") as source:
                    for begin, end, members in coalesced(ranges):
                        raw = source.read_at(end - begin, begin)
                        found = [parse(zlib.decompress(raw[a - begin : a - begin + size], 31)) for a, size in members]
                        if not payloads:
                            found = [r | {"payload": None} for r in found]
                        yield pa.RecordBatch.from_pylist(found, schema=schema)

    return dealt.select("file", "offset", "length").mapInArrow(read, RECORDS)


def archive_folder(spark) -> str:
    return scratch_path(spark, "warc")
