"""WARC archives written and read as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of bounded size. The writer makes those rows one at a time over
the page's own buffer, updates the payload's digest with each and feeds it into gzipped archives, a member a record;
the reader streams them out again, a row a chunk, each carrying the length and the SHA-1 of the payload up to there. So
beyond the row of ``pages`` itself no task builds a whole record. Archives begin with a warcinfo record, a page is an HTTP
response, and an archive that has reached ``roll`` bytes is followed by another. They go to the shared folder
through pyarrow's filesystems (file, s3, gs, hdfs, by the folder's scheme), each to a name of its own attempt; only
the names that finished tasks return are read, so a task that ran twice or was lost leaves nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm.runtime import lookup, new_path, prepare, stage

CHUNK = 256 * 1024
#: Compressed bytes after which a new archive is begun.
ROLL = 1 << 30
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIELDS = (("page_id", "X-Page-ID"), ("refers_to", "X-Refers-To-Page-ID"), ("payload_bytes", "X-Payload-Length"), ("payload_digest", "WARC-Payload-Digest"), ("record_type", "WARC-Type"), ("url", "WARC-Target-URI"))
CHUNKS = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, chunk binary"


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """For any scheme pyarrow knows; ``file:/x`` as Hadoop writes it counts as ``file:///x``."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def header(fields: dict[str, str]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


class Archive:
    """An archive being written: gzip members, each begun by a header and fed in chunks."""

    def __init__(self, folder: str, date: str):
        self.system, base = filesystem(folder)
        self.system.create_dir(base, recursive=True)
        self.name, self.size = f"{uuid.uuid4().hex}.warc.gz", 0
        self.out = self.system.open_output_stream(posixpath.join(base, self.name), compression=None, buffer_size=1 << 20)
        about = b"software: edgetide\r\nformat: WARC File Format 1.1\r\n"
        self.begin({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": date, "WARC-Filename": self.name, "Content-Type": "application/warc-fields", "Content-Length": str(len(about))})
        self.feed(about)
        self.end()

    def begin(self, fields: dict[str, str]) -> None:
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.feed(header(fields))

    def feed(self, data: bytes | memoryview) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self._put(self.member.compress(b"\r\n\r\n") + self.member.flush())

    def _put(self, packed: bytes) -> None:
        if packed:
            self.out.write(packed)
            self.size += len(packed)

    def close(self) -> None:
        self.out.close()


def chunks(payload: memoryview, chunk: int = CHUNK) -> Iterator[tuple[int, memoryview, bool, str]]:
    """(chunk number, bytes, last, SHA-1 so far in hex) of a payload, one at a time and without a copy; one if it is empty."""
    sha = hashlib.sha1()
    for number, at in enumerate(range(0, max(1, len(payload)), chunk)):
        part = payload[at : at + chunk]
        sha.update(part)
        yield number, part, at + chunk >= len(payload), sha.hexdigest()


def _write(folder: str, date: str, chunk: int, roll: int):
    """Rows (page_id, url, body, sha, size, record_type, refers_to, place) to archives."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, names, attempt = None, [], uuid.uuid4().hex
        number = 0
        for batch in batches:
            body = batch.column("body")
            for i, (page, url, sha, size, kind, refers) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "sha", "size", "record_type", "refers_to")))):
                if archive is None or archive.size >= roll:
                    if archive:
                        archive.close()
                    archive = Archive(folder, date)
                    names.append(archive.name)
                number += 1
                # the response that others revisit has an id that they can name
                own = record_id("response", page, sha, size) if batch.column("named")[i].as_py() else record_id(attempt, number)
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                held = size if kind == "response" else 0
                fields = {"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
                fields |= {"WARC-Payload-Digest": "sha1:" + base32_sha1(sha), "X-Payload-Length": str(size), "Content-Length": str(len(block) + held)}
                fields |= {} if page is None else {"X-Page-ID": str(page)}
                fields |= {} if refers is None else {"WARC-Refers-To": record_id("response", refers, sha, size), "X-Refers-To-Page-ID": str(refers), "WARC-Profile": IDENTICAL}
                target = url if url else f"urn:page:{page}"
                fields |= {"WARC-Target-URI": "".join(c if c > " " else f"%{ord(c):02X}" for c in target)}
                archive.begin(fields)
                archive.feed(block)
                if held:
                    for _, part, last, so_far in chunks(memoryview(body[i].as_buffer()), chunk):
                        archive.feed(part)
                        if last and so_far != sha:
                            raise ValueError(f"page {page} changed while it was written")
                archive.end()
        if archive:
            archive.close()
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["archive"])

    return each


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an open archive. Holds a header and a chunk at a time."""
    unpack, packed, ready = None, b"", bytearray()

    def more() -> bool:
        """Unpack a bounded amount; at a member's end the next one begins."""
        nonlocal unpack, packed
        if not packed:
            packed = stream.read(1 << 16)
            if not packed:
                return False
        unpack = unpack or zlib.decompressobj(31)
        ready.extend(unpack.decompress(packed, 1 << 18))
        packed = unpack.unused_data if unpack.eof else unpack.unconsumed_tail
        if unpack.eof:
            unpack = None
        return True

    while True:
        while (end := ready.find(b"\r\n\r\n")) < 0:
            if not more():
                if ready:
                    raise ValueError("archive ends within a header")
                return
        lines = ready[:end].decode().split("\r\n")
        del ready[: end + 4]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins with {lines[0][:20]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        left, number, so_far, sha = int(fields["Content-Length"]), 0, 0, hashlib.sha1()
        base = {name: fields.get(key) for name, key in _FIELDS}
        if fields.get("Content-Type", "").startswith("application/http"):
            # the payload is what follows the block's own header
            while (end := ready.find(b"\r\n\r\n")) < 0:
                if not more():
                    raise ValueError("archive ends within a block's header")
            left -= end + 4
            del ready[: end + 4]
        while True:
            while len(ready) < min(left, chunk):
                if not more():
                    raise ValueError("archive ends within a payload")
            part = bytes(ready[: min(left, chunk)])
            del ready[: len(part)]
            left -= len(part)
            so_far += len(part)
            sha.update(part)
            if fields["WARC-Type"] != "warcinfo":
                yield base | {"chunk_no": number, "last": not left, "bytes_so_far": so_far, "digest_so_far": base64.b32encode(sha.digest()).decode(), "chunk": part}
            number += 1
            if not left:
                break
        while len(ready) < 4:
            if not more():
                raise ValueError("archive ends before a record does")
        del ready[:4]


def _read(folder: str, with_chunks: bool, rows: int = 512):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        names = [x.split()[0] for x in CHUNKS.split(", ")]
        types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
        kinds = [types[x.split()[1]] for x in CHUNKS.split(", ")]

        def packed(held: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([h[n] for h in held], k) for n, k in zip(names, kinds)], names=names)

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                held, size = [], 0
                with system.open_input_stream(posixpath.join(base, name), compression=None) as stream:
                    for r in read_records(stream):
                        r["archive"] = name
                        r["page_id"] = None if r["page_id"] is None else int(r["page_id"])
                        r["refers_to"] = None if r["refers_to"] is None else int(r["refers_to"])
                        r["payload_bytes"] = int(r["payload_bytes"])
                        r["payload_digest"] = r["payload_digest"].removeprefix("sha1:")
                        size += len(r["chunk"])
                        if not with_chunks:
                            r["chunk"] = None
                        held.append(r)
                        if len(held) >= rows or size >= 8 << 20:
                            yield packed(held)
                            held, size = [], 0
                if held:
                    yield packed(held)

    return each


def plan_records(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """pages (page_id, url, html) with body, size, sha (hex), record_type, refers_to, and ``named``: revisits refer to it.

    Of pages with equal payloads of ``revisit_from`` bytes or more, the one with the largest page_id is the response
    and the others revisit it. A null html is an empty payload. A null page_id is below all others; rows that
    share the largest page_id (or all of whose page_ids are null) are all responses.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"))
    full = full.select("*", F.octet_length("body").cast("long").alias("size"), F.sha1("body").alias("sha"))
    again = full.where(F.col("size") >= revisit_from).groupBy("sha", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 and keeper is not null")
    again = lookup(stage(again.drop("n"), "warc-repeated"))
    joined = full.join(again, ["sha", "size"], "left")
    later = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    kind = F.when(later, "revisit").otherwise("response").alias("record_type")
    named = F.col("keeper").isNotNull() & F.col("page_id").eqNullSafe(F.col("keeper"))
    return joined.select("page_id", "url", "body", "size", "sha", kind, F.when(later, F.col("keeper")).alias("refers_to"), named.alias("named"))


def write_archives(pages: DataFrame, folder: str | None = None, revisit_from: int = 0, chunk: int = CHUNK, roll: int = ROLL) -> tuple[str, DataFrame]:
    """Write a record per row of pages (page_id, url, html; more columns are ignored); returns the folder and a staged
    table of the archives' names.

    Repeated rows are a record each. A page without url has one made of its page_id; a null html is an empty payload. An
    empty table makes no archive. Pages that share the largest page_id of a payload share the id that revisits name.
    """
    spark = prepare(pages.sparkSession)
    folder = folder or new_path(spark, "warc")
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = plan_records(pages, revisit_from)
    return folder, stage(rows.mapInArrow(_write(folder, date, chunk, roll), "archive string"), "warc-archives")


def read_archives(folder: str, archives: DataFrame, with_chunks: bool = True) -> DataFrame:
    """The chunk table of the archives (see CHUNKS), one task an archive if there are enough tasks; warcinfo records have no
    row. Without ``with_chunks`` the bytes themselves are left out. No archive gives no rows."""
    prepare(archives.sparkSession)
    n = max(1, min(archives.count(), 4096))
    return archives.select("archive").repartition(n).mapInArrow(_read(folder, with_chunks), CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record from its last chunk, which carries the whole payload's length and digest.

    A record whose payload does not have the length and digest that its header gives stops the job.
    """
    bad = (F.col("record_type") == "response") & ((F.col("bytes_so_far") != F.col("payload_bytes")) | (F.col("digest_so_far") != F.col("payload_digest")))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("payload differs from its header in "), "archive"))).otherwise(F.col("payload_digest"))
    return chunks.where("last").select("page_id", "payload_bytes", checked.cast("string").alias("payload_digest"), "record_type", "refers_to")
