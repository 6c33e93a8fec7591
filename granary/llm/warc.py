"""WARC archives of web pages: one gzip member per record, read back in sequence.

Writing: a page's payload is its html in UTF-8. Of the pages with equal payloads of at least ``REVISIT_FROM`` bytes
the one with the largest page_id is stored as response, the others as revisit records that name it; smaller payloads are
always stored. Each task writes archives of about ``ARCHIVE_BYTES`` into a shared folder under names of their
own; the table of archives that Spark commits lists those of successful attempts only, so files that a lost
executor left are never read.

Reading: each archive is one stream. Members are decompressed piece by piece, a record's header is read up to its
empty line and its block by Content-Length; block digests of all records and payload digests of responses are
verified, and so is that each record ends with its member. A record at fault raises.

Null html is the empty payload, a null url leaves out the target, a null page_id leaves out the page's number (null
again when read). Rows that repeat the largest page_id of their payload are all responses. An empty table
makes no archive and no rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import in_arrow, saved, slices
from granary.session import scratch_path

REVISIT_FROM, ARCHIVE_BYTES, PIECE = 1000, 64 << 20, 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STAMP = "2000-01-01T00:00:00Z"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _record_id(page_id: int | None, payload: bytes) -> str:
    name = f"page:{page_id}" if page_id is not None else "payload:" + hashlib.sha1(payload).hexdigest()
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit, if it refers to a page."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(page_id, payload)),
              ("WARC-Date", STAMP), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Block-Digest", _sha1(block)), ("WARC-Payload-Digest", _sha1(payload)), ("Content-Length", len(block))]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]")))
    if page_id is not None:
        fields.append(("X-Page-ID", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _record_id(refers_to, payload)), ("X-Refers-To-Page-ID", refers_to)]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def _members(stream) -> Iterator[bytes]:
    """The content of each gzip member, of one at a time."""
    rest = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = rest or stream.read(PIECE)
            rest = b""
            if not piece:
                if parts:
                    raise ValueError("the archive ends inside a member")
                return
            parts.append(unpacker.decompress(piece))
        rest = unpacker.unused_data
        yield b"".join(parts)


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record, framing and digests verified."""
    for member in _members(stream):
        head, mark, rest = member.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not mark or not version.startswith("WARC/"):
            raise ValueError("no WARC header at the start of a member")
        fields = dict(line.split(": ", 1) for line in lines)
        length = int(fields["Content-Length"])
        block = rest[:length]
        if len(block) != length or rest[length:] != b"\r\n\r\n":
            raise ValueError(f"{fields['WARC-Record-ID']}: the block does not fill its length")
        if _sha1(block) != fields["WARC-Block-Digest"]:
            raise ValueError(f"{fields['WARC-Record-ID']}: wrong block digest")
        yield fields, block


def _page(fields: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null in a revisit)."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    stored = fields["WARC-Type"] == "response"
    if stored and (len(payload) != length or _sha1(payload) != fields["WARC-Payload-Digest"]):
        raise ValueError(f"{fields['WARC-Record-ID']}: wrong payload digest")
    number = lambda name: int(fields[name]) if name in fields else None
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    return (number("X-Page-ID"), fields.get("WARC-Target-URI"), length, digest, fields["WARC-Type"],
            number("X-Refers-To-Page-ID"), payload if stored else None)


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html and refers_to: the page whose payload this page repeats, else null.

    Copies are counted per payload before the shuffle; only payloads that occur twice are joined back.
    """
    key = F.struct(F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n"))
    keyed = pages.select("page_id", "url", "html", key.sha.alias("sha"), key.n.alias("n"))
    copied = keyed.where(F.col("n") >= REVISIT_FROM).groupBy("sha", "n").agg(
        F.count("*").alias("copies"), F.max("page_id").alias("top")).where("copies > 1").select(
        F.col("sha").alias("of_sha"), F.col("n").alias("of_n"), "top")
    joined = keyed.join(saved(copied, "copied"), (F.col("sha") == F.col("of_sha")) & (F.col("n") == F.col("of_n")), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write page_id, url, html, refers_to as archives below a shared folder; the table (path, records, bytes) of them."""
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, count, size = None, "", 0, 0
        made: list[tuple[str, int, int]] = []
        for batch in slices(batches, "html"):
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    path, count, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                data = record(page_id, url, (html or "").encode(), refers_to)
                out.write(data)
                count, size = count + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    made.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            made.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            list(zip(*made, strict=True)) or [[], [], []], (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])
    return saved(in_arrow(pages.select("page_id", "url", "html", "refers_to"), stage, "path string, records bigint, bytes bigint"), "archives")


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of the archives listed in ``path``; each archive is read by one task in sequence."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, place = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_stream(place, compression=None) as stream:
                    for fields, block in records(stream):
                        row = _page(fields, block)
                        rows.append(row if payloads else (*row[:-1], None))
                        held += len(block)
                        if held > PIECE << 6 or len(rows) >= 4096:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"
    # a task per archive: the table is small, but its rows stand for large files
    return in_arrow(archives.select("path").repartition(max(1, archives.count())), stage, schema)


def archived(pages: DataFrame) -> DataFrame:
    """Write pages as archives in the session's shared folder and read them back, payloads verified and left out."""
    folder = scratch_path(pages.sparkSession, "warc")
    if "://" not in folder:
        folder = "file://" + folder if folder.startswith("/") else folder.replace("file:", "file://", 1)
    return read_archives(write_archives(with_revisits(pages), folder), payloads=False).drop("payload")
