"""WARC archives with revisit records.

Headers (identifier, url, payload digest, length) are shuffled by digest, without payloads; each digest of more than one
record keeps its smallest identifier's record as the original. Records join their digest's original and are written anew:
the original as ``response`` with its payload, the others as ``revisit`` with the original's record identifier and the
response's HTTP head but no payload. Only digests met twice are joined, from a written table, so Spark sees its size: a
small one is broadcast, a large one is joined by shuffle, where AQE splits a hot digest.

Each attempt of a task writes a gzip archive of its own, a member for each record; the manifest, which Spark commits once
per partition, names the archives that count. Dates are a parameter, so reruns write equal records.

Cases: null html is an empty payload; empty payloads are equal to each other; a null url writes no target; control
characters and white space in a url are percent-encoded in the archive; a null identifier is never an original where its
digest has another; rows that repeat an original's identifier and payload are that original again, each a response, and
have one record identifier, which is made of the page's and the payload's digest; an empty table gives no archive; other
columns are not read; a very long payload is handled whole, one record at a time.

The reader takes other archives as well, compressed by member, as a whole, or not at all: records other than responses,
revisits and resources are passed over; identifiers that aren't of this writer give a null ``page_id`` and stay in
``record_id`` and ``refers_to_id``; a payload digest that isn't a SHA-1 in base 32 is worked out from the payload, and is null for a revisit
that tells none; a response that does not match its own digest or length, and a damaged rest of a file, tell ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstruct.llm.common import attempt_name, batch, cut, fresh_dir, open_fs

DATE, PROFILE = "2024-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_BYTES = 0
_ID = "urn:x-page:"
_MANIFEST = pa.schema([("archive", pa.int32()), ("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, path string, offset long, length long, record_id string, refers_to_id string, error string"
_RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("error", pa.string())])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _name(page_id: int | None, digest: str) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}:{digest}>"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None = None, first_url: str | None = None, n_bytes: int | None = None, date: str = DATE) -> bytes:
    """One record, uncompressed. A revisit carries the HTTP head alone, which states the payload's length."""
    n = len(payload) if n_bytes is None else n_bytes
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [("WARC-Type", kind), ("WARC-Record-ID", _name(page_id, digest)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _name(first, digest)), ("WARC-Refers-To-Date", date)] + ([("WARC-Refers-To-Target-URI", _uri(first_url))] if first_url is not None else [])
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 3) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(source, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, compressed length and content of each gzip member; holds one member and one read."""
    at, data, start = 0, b"", 0
    while data or (data := source.read(size)):
        d, parts, used = zlib.decompressobj(31), [], 0
        while not d.eof:
            if not data and not (data := source.read(size)):
                raise ValueError("the archive is cut short")
            parts.append(d.decompress(data))
            used += len(data) - len(d.unused_data)
            data = d.unused_data
        start, at = at, at + used
        yield start, used, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and block of a record."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode(errors="replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        raise ValueError("a record without a length")
    n = int(fields["content-length"])
    if len(rest) != n + 4:
        raise ValueError("a block of another length than stated")
    return fields, rest[:n]


def plain_records(source, size: int = 1 << 20) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each record of an archive that is not compressed, or is one stream; holds one record and one read."""
    at, data = 0, b""
    while True:
        while (end := data.find(b"\r\n\r\n")) < 0 and (more := source.read(size)):
            data += more
        if not data.strip():
            return
        found = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[: max(end, 0)])
        if found is None:
            raise ValueError("a record without a length")
        n = end + 4 + int(found[1]) + 4
        parts, held = [data], len(data)
        while held < n and (more := source.read(size)):
            parts.append(more)
            held += len(more)
        data = b"".join(parts)
        if len(data) < n:
            raise ValueError("the archive is cut short")
        yield at, n, data[:n]
        at, data = at + n, data[n:]


class _Joined:
    """The content of gzip members as one stream."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts = parts

    def read(self, size: int) -> bytes:
        return next((p for p in self.parts if p), b"")


def inflated(source, size: int = 1 << 20) -> Iterator[bytes]:
    """What a compressed stream holds, a bounded part at a time."""
    d, data = zlib.decompressobj(31), b""
    while data or (data := source.read(size)):
        if d.eof:
            d = zlib.decompressobj(31)
        yield d.decompress(data, size)
        data = d.unconsumed_tail or d.unused_data
    if not d.eof:
        raise ValueError("the archive is cut short")


def records(open_source) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each record, however the archive is compressed. ``open_source`` opens it from its start."""
    with open_source() as source:
        head = source.read(2)
    if head != b"\x1f\x8b":
        with open_source() as source:
            yield from plain_records(source)
        return
    with open_source() as source:  # the first record's end tells whether it is a member of its own
        first = next(plain_records(_Joined(inflated(source))), None)
    with open_source() as source:
        d, got = zlib.decompressobj(31), 0
        while first is not None and not d.eof and got <= len(first[2]) and (data := d.unconsumed_tail or source.read(1 << 20)):
            got += len(d.decompress(data, len(first[2]) + 1 - got))
    with open_source() as source:
        if first is not None and d.eof and got == len(first[2]):
            yield from members(source)
        else:  # offsets are then of the content
            yield from plain_records(_Joined(inflated(source)))


def resolve(pages: DataFrame, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, n_bytes, first, first_url``; ``first`` is null for a response."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("n_bytes"), F.unhex(F.sha1(html.cast("binary"))).alias("digest"))
    headers = rows.select("page_id", "url", "digest", "n_bytes").where(F.col("n_bytes") >= min_bytes)
    firsts = cut(headers.groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("f"), F.count("*").alias("n")).where("n > 1 and f is not null").select("digest", F.col("f.page_id").alias("first"), F.col("f.url").alias("first_url")))
    met = rows.join(firsts, "digest", "left")
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return met.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "n_bytes", F.base64("digest").alias("digest"), again.alias("revisit"), F.when(again, F.col("first")).alias("first"), F.when(again, F.col("first_url")).alias("first_url"))


def write_archives(pages: DataFrame, out: str, min_bytes: int = MIN_BYTES, date: str = DATE) -> None:
    """Write the records of ``pages`` as archives below ``out``, with their manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, name, records, size = None, attempt_name("pages", ".warc.gz"), 0, 0
        to, base = open_fs(out)
        for b in batches:
            for r in b.to_pylist():
                if sink is None:
                    to.create_dir(base, recursive=True)
                    sink = to.open_output_stream(f"{base}/{name}", compression=None)
                digest = base64.b32encode(base64.b64decode(r["digest"])).decode()
                kind = "revisit" if r["revisit"] else "response"
                size += sink.write(_gzip(record(kind, r["page_id"], r["url"], (r["html"] or "").encode(), digest, r["first"], r["first_url"], r["n_bytes"], date))) or 0
                records += 1
        if sink is not None:
            size = sink.tell()
            sink.close()
            yield batch(_MANIFEST, [TaskContext.get().partitionId()], [f"{out}/{name}"], [records], [size])

    resolve(pages, min_bytes).mapInArrow(write, "archive int, path string, records long, bytes long").write.parquet(f"{out}/manifest")


def _page(name: str | None) -> int | None:
    own = (name or "").strip("<>").removeprefix(_ID).partition(":")[0]
    return int(own) if (name or "").strip("<>").startswith(_ID) and re.fullmatch(r"-?\d{1,18}", own) else None


def _told(fields: dict[str, str], block: bytes) -> tuple[int | None, str | None, str | None]:
    """Length and digest of a record's payload, and what is wrong with it."""
    http, kind = fields.get("content-type", "").startswith("application/http"), fields["warc-type"]
    head, _, payload = block.partition(b"\r\n\r\n") if http else (b"", b"", block)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    stated = stated if re.fullmatch("[A-Z2-7]{32}", stated) else None
    size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head + b"\r\n")
    if kind == "revisit":
        return int(size[1]) if size else None, stated, None
    coded = re.search(rb"(?i)\r\n(?:content|transfer)-encoding:[ \t]*(?!identity)\w", head)
    digest, wrong = base32_sha1(payload), None
    if stated is not None and stated != digest:
        wrong = "a payload of another digest than stated"
    elif size and not coded and int(size[1]) != len(payload):
        wrong = "a payload of another length than stated"
    return len(payload), digest, wrong


def read_files(paths: DataFrame, path_col: str = "path", tasks: int = 1, strict: bool = False) -> DataFrame:
    """A row for each response, revisit or resource of the archives at ``path``, a file being one task's work at most; ``strict`` ends the job at an error."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = open_fs(path)
                rows, at, n = [], 0, 0
                try:
                    for at, n, data in records(lambda: where.open_input_stream(name, compression=None)):
                        fields, block = parse(data)
                        if (kind := fields.get("warc-type")) not in ("response", "revisit", "resource"):
                            continue
                        length, digest, wrong = _told(fields, block)
                        if wrong and strict:
                            raise ValueError(wrong)
                        ident, to = fields.get("warc-record-id"), fields.get("warc-refers-to") if kind == "revisit" else None
                        rows.append((_page(ident), length, digest, kind, _page(to), fields.get("warc-target-uri"), path, at, n, ident, to, wrong))
                        if len(rows) == 4096:
                            yield batch(_RECORDS, *zip(*rows, strict=True))
                            rows = []
                except (ValueError, OSError, zlib.error) as e:
                    if strict:
                        raise
                    rows.append((*[None] * 6, path, at + n, None, None, None, f"{type(e).__name__}: {e}"))
                if rows:
                    yield batch(_RECORDS, *zip(*rows, strict=True))

    return paths.select(F.col(path_col).alias("path")).repartition(max(1, tasks)).mapInArrow(read, RECORDS)


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """The records of the archives that a manifest names; a response's length and digest are of the payload read, a revisit's those it states."""
    archives = spark.read.schema("archive int, path string, records long, bytes long").parquet(f"{out}/manifest")
    return read_files(archives, tasks=archives.count(), strict=True)


def originals(records: DataFrame) -> DataFrame:
    """Each revisit with the place of the response it refers to, so that its payload can be read."""
    to = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("path").alias("response_path"), F.col("offset").alias("response_offset"), F.col("length").alias("response_length"))
    return records.where("record_type = 'revisit'").join(to, "refers_to").select("page_id", "refers_to", "payload_digest", "response_path", "response_offset", "response_length")


def deduplicated_archives(pages: DataFrame, min_bytes: int = MIN_BYTES, out: str | None = None) -> DataFrame:
    spark = pages.sparkSession
    out = out or fresh_dir(spark, "warc")
    write_archives(pages, out, min_bytes)
    return read_archives(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB: base 32 from the bits of the hexadecimal digest.
WARC_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
h AS (SELECT DISTINCT hex FROM p),
b AS (SELECT hex, list_aggregate(list_transform(range(1, 41), lambda i: ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), 'string_agg', '') AS bits FROM h),
d AS (SELECT hex, list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest FROM b),
f AS (SELECT hex, min(page_id) AS first FROM p GROUP BY hex)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (hex) JOIN d USING (hex)
"""
