import base64
import gzip
import hashlib

import duckdb
import pytest

from docstruct.llm import warc
from docstruct.llm.common import fresh_dir, open_fs
from docstruct.llm.registry import op6_warc
from tests.conftest import MEDIUM

PAGE = "page_id long, url string, html string"


def test_cases(spark):
    data = [(3, "http://a/", "same"), (1, "http://b/\n x", "same"), (2, None, "same"), (5, "http://c/", None), (4, "http://d/", ""), (7, "http://e/", "é" * 500_000), (None, "http://f/", "same"), (None, "http://g/", "lone"), (9, "http://h/", "twice"), (9, "http://h/", "twice")]
    pages = spark.createDataFrame([(*r, 1) for r in data], PAGE + ", digest int")
    out = fresh_dir(spark, "w")
    warc.write_archives(pages, out)
    records = warc.read_archives(spark, out)
    first = {"same": 1, "": 4}
    want = []
    for i, _, t in data:
        t = t or ""
        again = t in first and first[t] != i
        want.append((i, len(t.encode()), base64.b32encode(hashlib.sha1(t.encode()).digest()).decode(), "revisit" if again else "response", first[t] if again else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in records.collect())
    assert {r.url for r in records.where("page_id = 1").collect()} == {"http://b/%0A%20x"}
    for r in warc.originals(records).collect():
        where, name = open_fs(r.response_path)
        with where.open_input_file(name) as f:
            f.seek(r.response_offset)
            fields, block = warc.parse(gzip.decompress(f.read(r.response_length)))
        assert warc.base32_sha1(block.partition(b"\r\n\r\n")[2]) == r.payload_digest and fields["warc-type"] == "response"
    assert warc.originals(records).count() == 4
    assert warc.deduplicated_archives(spark.createDataFrame([], PAGE)).count() == 0
    assert {r.record_type for r in warc.deduplicated_archives(pages, min_bytes=10**9).collect()} == {"response"}


def test_damage():
    with pytest.raises(ValueError):
        warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.members(__import__("io").BytesIO(gzip.compress(b"x" * 1000)[:-9])))


def test_members_over_small_reads():
    parts = [b"a" * 10, b"", b"b" * 70_000]
    data = b"".join(warc._gzip(p) for p in parts)
    found = list(warc.members(__import__("io").BytesIO(data), size=7))
    assert [p for _, _, p in found] == parts
    assert [gzip.decompress(data[a : a + n]) for a, n, _ in found] == parts


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{MEDIUM}/pages.parquet'")
    want = con.sql(warc.WARC_SQL).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in op6_warc(spark, MEDIUM).collect())


FOREIGN = [
    b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n",
    b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://x/\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 40\r\n\r\nHTTP/1.1 200 OK\r\nServer: s\r\n\r\nbody body\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Payload-Digest: sha1:AAAAAAAAAAAAAAAAAAAAAAAAAAAAAAAA\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 20\r\n\r\nHTTP/1.1 200 OK\r\n\r\nb\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Refers-To: <urn:uuid:2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:5>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nplain\r\n\r\n",
]


@pytest.mark.parametrize("form", ["members", "stream", "plain", "cut"])
def test_foreign_archives(spark, tmp_path, form):
    whole = b"".join(FOREIGN)
    data = {"members": b"".join(map(gzip.compress, FOREIGN)), "stream": gzip.compress(whole), "plain": whole, "cut": b"".join(map(gzip.compress, FOREIGN))[:-30]}[form]
    (tmp_path / "a.warc").write_bytes(data)
    got = sorted((tuple(r) for r in warc.read_files(spark.createDataFrame([(str(tmp_path / "a.warc"),)], "path string")).select("record_id", "record_type", "payload_bytes", "payload_digest", "refers_to_id", "url", "page_id", "error").collect()), key=str)
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    want = [("<urn:uuid:2>", "response", 10, sha(b"body body\n"), None, "http://x/", None, None), ("<urn:uuid:3>", "response", 1, sha(b"b"), None, None, None, "a payload of another digest than stated"), ("<urn:uuid:4>", "revisit", None, None, "<urn:uuid:2>", None, None, None), ("<urn:uuid:5>", "resource", 5, sha(b"plain"), None, None, None, None)]
    if form == "cut":
        want = want[:3] + [(None, None, None, None, None, None, None, "ValueError: the archive is cut short")]
    assert got == sorted(want, key=str)


def test_plain_records_over_small_reads():
    whole = b"".join(FOREIGN) * 3
    found = list(warc.plain_records(__import__("io").BytesIO(whole), size=5))
    assert [d for _, _, d in found] == FOREIGN * 3 and [whole[a : a + n] for a, n, _ in found] == FOREIGN * 3
