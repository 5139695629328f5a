import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docstruct.llm import matroska as m
from docstruct.llm.registry import op4_matroska
from tests.conftest import SMALL


@given(st.integers(0, (1 << 56) - 2))
def test_sizes(n):
    data = m.size_vint(n)
    assert m.read_vint(data, 0) == (n, len(data))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=2, max_size=9), st.sampled_from([m.XIPH, m.EBML_LACE]))
def test_lacing(frames, kind):
    data = b"head" + m.lace(frames, kind)
    assert [data[a:b] for a, b in m.unlace(data, 4, len(data), kind)] == frames


def test_fixed_lacing():
    frames = [b"abcd", b"efgh", b"ijkl"]
    data = m.lace(frames, m.FIXED)
    assert [data[a:b] for a, b in m.unlace(data, 0, len(data), m.FIXED)] == frames
    with pytest.raises(ValueError):
        m.lace([b"a", b"bc"], m.FIXED)
    with pytest.raises(ValueError):
        m.unlace(data + b"x", 0, len(data) + 1, m.FIXED)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 8, 576 * 8 + 1, 400_000])
def test_round_trip(n):
    payload = m.payload_of(bytes(i * 7 % 256 for i in range(n)))
    data = m.mux(payload)
    media = m.demux(data)
    assert m.read_payload(data, media) == payload and len(payload) % 576 == 0
    assert [c[2] for c in media.cues] == media.clusters and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    assert [p.timestamp for p in media.packets] == [12 * k for k in range(len(payload) // 576)]
    assert data == m.mux(payload)


def test_unknown_sizes_and_groups():
    block = m.size_vint(1) + b"\0\5\0" + b"frame"
    cluster = b"\x1f\x43\xb6\x75" + b"\x01" + b"\xff" * 7 + m.number(m.TIMESTAMP, 100) + m.element(m.BLOCK_GROUP, m.element(m.BLOCK, block))
    data = m.element(m.EBML, b"") + b"\x18\x53\x80\x67" + b"\x01" + b"\xff" * 7 + cluster + cluster + m.element(m.CUES, b"")
    found = m.demux(data).packets
    assert [(p.timestamp, data[p.first_byte : p.last_byte], p.cluster) for p in found] == [(105, b"frame", 0), (105, b"frame", 1)]


def test_damaged():
    data = m.mux(m.payload_of(b"x"))
    with pytest.raises(ValueError):
        m.demux(data[:-40])


def test_scale_of_the_file():
    data = m.mux(m.payload_of(b"y" * 576 * 3))
    assert [(p.timestamp, p.nanoseconds) for p in m.demux(data).packets] == [(0, 0), (12, 12_000_000), (24, 24_000_000)]
    at = data.index(m.number(m.TIMESTAMP_SCALE, 1_000_000))
    for scale, ticks in ((2_000_000, [0, 6, 12]), (500_000, [0, 24, 48])):
        other = data[:at] + m.element(m.TIMESTAMP_SCALE, scale.to_bytes(3, "big")) + data[at + 7 :]
        assert [(p.timestamp, p.nanoseconds) for p in m.demux(other).packets] == [(t, 12_000_000 * k) for k, t in enumerate(ticks)]


def test_damaged_files_in_columns(spark):
    whole = m.mux(m.payload_of(b"z" * 576 * 20))
    files = [(1, whole), (2, whole[:-40]), (3, b""), (4, b"\0\0"), (5, None), (6, whole[:700]), (7, b"not a file of this kind at all")]
    media = spark.createDataFrame([(i, 0, f) for i, f in files], "doc_id long, n_bytes long, media binary")
    told = {r.id for r in m.packet_table(media).where("error is not null").collect()}
    counts = {r.id: r["count"] for r in m.packet_table(media).where("error is null").groupBy("id").count().collect()}
    assert told == {2, 3, 4, 6, 7} and counts[1] == 20 and counts[2] == 16 and 5 not in counts
    out = {r.doc_id: r for r in m.media_features(media).collect()}
    assert {i for i, r in out.items() if r.error} == told and out[1].payload_bytes == 576 * 20 and out[5].media_bytes is None and out[6].media_bytes == 700


def test_documents_against_brute_force(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    out = op4_matroska(spark, SMALL).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    for r in out:
        text = docs[r.doc_id]
        payload = text + b"\xff" * (576 - len(text) % 576 if len(text) % 576 or not text else 0)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), None)
        frames, counts = len(payload) // 576, [0] * 8
        for c in payload:
            counts[c >> 5] += 1
        mean = sum(payload) / len(payload)
        sd = (sum(c * c for c in payload) / len(payload) - mean * mean) ** 0.5
        clusters = -(-frames // 256)
        assert r.feature.startswith(f"packets={frames};clusters={clusters};") and f";cues={clusters}/{clusters};end={12 * (frames - 1)};mean={mean:.4f};sd={sd:.4f};bins={','.join(map(str, counts))}" in r.feature
        assert len(payload) < r.media_bytes < len(payload) * 1.05 + 400


def test_columns(spark):
    data = [(1, None), (2, ""), (3, "é" * 1000), (4, "é" * 1000), (3, "é" * 1000), (None, "x" * 2_000_000)]
    docs = spark.createDataFrame([(*r, b"m") for r in data], "doc_id long, text string, media binary")
    media = m.media_column(docs)
    out = m.media_features(media).collect()
    assert len(out) == 6
    by = {r.doc_id: r for r in out}
    assert not any(r.error for r in out)
    for d, t in data:
        payload, r = m.payload_of((t or "").encode()), by[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((t or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(m.mux(payload)).hexdigest()
    assert by[1][1:] == by[2][1:] and by[3][1:] == by[4][1:] and by[1].feature.startswith("packets=1;clusters=1;")
    packets = m.packet_table(media.where("doc_id = 4")).orderBy("packet").collect()
    assert len(packets) == 4 and packets[-1].timestamp == 36 and packets[0].last_byte - packets[0].first_byte == 576
    assert m.media_features(m.media_column(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    assert m.packet_table(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
