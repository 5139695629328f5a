"""Token ids in sorted-string-table shards.

A shard holds documents in key order. Layout, integers little-endian unless said otherwise::

    data blocks | index | Bloom filter | footer (80 bytes)

* key: one byte 0 for a null identifier, else one byte 1 and the signed 64-bit identifier, big-endian, sign bit flipped,
  so that byte order is numeric order with nulls first.
* data block: entries ``varint shared, varint unshared, varint value length, key tail, value``; every ``restart``-th entry
  shares nothing. Then the u32 offsets of those restarts, their u32 count and a u32 CRC-32 of what precedes it.
* value: the document's ids, u16 where the vocabulary fits, else u32.
* index: per block u16 key length, last key, u64 offset, u32 length.
* Bloom filter: u32 number of probes, then the bits; probes are ``h1 + i * h2`` of two seeded XXH64.
* footer: u64 index offset and length, filter offset and length, documents, ids, u32 bytes of an id, u32 blocks, u64 zero,
  8 bytes magic, u64 format version.

Shards are written by range of the identifier, so that concatenated shards are in ascending order. Each attempt of a task
writes a file of its own; only the files in the manifest, which Spark commits once per partition, belong to the table.

Cases: null text is empty and has the end id alone; null identifiers come first; repeated identifiers keep all their rows,
in the order of their texts' hashes; an empty table gives no shard; other columns are not read. A very long text is encoded
whole, one at a time with its batch slice, and is one entry of a block of its own size.
"""

from __future__ import annotations

import os
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docstruct.llm.common import attempt_name, batch, fresh_dir, give_back, open_fs

MAGIC = b"DSSSTBL1"
FOOTER = struct.Struct("<QQQQQQIIQ8sQ")
BLOCK_BYTES, RESTART, BLOOM_BITS, BLOOM_PROBES = 64 << 10, 16, 10, 7
#: Text that is encoded at once: less takes less memory and looks common words up more often.
SLICE_BYTES = 4 << 20
#: Before a space that a printing character follows the byte-level pre-tokenizer always starts a new piece; this finds others.
_UNSAFE = r" ([^!-~\x{A1}-\x{24F}]|\z)"
#: Letters, then ASCII punctuation without the apostrophe: two pieces for that pre-tokenizer.
_PARTS = r"^(?P<letters>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all spans in turn."""
    ends = np.cumsum(sizes)
    out = np.repeat((starts - ends + sizes).astype(np.int32), sizes)
    out += np.arange(len(out), dtype=np.int32)
    return out


class Encoder:
    """Ids of texts by a byte-level tokenizer file, with a bounded table of the words already encoded.

    The pre-tokenizer cuts a text before each space that a printing character follows, and cuts letters from punctuation
    after them; it encodes what lies between cuts apart. So the ids of a text are those of its space-separated pieces in
    turn, and a piece's those of its letters and its tail. Distinct pieces of a batch are found by Arrow, and new words are
    encoded many to a call: a word's first token, and no other, begins with the space. Texts with any other space, or with an
    added token of the tokenizer (such as its end of text), are encoded whole, in a call of their own.
    """

    def __init__(self, path: str, limit: int = 250_000, at_once: int = 50):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # the byte-level sign of a space
        self.limit, self.at_once, self.words, self.older = limit, at_once, {}, {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        if len(self.words) > self.limit // 2:  # words met since the last turn stay
            self.older, self.words = self.words, {}
        plain = [w for w in words if "!" <= w[:1] <= "~" or "\xa1" <= w[:1] <= "\u024f"]
        if len(plain) < len(words):
            other = [w for w in words if not ("!" <= w[:1] <= "~" or "\xa1" <= w[:1] <= "\u024f")]
            self.words.update(zip(other, self.whole([" " + w for w in other]), strict=True))
        lines = [" " + " ".join(plain[i : i + self.at_once]) for i in range(0, len(plain), self.at_once)]
        for k, e in enumerate(e for i in range(0, len(lines), 100) for e in self.tokenizer.encode_batch_fast(lines[i : i + 100], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = (np.flatnonzero(self.opens[ids]) * ids.itemsize).tolist() + [ids.nbytes]
            data = ids.tobytes()
            self.words.update(zip(plain[k * self.at_once : (k + 1) * self.at_once], [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def _table(self, words: list[str]) -> list[bytes]:
        """Ids of each word, a space before it."""
        found = list(map(self.words.get, words))
        if None in found:
            fresh = []
            for i in [i for i, x in enumerate(found) if x is None]:
                if (x := self.older.get(words[i])) is None:
                    fresh.append(i)
                else:
                    found[i] = self.words[words[i]] = x
            if fresh:
                self._learn([words[i] for i in fresh])
            for i in fresh:
                found[i] = self.words[words[i]]
        return found

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array without nulls."""
        apart = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        for token in self.added:
            apart = apart | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        given, texts = texts, pc.if_else(pa.array(apart, pa.bool_()), "", texts)
        pieces = pc.split_pattern(texts, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        parts = pc.extract_regex(coded.dictionary, _PARTS)
        heads = pc.coalesce(pc.struct_field(parts, "letters"), coded.dictionary).dictionary_encode()
        tails = pc.coalesce(pc.struct_field(parts, "tail"), "").dictionary_encode()
        firsts = pieces.flatten().take(pa.array(bounds[:-1])).dictionary_encode()
        words = self._table(heads.dictionary.to_pylist())
        values = words + self.whole(tails.dictionary.to_pylist()) + self.whole(firsts.dictionary.to_pylist())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(self.dtype).itemsize
        starts, store = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), self.dtype)
        # each distinct piece: its letters, then its tail
        two = np.stack([heads.indices.to_numpy().astype(np.int64), tails.indices.to_numpy().astype(np.int64) + len(words)], axis=1).ravel()
        piece_ids = store[_spans(starts[two], sizes[two])]
        piece_sizes = sizes[two].reshape(-1, 2).sum(axis=1)
        # then the first pieces of texts, which no space precedes
        first = slice(len(values) - len(firsts.dictionary), None)
        store = np.concatenate([piece_ids, store[starts[first][0] if len(firsts.dictionary) else 0 :]])
        code[bounds[:-1]] = firsts.indices.to_numpy() + len(piece_sizes)
        sizes = np.concatenate([piece_sizes, sizes[first]])
        own = sizes[code]
        ids = store[_spans((np.cumsum(sizes) - sizes)[code], own)]
        edges = np.append(0, np.cumsum(own))[bounds]
        out = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i in np.flatnonzero(apart):
            out[i] = np.frombuffer(self.whole([given[i].as_py()])[0], self.dtype)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, probes: int, bits: int) -> np.ndarray:
    """One row for each key, one column for each probe."""
    return (hashes[:, :1] + np.arange(probes, dtype=np.uint64) * (hashes[:, 1:] | np.uint64(1))) % np.uint64(bits)


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2)


class Writer:
    """Takes entries in key order; keeps one block, the index and 16 bytes a key in memory."""

    def __init__(self, sink, dtype: str):
        self.sink, self.width = sink, np.dtype(dtype).itemsize
        self.at = self.docs = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes = array("Q")
        self.first = self.last = b""
        self._open()

    def _open(self) -> None:
        self.parts, self.size, self.count, self.restarts = [], 0, 0, []

    def add(self, key: bytes, value: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.count % RESTART:
            shared = len(os.path.commonprefix([self.last, key]))
        else:
            self.restarts.append(self.size)
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.parts.append(entry)
        self.size += len(entry)
        self.count += 1
        self.docs += 1
        self.ids += len(value) // self.width
        self.first, self.last = self.first or key, key
        self.hashes.extend(_hashes(key))
        if self.size >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if not self.count:
            return
        body = b"".join(self.parts) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        body += struct.pack("<I", zlib.crc32(body))
        self.sink.write(body)
        self.index.append((self.last, self.at, len(body)))
        self.at += len(body)
        self._open()

    def finish(self) -> int:
        """Bytes written."""
        self._close()
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        bits = max(64, -(-self.docs * BLOOM_BITS // 8) * 8)
        marks = np.zeros(bits, np.uint8)
        hashes = np.array(self.hashes, np.uint64).reshape(-1, 2)
        for part in (hashes[i : i + (1 << 16)] for i in range(0, len(hashes), 1 << 16)):
            marks[_probes(part, BLOOM_PROBES, bits).ravel().astype(np.int64)] = 1
        bloom = struct.pack("<I", BLOOM_PROBES) + np.packbits(marks, bitorder="little").tobytes()
        footer = FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.docs, self.ids, self.width, len(self.index), 0, MAGIC, 1)
        self.sink.write(index + bloom + footer)
        return self.at + len(index) + len(bloom) + len(footer)


class Reader:
    """Lookup by key and scan of one shard."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        index_at, index_n, bloom_at, bloom_n, self.docs, self.ids, self.width, blocks, _, magic, version = FOOTER.unpack(self._bytes(end - FOOTER.size, FOOTER.size))
        if magic != MAGIC or version != 1:
            raise ValueError("not a shard of this format")
        self.dtype = f"<u{self.width}"
        index, at = self._bytes(index_at, index_n), 0
        self.keys, self.places = [], []
        for _ in range(blocks):
            n = struct.unpack_from("<H", index, at)[0]
            self.keys.append(index[at + 2 : at + 2 + n])
            self.places.append(struct.unpack_from("<QI", index, at + 2 + n))
            at += 14 + n
        bloom = self._bytes(bloom_at, bloom_n)
        self.probes, self.bits = struct.unpack_from("<I", bloom)[0], np.frombuffer(bloom, np.uint8, offset=4)

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, i: int) -> bytes:
        body = self._bytes(*self.places[i])
        if zlib.crc32(body[:-4]) != struct.unpack("<I", body[-4:])[0]:
            raise ValueError("a block is damaged")
        return body[:-4]

    @staticmethod
    def _entries(body: bytes, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        end, key = len(body) - 4 * (1 + struct.unpack("<I", body[-4:])[0]), b""
        while at < end:
            shared, at = _read_varint(body, at)
            unshared, at = _read_varint(body, at)
            n, at = _read_varint(body, at)
            key = key[:shared] + body[at : at + unshared]
            at += unshared
            yield key, body[at : at + n]
            at += n

    def may_have(self, key: bytes) -> bool:
        at = _probes(np.array([_hashes(key)], np.uint64), self.probes, len(self.bits) * 8)[0].astype(np.int64)
        return bool((self.bits[at >> 3] >> (at & 7) & 1).all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this identifier: filter, binary search of the index, binary search of the restarts."""
        from bisect import bisect_left

        key, out = key_of(doc_id), []
        if not self.may_have(key):
            return out
        i = bisect_left(self.keys, key)
        while i < len(self.keys):
            body = self._block(i)
            n = struct.unpack("<I", body[-4:])[0]
            restarts = struct.unpack(f"<{n}I", body[-4 * (n + 1) : -4])
            low = bisect_left(restarts, key, key=lambda at: next(self._entries(body, at))[0])
            for k, v in self._entries(body, restarts[max(0, low - 1)]):
                if k > key:
                    return out
                if k == key:
                    out.append(np.frombuffer(v, self.dtype))
            i += 1
        return out

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.keys)):
            yield from self._entries(self._block(i))


def parts_of(b: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``size`` bytes of text, or of one row."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False)), 0
    while at < len(ends):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield b.slice(at, to - at)
        at = to


def encoded(enc: Encoder, batches: Iterator[pa.RecordBatch], slice_bytes: int = SLICE_BYTES) -> Iterator[tuple[int | None, np.ndarray]]:
    """Identifier and ids of each row; what a batch took goes back to the system before the next."""
    for b in batches:
        for part in parts_of(b, slice_bytes):
            yield from zip(part.column(0).to_pylist(), enc.encode(part.column(1).fill_null("")), strict=True)
        give_back()


MANIFEST = "shard int, path string, docs long, ids long, bytes long, first_key binary, last_key binary"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"
_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_key", pa.binary()), ("last_key", pa.binary())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write ``docs`` as shards below ``out`` and return the manifest, a row for each shard in key order.

    One shuffle by range of (identifier, hash of text). The shard count follows spark.sql.shuffle.partitions and AQE.
    """
    spark = docs.sparkSession

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, name = None, attempt_name("shard", ".sst")
        to, base = open_fs(out)
        enc = encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        for doc_id, ids in encoded(enc, batches, slice_bytes):
            if made is None:
                to.create_dir(base, recursive=True)
                sink = to.open_output_stream(f"{base}/{name}", compression=None)
                made = Writer(sink, enc.dtype)
            made.add(key_of(doc_id), ids.tobytes() + end)
        if made is not None:
            size = made.finish()
            sink.close()
            yield batch(_MANIFEST, [TaskContext.get().partitionId()], [f"{out}/{name}"], [made.docs], [made.ids], [size], [made.first], [made.last])

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("string").alias("t"))
    rows = rows.repartitionByRange("k", F.xxhash64("t")).sortWithinPartitions("k", F.xxhash64("t"))
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{out}/manifest")
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """The shards with ``start``, the number of ids in the shards before each: a window over one row a shard."""
    rows = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    return rows.withColumn("start", F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def read_digests(spark: SparkSession, out: str, shards: int) -> DataFrame:
    """Per stored document its place in the id stream, its number of ids and their CRC-32, a task for each shard."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                where, name = open_fs(path)
                with where.open_input_file(name) as source:
                    reader, rows = Reader(source), []
                    for key, value in reader.scan():
                        ids = np.frombuffer(value, reader.dtype)
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(rows) == 8192:
                            yield batch(_DIGEST, *zip(*rows, strict=True))
                            rows = []
                    if rows:
                        yield batch(_DIGEST, *zip(*rows, strict=True))

    return manifest(spark, out).select("path", "start").repartition(max(1, shards)).mapInArrow(read, DIGEST)


def token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 0, out: str | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write ``docs`` to shards (below the shared folder unless ``out`` is given) and read their digests back."""
    spark = docs.sparkSession
    out = out or fresh_dir(spark, "sst")
    write_shards(docs, out, tokenizer_path, end_id, slice_bytes=slice_bytes)
    return read_digests(spark, out, spark.read.parquet(f"{out}/manifest").count())
