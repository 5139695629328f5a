"""SimHash near-duplicates through pivot distance tables.

A text's fingerprint has 64 bits: bit b is 1 if it is set in over half the XXH64 (seed 42) of its 4-word shingles, repeats
included. Two fingerprints link when they differ in at most ``radius`` bits; a component is what links reach.

Pairs are found without comparing all. Equal fingerprints are first made one row. Each distinct fingerprint then goes to
``C(radius + 2, 2)`` bins, one for each pair of the ``radius + 2`` bit blocks: two fingerprints with at most ``radius``
different bits agree on two blocks at least, so every link is met in some bin. (Beyond 30 million fingerprints three of
``radius + 3`` blocks make a bin, beyond two thousand million four of ``radius + 4``: more and smaller bins, the same
links.) In a bin, a pivot distance table holds each
member's Hamming distances to many fixed reference fingerprints. By the triangle inequality a pair whose distances to one
reference differ by more than ``radius`` can't link; sorting by the first reference leaves a window, the maximum
difference over the rest discards within it, and survivors are verified on the fingerprints. A bin walks its components
breadth first and gives each member its component's smallest fingerprint: a star of links, not all pairs. A bin above
``bin_rows`` is dealt out: its rows go to chunks by hash and each pair of chunks is a task's work of its own, so no task
holds more than two chunks and no pair is left out. Components over all bins come from alternating star contractions.

Documents whose sets of five-word shingles are alike to 0.8 differ in some ten bits, too many for bit blocks. For these
(``deduplicate`` with ``shingle``) the bins are min-hash bands instead, of texts of equal shingle sets one row: 32 bands of 7
rows, so that a pair of similarity 0.8 shares one with probability 0.9995, and a more similar one all the surer. A bin's
center is the member that meets most others over all its bins, which is what the copies of a text have in common. Each
text is held against the best of its centers first; then, in bins that still hold more than one component, members of
different components are held against each other where they stand, each pair in the first bin that it shares. Pairs
within a component are never made, and none leaves its task but a link. The pivot tables discard with the radius ``WIDE``,
and what survives is verified by its exact similarity. In a bin of many texts that share the band but are not alike to
0.8 all pairs are held against each other: n rows in a bin cost n * n / 2 comparisons, dealt out by chunks of ``FAR_ROWS``.

Cases: null and empty texts have the fingerprint 0 and link like any other; texts of fewer than four words have one
shingle, their whole sequence; repeated rows and ties share a fingerprint; a null identifier is no smallest identifier, and
a component of none but nulls has a null ``component_id``; an empty table gives no rows; other columns are not read. A very
long text is hashed whole, its bits counted a part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstruct.llm.common import arrow_map, batch, cut, release, set_aside, texts

SHINGLE, SEED, RADIUS, PIVOTS, BIN_ROWS = 4, 42, 4, 32, 20_000
#: Min-hash bands of similar texts, and the bits in which fingerprints of their sets may differ: at similarity 0.8 these
#: differ in 9.7 bits with a deviation of 2.9.
BANDS, BAND_ROWS, WIDE = 32, 7, 24
#: Members of a bin that a chunk holds, a member of more than ``FAR_BYTES`` of shingle hashes counting as several.
FAR_ROWS, FAR_BYTES = 2_000, 8_192
#: Keys of so many rows, some 40 bytes each, may be sent to every task; with more the texts are shuffled to them.
BROADCAST_ROWS = 500_000
#: Shingles whose bits are counted at once; bounds memory for very long texts.
_AT_ONCE = 1 << 16
_PRINT = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("mark", pa.binary())])
_SET = pa.schema([("doc_id", pa.int64()), ("mark", pa.binary()), ("set", pa.binary()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SHOWN = pa.schema([("set", pa.binary()), ("h", pa.binary())])
_PAIR = pa.schema([("a", pa.binary()), ("b", pa.binary())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


#: ASCII white space and capitals become spaces and small letters.
_PLAIN = bytes(32 if c in b"\t\n\x0b\f\r" else c for c in range(256)).lower()


def shingle_hashes(text: bytes, n: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of each ``n``-word shingle of the text in lower case (A-Z alone). Holds no object a word, however long the text."""
    line = text.translate(_PLAIN).strip(b" ")
    if not line:
        return np.zeros(0, np.uint64)
    while b"  " in line:
        line = line.replace(b"  ", b" ")
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    if len(gaps) < n:
        return np.array([xxhash.xxh64_intdigest(line, seed)], np.uint64)
    starts, ends = np.append(0, gaps + 1)[: len(gaps) + 2 - n], np.append(gaps, len(line))[n - 1 :]
    out, hashed = np.empty(len(starts), np.uint64), xxhash.xxh64_intdigest
    for i in range(0, len(out), _AT_ONCE):
        a, b = starts[i : i + _AT_ONCE].tolist(), ends[i : i + _AT_ONCE].tolist()
        out[i : i + _AT_ONCE] = np.fromiter((hashed(line[x:y], seed) for x, y in zip(a, b, strict=True)), np.uint64, len(a))
    return out


def majority(hashes: np.ndarray) -> int:
    """Unsigned: the bits that over half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _AT_ONCE):
        part = hashes[i : i + _AT_ONCE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes) -> int:
    return majority(shingle_hashes(text))


def mark(text: Column) -> Column:
    """What tells texts apart: 128 bits."""
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp, mark``: the fingerprint as a signed long, and the text's mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(t) for t in texts(b.column(1))], np.uint64).astype(np.int64)
            yield batch(_PRINT, b.column(0), prints, b.column(2))

    return arrow_map(docs, run, "doc_id long, fp long, mark binary", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark(F.col(text_col)).alias("mark"))


def references(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, spread by hashing."""
    return np.array([xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 2024) for i in range(n)], np.uint64)


def pivot_table(prints: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances, a row for each pivot."""
    return np.stack([np.bitwise_count(prints ^ p) for p in pivots]).astype(np.int8)


def bin_components(prints: np.ndarray, radius: int, pivots: np.ndarray) -> np.ndarray:
    """For each fingerprint of a bin the index of the smallest one that links reach within the bin."""
    n = len(prints)
    table = pivot_table(prints, pivots)
    order = np.argsort(table[0], kind="stable")
    prints, table = prints[order], table[:, order]
    left = np.ones(n, bool)
    label = np.arange(n)
    for i in range(n):
        if not left[i]:
            continue
        left[i], queue, members = False, [i], [i]
        while queue:
            j = queue.pop()
            lo, hi = np.searchsorted(table[0], [table[0][j] - radius, table[0][j] + radius + 1])
            near = np.flatnonzero(left[lo:hi]) + lo
            for row in table[1:]:
                if not len(near):
                    break
                near = near[np.abs(row[near] - row[j]) <= radius]
            if len(near):
                near = near[np.bitwise_count(prints[near] ^ prints[j]) <= radius]
            left[near] = False
            queue += near.tolist()
            members += near.tolist()
        label[members] = min(members, key=lambda k: prints[k])
    out = np.empty(n, np.int64)
    out[order] = order[label]
    return out


def _small_bins(keys: np.ndarray, prints: np.ndarray, radius: int, pivots: np.ndarray, most: int = 48) -> tuple[list, np.ndarray]:
    """Links of the sorted bins with few members, all bins at once, and the starts and ends of the larger ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    big = sizes > most
    size_of = np.repeat(sizes, sizes)
    rows = np.flatnonzero((size_of > 1) & (size_of <= most))
    found = []
    if len(rows):
        k, p = keys[rows], prints[rows]
        table = pivot_table(p, pivots)
        for step in range(1, int(size_of[rows].max())):
            same = np.flatnonzero(k[step:] == k[:-step])
            for row in table:
                same = same[np.abs(row[same + step] - row[same]) <= radius]
            same = same[np.bitwise_count(p[same + step] ^ p[same]) <= radius]
            if len(same):
                found.append(np.stack([p[same], p[same + step]]))
    return found, np.stack([starts[big], starts[big] + sizes[big]], axis=1)


def bin_links(batches: Iterator[pa.RecordBatch], radius: int = RADIUS, n_pivots: int = PIVOTS) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by bin: columns ``bin, fp``. Keeps the batch and the bin that is not yet at its end."""
    pivots = references(n_pivots)

    def links(keys: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, big = _small_bins(keys, prints, radius, pivots)
        for lo, hi in big:
            own = np.unique(prints[lo:hi])
            label = bin_components(own, radius, pivots)
            far = np.flatnonzero(label != np.arange(len(own)))
            found.append(np.stack([own[far], own[label[far]]]))
        if found:
            a, b = np.concatenate(found, axis=1).view(np.int64)
            if len(a):
                yield batch(_LINK, a, b)

    rest_k, rest_p = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for b in batches:
        k = np.concatenate([rest_k, b.column(0).to_numpy(zero_copy_only=False)])
        p = np.concatenate([rest_p, b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        end = int(np.searchsorted(k, k[-1]))
        if end:
            yield from links(k[:end], p[:end])
        rest_k, rest_p = k[end:], p[end:]
    if len(rest_k):
        yield from links(rest_k, rest_p)


def bins(prints: DataFrame, radius: int = RADIUS, agree: int = 2) -> DataFrame:
    """``bin, fp`` for each ``agree`` of ``radius + agree`` bit blocks; the bin is the hash of their choice and their bits."""
    blocks = radius + agree
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(sum(own))).cast("long"))) for i, own in enumerate(combinations(masks, agree))]
    return prints.select("fp", F.explode(F.array(*keys)).alias("bin")).select("bin", "fp")


def link_prints(prints: DataFrame, radius: int = RADIUS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``a, b``: links that span the components of the distinct fingerprints in ``fp``."""
    spark = prints.sparkSession
    n = prints.count()
    rows = bins(prints, radius, 2 + (n > 30_000_000) + (n > 2_000_000_000))
    rows = dealt(rows, rows.groupBy("bin").count(), bin_rows, F.col("fp"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(lambda it: bin_links(it, radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``fp, label`` for every end of a link but the smallest of its component, which is the label.

    Alternating star contractions: in the large step each node's larger neighbours, in the small step its smaller ones
    and itself, move to its smallest neighbour. Rounds grow with the logarithm of a component's width, none are needed for
    stars, and each is cut to the shared folder. Smallest neighbours come from a partial aggregate, so a node with many links is no group in one task.
    """

    def star(edges: DataFrame) -> DataFrame:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return large.distinct()

    def small(edges: DataFrame) -> DataFrame:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        to = edges.join(least, "a")
        moved = to.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.union(least.select("a", F.col("m").alias("b"))).distinct()

    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        edges, done = cut(small(star(edges))), edges
        release(done)
    return edges.select(F.col("a").alias("fp"), F.col("b").alias("label"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one smaller end, which is none's larger end."""
    own = edges.where("a <> b")
    if own.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).where("lo <> hi").head() is not None:
        return False
    return own.join(own.select(F.col("a").alias("b")), "b", "left_semi").head() is None


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """``BANDS`` hashes of ``BAND_ROWS`` min-hashes each, of a text's distinct shingle hashes."""
    factor = references(2 * BANDS * BAND_ROWS)
    times, plus = factor[: BANDS * BAND_ROWS] | np.uint64(1), factor[BANDS * BAND_ROWS :]
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 11):
        low = np.minimum(low, (hashes[i : i + (1 << 11), None] * times + plus).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(low[k : k + BAND_ROWS].tobytes(), k) for k in range(0, len(low), BAND_ROWS)], np.uint64).view(np.int64)


def shingle_sets(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, mark, set, fp, keys``: the mark of the text, that of its set of ``n``-word shingles, the set's fingerprint and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [np.unique(shingle_hashes(t, n)) for t in texts(b.column(1))]
            prints = np.array([majority(h) for h in held], np.uint64).view(np.int64)
            yield batch(_SET, b.column(0), b.column(2), [xxhash.xxh3_128_digest(h.tobytes()) for h in held], prints, [band_keys(h) if len(h) else [] for h in held])

    return arrow_map(docs, run, "doc_id long, mark binary, set binary, fp long, keys array<long>", F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark(F.col(text_col)).alias("mark"))


def sent(keys: DataFrame) -> DataFrame:
    """A written table of row keys, to be broadcast if it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def set_hashes(needed: DataFrame, sets: DataFrame, docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``set, h`` of the sets in ``needed``: their shingles' hashes, sorted, from one row of ``docs`` each. Written."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(_SHOWN, b.column(0), [np.unique(shingle_hashes(t, n)).tobytes() for t in texts(b.column(1))])

    keys = cut(sets.join(needed.select("set").distinct(), "set").select("set", F.col("rep.doc_id").alias("i"), F.col("rep.mark").alias("m")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), mark(F.col(text_col)).alias("mark"), F.col(text_col).cast("string").alias("text"))
    found = rows.join(sent(keys), rows["doc_id"].eqNullSafe(F.col("i")) & (rows["mark"] == F.col("m"))).select("set", "text")
    return cut(arrow_map(found, hashes, "set binary, h binary", "set", "text").dropDuplicates(["set"]))


def alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of ``least`` or more."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= least * (len(x) + len(y) - both)


def verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The ``a, b`` of which the sets are alike; ``held`` as of :func:`set_hashes`. Written."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [(a.as_py(), z.as_py()) for a, z, x, y in zip(*b.columns, strict=True) if alike(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), least)]
            if kept:
                yield batch(_PAIR, *zip(*kept, strict=True))

    rows = pairs.join(held.toDF("a", "x"), "a").join(held.toDF("b", "y"), "b")
    return cut(arrow_map(rows, confirm, "a binary, b binary", "a", "b", "x", "y"))


def far_links(batches: Iterator[pa.RecordBatch], least: float, radius: int = WIDE, n_pivots: int = PIVOTS) -> Iterator[pa.RecordBatch]:
    """Links of different components, from rows sorted by bin: ``bin, band, set, fp, label, keys, h``.

    ``band`` is the bin before it was dealt out; a pair is looked at only where it is the first of ``keys`` that both have.
    Members that a link joins are one component from then on. Keeps the batch and the bin that is not yet at its end.
    """
    pivots = references(n_pivots)

    def links(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys = b.column(0).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            prints = b.column(3).slice(lo, hi - lo).to_numpy(zero_copy_only=False).view(np.uint64)
            order = np.argsort(pivot_table(prints, pivots[:1])[0], kind="stable")
            own = b.slice(lo, hi - lo).take(pa.array(order))
            prints, table = prints[order], pivot_table(prints[order], pivots)
            names, label = own.column(2).to_pylist(), own.column(4).to_numpy(zero_copy_only=False).copy()
            bands = own.column(5).combine_chunks().flatten() if isinstance(own.column(5), pa.ChunkedArray) else own.column(5).flatten()
            bands = bands.to_numpy(zero_copy_only=False).reshape(len(names), -1)
            band, kept = own.column(1)[0].as_py(), []
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in own.column(6)]
            for k in range(len(names) - 1):
                near = np.arange(k + 1, int(np.searchsorted(table[0], table[0][k] + radius, side="right")))
                near = near[label[near] != label[k]]
                for row in table[1:]:
                    if not len(near):
                        break
                    near = near[np.abs(row[near] - row[k]) <= radius]
                near = near[np.bitwise_count(prints[near] ^ prints[k]) <= radius]
                if not len(near):
                    continue
                near = near[bands[k][(bands[near] == bands[k]).argmax(axis=1)] == band]
                for j in near.tolist():
                    if label[j] != label[k] and alike(sets[k], sets[j], least):
                        kept.append((names[k], names[j]))
                        label[label == label[j]] = label[k]
            if kept:
                yield batch(_PAIR, *zip(*kept, strict=True))

    rest: pa.RecordBatch | None = None
    for b in batches:
        if not b.num_rows:
            continue
        if rest is not None:
            b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
        keys = b.column(0).to_numpy(zero_copy_only=False)
        end = int(np.searchsorted(keys, keys[-1]))
        if end:
            yield from links(b.slice(0, end))
        rest = b.slice(end)
    if rest is not None:
        yield from links(rest)


def dealt(rows: DataFrame, sizes: DataFrame, bin_rows: int, member: Column) -> DataFrame:
    """``rows`` with those of the bins of over ``bin_rows`` rows copied to a bin for each pair of chunks; ``sizes`` has ``bin, count``."""
    full = cut(sizes.where(F.col("count") > bin_rows).select("bin", "count"))
    if full.head() is None:
        return rows
    chunks = F.ceil(F.col("count") / bin_rows).cast("int")
    own = F.pmod(F.xxhash64(member, F.lit(1)), chunks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), chunks - 1), lambda c: F.xxhash64(F.col("bin"), F.least(c, own), F.greatest(c, own)))
    others = [F.col(c) for c in rows.columns if c != "bin"]
    return rows.join(full, "bin", "left").select(F.explode(F.when(F.col("count").isNull(), F.array("bin")).otherwise(pairs)).alias("bin"), *others)


def similar_labels(docs: DataFrame, rows: DataFrame, n: int, least: float, bin_rows: int = FAR_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``name, label`` of the sets that similarity links to others; ``rows`` as of :func:`shingle_sets`."""
    sets = cut(rows.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "mark")).alias("rep"), F.min("fp").alias("fp"), F.min("keys").alias("keys")))
    every = sets.select("set", "fp", F.explode("keys").alias("bin"))
    met = cut(every.groupBy("bin").count().where("count > 1"))
    some = cut(every.join(met, "bin"))
    meets = some.groupBy("set").agg(F.sum("count").alias("meets"))
    # a bin's center is the member of most meetings, the smallest of equals
    centers = cut(some.join(cut(meets), "set").groupBy("bin").agg(F.min(F.struct((-F.col("meets")).alias("m"), "set", "fp")).alias("c")))
    stars = some.join(centers, "bin").where((F.col("set") != F.col("c.set")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= WIDE))
    stars = cut(stars.groupBy("set").agg(F.min(F.struct("c.m", "c.set")).alias("c")).select(F.col("set").alias("a"), F.col("c.set").alias("b")))
    held = set_hashes(stars.select(F.col("a").alias("set")).union(stars.select("b")), sets, docs, n, id_col, text_col)
    links = verified(stars, held, least)
    labels = cut(components(links))
    # bins of more than one component, and what their members need
    named = cut(some.select("bin", "set", "fp").join(labels.toDF("set", "label"), "set", "left").withColumn("label", F.coalesce("label", "set")))
    release(some)
    mixed = cut(named.groupBy("bin").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bin"))
    open_ = cut(named.join(mixed, "bin").select("bin", F.col("bin").alias("band"), "set", "fp", F.xxhash64("label").alias("label")))
    release(named)
    if open_.head() is None:
        return labels
    own = set_hashes(open_, sets, docs, n, id_col, text_col)
    size = F.greatest(F.lit(1), F.ceil(F.octet_length("h") / FAR_BYTES))
    sizes = open_.select("bin", "set").join(own.select("set", size.alias("size")), "set").groupBy("bin").agg(F.sum("size").alias("count"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ready = dealt(open_, sizes, bin_rows, F.col("set")).join(sets.select("set", "keys"), "set").join(own, "set").select("bin", "band", "set", "fp", "label", "keys", "h")
    more = cut(ready.repartition(parts, "bin").sortWithinPartitions("bin").mapInArrow(lambda it: far_links(it, least), "a binary, b binary"))
    release(open_)
    return cut(components(links.union(more))) if more.head() is not None else labels


def print_labels(prints: DataFrame, radius: int, bin_rows: int) -> DataFrame:
    """``fp, label`` of each distinct fingerprint in ``fp``, its own where nothing links."""
    labels = cut(components(link_prints(prints.select("fp"), radius, bin_rows)))
    return prints.join(labels.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bin_rows: int = BIN_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    rows = cut(fingerprints(docs).drop("mark"))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    named = cut(print_labels(prints, radius, bin_rows))
    whole = cut(named.groupBy("label").agg(F.min("least").alias("component_id")))
    named = cut(named.select("fp", "label").join(whole, "label").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, bin_rows: int = BIN_ROWS, shingle: int | None = None, jaccard: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of each component, columns unchanged: that of the smallest identifier, nulls last, then of the smallest text's hash.

    Texts link whose fingerprints differ in ``radius`` bits or fewer, or, with ``shingle``, whose sets of that many words have a
    Jaccard similarity of ``jaccard`` or more. Of rows that repeat identifier and text one stays, that of the smallest
    hash of all its columns.
    """
    if shingle is None:
        rows = cut(fingerprints(docs, id_col, text_col).withColumnRenamed("fp", "name"))
        labels = cut(print_labels(cut(rows.select(F.col("name").alias("fp")).distinct()), radius, bin_rows).toDF("name", "label"))
    else:
        sets = cut(shingle_sets(docs, shingle, id_col, text_col))
        labels = similar_labels(docs, sets, shingle, jaccard, min(bin_rows, FAR_ROWS), id_col, text_col)
        labels, rows = labels.toDF("name", "label"), sets.select("doc_id", "mark", F.col("set").alias("name"))
    # a row for each text under each identifier, and the first of each component
    own = rows.groupBy("name", "doc_id", "mark").agg(F.count("*").alias("n")).join(labels, "name", "left").select("doc_id", "mark", "n", F.coalesce("label", "name").alias("label"))
    own = cut(own)
    first = cut(own.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "mark")).alias("f")))
    told = own.join(first, "label").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("mark") == F.col("f.mark")))
    told = cut(told.where("not stays or n > 1").select(F.col("doc_id").alias("_docstruct_id"), F.col("mark").alias("_docstruct_mark"), "stays"))
    aside, names = set_aside(docs)
    key_id, key_text = (F.col(names[docs.columns.index(c)]) for c in (id_col, text_col))
    same = key_id.cast("long").eqNullSafe(F.col("_docstruct_id")) & (mark(key_text) == F.col("_docstruct_mark"))
    kept = aside.join(sent(told.drop("stays")), same, "left_anti")
    repeated = told.where("stays").drop("stays")
    if repeated.head() is not None:
        again = aside.join(sent(repeated), same).groupBy("_docstruct_id", "_docstruct_mark").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("r"))
        kept = kept.union(again.select("r.*"))
    return kept.toDF(*docs.columns)
