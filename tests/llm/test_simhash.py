import random

import numpy as np
import pytest
import xxhash

from docstruct.llm import simhash
from docstruct.llm.registry import op3_simhash
from tests.conftest import SMALL


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, radius=4):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    p = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= radius):
            parent[root(int(j))] = root(i)
    least = {}
    for i, d in enumerate(ids):
        r = root(i)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints():
    for t in ("", "A b", "a b c d", "A B c d e f g h", "é ß\x0b x y\t" * 50, "w " * 70_000):
        assert simhash.fingerprint(t.encode()) == plain_print(t)


def near(base, rng, flips):
    for b in rng.sample(range(64), flips):
        base ^= 1 << b
    return base


@pytest.mark.parametrize("bin_rows", [20_000, 40])
def test_links_find_every_component(spark, bin_rows):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(1500)}
    dense = rng.getrandbits(64)
    prints |= {near(dense, rng, rng.randint(1, 4)) for _ in range(300)} | {near(p, rng, rng.randint(1, 6)) for p in list(prints)[:400]}
    chain = rng.getrandbits(64)
    for _ in range(12):  # linked end to end, the ends far apart
        prints.add(chain)
        chain = near(chain, rng, 4)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.link_prints(spark.createDataFrame([(p,) for p in signed], "fp long"), bin_rows=bin_rows)
    got = {r.fp: r.label for r in simhash.components(links).collect()}
    want = plain_components(signed, [p % (1 << 64) for p in signed])
    assert [got.get(p, p) for p in signed] == want
    assert links.count() < 15 * len(prints)


@pytest.mark.parametrize("agree", [3, 4])
def test_more_blocks_meet_every_pair(spark, agree):
    rng = random.Random(agree)
    pairs = [(p, near(p, rng, 4)) for p in (rng.getrandbits(64) for _ in range(50))]
    sign = lambda p: p - (1 << 64) if p >> 63 else p
    rows = simhash.bins(spark.createDataFrame([(sign(p),) for pair in pairs for p in pair], "fp long"), agree=agree).collect()
    by = {}
    for r in rows:
        by.setdefault(r.fp, set()).add(r.bin)
    assert all(by[sign(a)] & by[sign(b)] for a, b in pairs)


def test_cases(spark):
    data = [(4, None), (9, ""), (2, "a b"), (3, "A  b"), (None, "a b"), (None, "only null here now"), (8, "x " * 100_000), (8, "x " * 100_000), (1, "unlike all the others in words")]
    out = simhash.near_duplicates(spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, fp int"))
    want = plain_components([d for d, _ in data], [plain_print(t) for _, t in data])
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()))) == sorted(map(str, ((d, f"{plain_print(t):016x}", c) for (d, t), c in zip(data, want, strict=True))))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    for shingle in (None, 5):
        kept = simhash.deduplicate(spark.createDataFrame([(*r, 0) for r in data], "doc_id long, text string, fp int"), shingle=shingle)
        assert kept.columns == ["doc_id", "text", "fp"] and sorted(str((r.doc_id, (r.text or "")[:9])) for r in kept.collect()) == sorted(map(str, [(4, ""), (2, "a b"), (None, "only null"), (8, "x x x x x"), (1, "unlike al")]))
        assert simhash.deduplicate(empty, shingle=shingle).count() == 0


@pytest.mark.parametrize("shingle", [None, 5])
def test_one_row_of_each_component(spark, shingle):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    schema = "stays string, doc_id long, label int, text string"
    keep = lambda rows: sorted(((r.doc_id, r.text, r.stays) for r in simhash.deduplicate(spark.createDataFrame(rows, schema), shingle=shingle).collect()), key=str)
    assert keep([("s", 1, 0, a)] * 5) == [(1, a, "s")]
    assert keep([("s", 3, 0, a), ("s", 5, 0, a), ("s", 5, 0, b)]) == [(3, a, "s"), (5, b, "s")]
    assert keep([("s", 5, 0, a), ("s", 5, 0, b), ("s", 5, 0, c)]) == [(5, a, "s"), (5, b, "s"), (5, c, "s")]
    assert keep([("s", None, 0, a), ("s", None, 0, a), ("s", None, 0, b)]) == sorted([(None, a, "s"), (None, b, "s")], key=str)
    once = keep([("s", 1, 0, a), ("t", 1, 1, a), ("u", 1, 2, a), ("s", 9, 0, a)])
    assert len(once) == 1 and once[0][:2] == (1, a) and once == keep([("s", 9, 0, a), ("u", 1, 2, a), ("t", 1, 1, a), ("s", 1, 0, a)])


def test_near_copies_of_similarity_0_8_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    docs, go = [], set()
    for k in range(60):
        words = [word() for _ in range(200)]
        docs.append((2 * k, words))
        changed = list(words)
        for at in rng.sample(range(200), 1 + k % 8):
            changed[at] = word()
        a, b = shingles(words), shingles(changed)
        docs.append((2 * k + 1, changed))
        if len(a & b) >= 0.8 * len(a | b):
            go.add(2 * k + 1)
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string"), shingle=5).collect()}
    assert not kept & go and kept >= {2 * k for k in range(60)} and len(go) > 20


def plain_similar(texts, n=5, least=0.8):
    """The smallest index that similarity of shingle sets reaches, for each text."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    label = list(range(len(texts)))
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in enumerate(sets):
        others = {j for x in s for j in at[x]} if s else {j for j, t in enumerate(sets) if not t}
        for j in others:
            if j < i and len(s & sets[j]) >= least * len(s | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(texts))]


@pytest.mark.parametrize("bin_rows", [20_000, 15])
def test_similar_groups_against_brute_force(spark, bin_rows):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts, shared = [], [word() for _ in range(90)]
    for k in range(40):
        base = [word() for _ in range(rng.choice([12, 60, 150]))] if k % 4 else shared + [word() for _ in range(rng.choice([30, 60, 90]))]  # the latter alike, but not to 0.8
        for _ in range(rng.randint(1, 8)):
            texts.append(" ".join(base))
            base = list(base)  # chains: each a little off the one before it
            for at in rng.sample(range(len(base)), rng.randint(0, max(1, len(base) // 40))):
                base[at] = word()
    rng.shuffle(texts)
    label = plain_similar(texts)
    kept = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shingle=5, bin_rows=bin_rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


def test_similar_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    label = plain_similar([t for _, t in rows])
    kept = simhash.deduplicate(docs, shingle=5)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({rows[i][0] for i in label}) and kept.schema == docs.schema


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_print(d.text) for d in docs]
    want = sorted(zip([d.doc_id for d in docs], [f"{p:016x}" for p in prints], plain_components([d.doc_id for d in docs], prints), strict=True))
    assert sorted(tuple(r) for r in op3_simhash(spark, SMALL).collect()) == want
    kept = simhash.deduplicate(spark.read.parquet(f"{SMALL}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
