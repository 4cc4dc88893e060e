import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from gaugeflow.llm import simhash
from llm_rows import frame, odd_rows


def code_of(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(codes, most):
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= most:
            parent[find(j)] = find(i)
    return [find(i) for i in range(len(codes))]


def test_fingerprints_and_components(odd):
    rows = odd_rows()
    codes = [code_of(t) for _, t, *_ in rows]
    group = groups(codes, 2)
    least = {g: min((k for (k, *_), h in zip(rows, group) if h == g and k is not None), default=None) for g in group}
    told = simhash.near_duplicates(odd, carry=("doc_id",)).collect()
    key = lambda x: (str(x[0]), x[1], str(x[2]))
    got = sorted(((r.row.doc_id, r.code % 2**64, r.component) for r in told), key=key)
    assert got == sorted(((k, c, least[g]) for (k, *_), c, g in zip(rows, codes, group)), key=key)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_links_of_close_codes(spark, most):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(20)]
    codes = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for c in centres for _ in range(40)} | {0, 1, 2**63})
    signed = [c - 2**64 if c >> 63 else c for c in codes]
    edges = simhash.links(spark.createDataFrame([(c,) for c in signed], "code long"), max_bits=most)
    roots = dict(simhash.components(edges).collect())
    got, want = {}, {}
    for i, (c, g) in enumerate(zip(signed, groups(codes, most))):
        got.setdefault(roots.get(c, c), []).append(i)
        want.setdefault(g, []).append(i)
    assert sorted(got.values()) == sorted(want.values())


def test_index_prunes_nothing_that_is_near():
    rng = np.random.default_rng(2)
    codes = np.unique(rng.integers(0, 2**12, 900, dtype=np.uint64))
    i, j = simhash.GrayIndex(codes).within(0, len(codes), 2)
    want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if int(codes[a] ^ codes[b]).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_ties_of_earlier_batches_hold(monkeypatch):
    """Pairs of one bucket that come batch by batch: 5-700 links two groups that a later batch lowers apart."""
    pairs = {0: [(2, 1100), (3, 1200), (5, 600), (5, 700)], 512: [(600, 1100), (700, 1200)]}
    monkeypatch.setattr(simhash.GrayIndex, "within", lambda self, first, last, most: tuple(np.array(pairs.get(first, []), np.int64).reshape(-1, 2).T))
    label = simhash._components(np.arange(1300, dtype=np.uint64), 2)
    assert {n: int(x) for n, x in enumerate(label) if n != x} == dict.fromkeys([3, 5, 600, 700, 1100, 1200], 2)


@pytest.mark.parametrize("most,seed", [(1, 0), (2, 0), (2, 1), (2, 2), (3, 0)])
def test_components_of_one_bucket_with_some_thousand_codes(most, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 2**32, 1000, dtype=np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 32, (most, 5, 1000), dtype=np.uint64), axis=0)
    codes = np.unique(np.concatenate([centres, *(centres ^ f for f in flips), rng.integers(0, 2**17, 1500, dtype=np.uint64) << np.uint64(8)]))
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    codes = codes[np.argsort(rank)]
    parent = list(range(len(codes)))

    def find(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i in range(len(codes)):
        for j in np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= most) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    assert len(codes) > 5 * simhash.QUERIES_AT_ONCE
    assert simhash._components(codes, most).tolist() == [find(i) for i in range(len(codes))]


def test_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_columns_and_empty(spark, odd, nothing):
    told = simhash.near_duplicates(odd)
    assert told.columns == ["row", "code", "root", "component"] and told.schema["row"].dataType.names == odd.columns
    assert simhash.near_duplicates(nothing).count() == 0
