import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import database, difference
from llm_rows import odd_rows

from gaugeflow.llm import lexical, queries, terms

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lowered(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def plain(rows, items, k):
    docs = [(i, Counter(TERM.findall(lowered(t)))) for i, t in rows if t]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in sorted(set((i, t) for i, t in items if t), key=str):
        scored = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(TERM.findall(lowered(text))) if c[t])
            if score > 0:
                scored.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_statement(spark, data):
    assert difference(spark, database(data), queries.QUERIES["op11_lexical_search"], queries.SQL["op11_lexical_search"], data) is None


ITEMS = [(1, "Alpha beta, beta! é"), (1, "gamma"), (2, "tau SIGMA 日本語 x9"), (2, "tau SIGMA 日本語 x9"), (3, None), (4, ""), (5, "nowhere"), (None, "kappa lambda"), (6, " ".join(f"w{i}" for i in range(300)) + " mu nu")]


@pytest.mark.parametrize("group_bytes, k", [(1 << 20, 50), (40, 3)])
def test_against_all_pairs(spark, odd, group_bytes, k, monkeypatch):
    monkeypatch.setattr(lexical, "TERM_TILE", 3 if k == 3 else lexical.TERM_TILE)
    monkeypatch.setattr(lexical, "ITEM_TILE", 2)
    items = spark.createDataFrame([(i, t, "x", "x") for i, t in ITEMS], "item_id long, text string, score string, item string")
    told = lexical.search(odd, items, k=k, group_bytes=group_bytes).collect()
    assert sorted((tuple(r) for r in told), key=str) == plain([r[:2] for r in odd_rows()], ITEMS, k)


def test_empty_tables(spark, odd, nothing):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(nothing, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0
    assert lexical.search(odd, items.where("item_id = 4")).count() == 0


def test_sums_of_a_tile_stay_below_2_to_53():
    term = np.arange(50_000)
    weight = np.full(50_000, 10_000_000)
    tile = lexical.Tile(np.array([0]), np.zeros(50_000, np.int64), term, weight)
    assert tile.width * 10_000_000 * lexical.MOST_IMPACT < 2**53
    assert tile.scores(np.zeros(50_000, np.int64), term, np.full(50_000, 999_999), 1)[0, 0] == 50_000 * 10_000_000 * 999_999


def test_ties_at_the_last_place_go_to_the_smallest_ids():
    best = lexical.Best(1, 2)
    for ids in ([9, 8], [7, 3], [5, 1]):
        best.add(np.array([0]), np.array([[4], [4]]), np.array(ids), np.zeros(2, bool))
        best.cut()
    assert best.cut()[2].tolist() == [1, 3]


def test_long_texts_are_cut_between_terms():
    rng = random.Random(3)
    text = "".join(rng.choice("abÀ é1 .X") for _ in range(5000)) + "z" * 700
    want = TERM.findall(lowered(text))
    for most in (64, 1000, 1 << 20):
        found = [w.decode() for words, _ in terms.pieces(pa.array(["", text, None]), terms.WORD_CHARACTERS, most) for w in words.to_pylist()[0::2]]
        assert found == want


def test_lengths_do_not_overflow():
    assert lexical._lengths(np.array([10**9]), 10**15, 10**12).tolist() == [50 + 50 * 10**9 * 10**12 // 10**15]
