import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import database, difference
from llm_rows import odd_rows

from gaugeflow.llm import divergence, queries

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, most, smoothing=5):
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = Counter(TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)})))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    share = lambda c, n, v: 1 + 10**9 * (c + smoothing) // (n + smoothing * v)
    p, whole = {}, defaultdict(Counter)
    for (lang, source), c in groups.items():
        own = {t: c[t] for t in kept[lang]}
        whole[lang].update(own)
        p[lang, source] = {t: share(x, sum(own.values()), len(own)) for t, x in own.items()}
    out = []
    for lang, source in groups:
        mine = p[lang, source]
        n = sum(whole[lang].values())
        q = {t: share(whole[lang][t], n, len(mine)) for t in mine}
        pairs = [(-sum(abs(mine[t] - p[lang, o][t]) for t in mine), o) for la, o in groups if la == lang and o != source]
        best = [(-(mine[t] - q[t]), t) for t in mine if groups[lang, source][t] and mine[t] > q[t]]
        for part, rows_ in (("pair", sorted(pairs)), ("term", sorted(best)[:most])):
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(rows_)]
    return sorted(out)


def test_statement(spark, data):
    assert difference(spark, database(data), queries.QUERIES["op13_divergence"], queries.SQL["op13_divergence"], data) is None


@pytest.mark.parametrize("bits, cell, strip", [(64, 1 << 20, 1024), (3, 40, 2), (12, 7, 1)])
def test_odd_rows_and_colliding_digests(spark, odd, bits, cell, strip, monkeypatch):
    """With digests of 3 bits nearly every one stands for several terms."""
    monkeypatch.setattr(divergence, "CELL_ENTRIES", cell)
    monkeypatch.setattr(divergence, "STRIP", strip)
    rows = odd_rows()
    for least, most in ((2, 5), (1, 50), (1000, 50)):
        told = divergence.audit(odd, least_docs=least, most=most, digest_bits=bits)
        assert told.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in told.collect()) == plain(rows, least, most)


def test_tasks_that_give_up_rows_early(spark, odd, monkeypatch):
    monkeypatch.setattr(divergence, "FLUSH_ROWS", 10)
    told = divergence.audit(odd.coalesce(1), least_docs=2)
    assert sorted(tuple(r) for r in told.collect()) == plain(odd_rows(), 2, 50)


def test_empty(spark, nothing):
    assert divergence.audit(nothing).count() == 0


def test_shares_are_exact_beyond_64_bits():
    rng = np.random.default_rng(1)
    count, total = rng.integers(0, 2**50, 1000), rng.integers(2**50, 2**52, 1000)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist())]
