import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gaugeflow.llm import language_model
from llm_rows import odd_rows


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def expected(rows, trained, m=200.0, k=8.0):
    """By an automaton that is walked literally, one word after the other, the state carried along."""
    words, pairs, triples = Counter(), Counter(), Counter()
    for key, t, *_ in rows:
        if trained(key):
            x = tokens(t)
            words.update(x)
            pairs.update(zip([None, *x[:-1]], x))
            triples.update(zip([None, *x[:-2]], x[:-1], x[1:]))
    n, v = sum(words.values()), len(words)
    once, twice = (sum(c == i for c in words.values()) for i in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    one = lambda w: (words[w] - d) / n if words[w] else d * v / n
    two = lambda p, w: (pairs[p, w] + m * one(w)) / (words[p] + m)
    three = lambda o, p, w: (triples[o, p, w] + k * two(p, w)) / (pairs[o, p] + k)
    for key, t, *_ in rows:
        x, score, state = tokens(t), 0.0, (None,)
        for w in x:
            while True:
                if len(state) == 2 and triples[*state, w]:
                    score, state = score + math.log10(three(*state, w)), (state[1], w)
                    break
                if len(state) == 1 and pairs[*state, w]:
                    score, state = score + math.log10(two(*state, w)), (*state, w)
                    break
                if not state:
                    score, state = score + math.log10(one(w)), (w,) if words[w] else ()
                    break
                score += math.log10(k / (pairs[state] + k) if len(state) == 2 else m / (words[state[0]] + m))
                state = state[1:]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in x)
        yield (-1 if key is None else key), len(x), sum(words[w] > 0 for w in x), n, round(base, 6), round(score, 6)


@pytest.mark.parametrize("block_bytes", [300, 8 << 20])
def test_all_counts(odd, block_bytes):
    told = language_model.score(odd, F.col("doc_id") % 3 != 1, block_bytes=block_bytes).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in told)
    assert got == sorted(expected(odd_rows(), lambda k: k is not None and k % 3 != 1))


def test_probabilities_of_a_state_add_up():
    totals = language_model.Totals(tokens=100, distinct=10, once=4, twice=3)
    counts = [50, 20, 10, 6, 4, 4, 2, 2, 1, 1]
    unigram = [(c - totals.discount) / 100 for c in counts] + [totals.discount * 10 / 100]
    assert abs(sum(unigram) - 1) < 1e-12


def test_empty_and_untrained(odd, nothing):
    assert language_model.score(nothing, F.lit(True)).count() == 0
    rows = language_model.score(odd, F.lit(None).cast("boolean")).collect()
    assert len(rows) == odd.count() and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)
