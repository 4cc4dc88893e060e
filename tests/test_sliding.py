"""Sliding windows that are carried on, against looking at each window by itself."""

import random
import time

import numpy as np
import pandas as pd
import pytest

from gaugeflow.operators import sliding

STATISTICS = [*sliding.MERGED, "quantile", "iqr", "mode"]


def plain(samples, width, statistic, q):
    out = []
    for i in range(len(samples)):
        w = samples[max(0, i - width + 1) : i + 1]
        low, mid, high = np.quantile(w, [0.25, q, 0.75])
        out.append({
            "sum": w.sum(), "mean": w.mean(), "count": len(w), "max": w.max(), "min": w.min(), "abs_max": np.abs(w).max(), "quantile": mid, "iqr": high - low,
            "variance": w.var(ddof=1) if len(w) > 1 else np.nan, "std": w.std(ddof=1) if len(w) > 1 else np.nan, "mode": pd.Series(w).mode().iloc[0],
        }[statistic])
    return np.array(out, float)


def streamed(samples, width, statistic, q, cuts):
    """In batches, keeping nothing between them but the pages that were written."""
    store, out, seen, touched = {}, [], 0, 0
    for a, b in zip([0, *cuts], [*cuts, len(samples)]):
        pages = sliding.Pages(store.get)
        row = sliding.Row(pages, "v")
        row.append(seen, samples[a:b])
        out.append(sliding.window(pages, "w", width, statistic, q).extend(row, seen, samples[a:b]))
        seen += b - a
        row.forget(seen - width - 1, a - width - 1 - sliding.PAGE)
        for key, page in pages.changes():
            touched += 1
            store.pop(key, None) if page is None else store.__setitem__(key, list(page))
    return np.concatenate(out), store, touched


@pytest.mark.parametrize("statistic", STATISTICS)
@pytest.mark.parametrize("width", [1, 2, 5, 33, 70, 300])
def test_batches_equal_windows_by_themselves(statistic, width):
    rng = random.Random(width)
    samples = np.array([rng.choice([1e9, -1e9, 0.1]) if rng.random() < 0.01 else float(rng.randint(0, 9)) if rng.random() < 0.5 else rng.gauss(1000, 1) for _ in range(900)])
    want = plain(samples, width, statistic, 0.3)
    cuts = sorted(rng.sample(range(1, 900), 12))
    got, store, _ = streamed(samples, width, statistic, 0.3, cuts)
    assert np.allclose(got, want, rtol=1e-7, atol=1e-4, equal_nan=True)
    assert np.allclose(sliding.rolled(samples, width, statistic, 0.3), want, rtol=1e-7, atol=1e-4, equal_nan=True)
    assert sum(map(len, store.values())) < 16 * width + 16 * sliding.PAGE


@pytest.mark.parametrize("statistic", ["mean", "std", "max", "sum", "quantile", "mode"])
def test_a_spike_leaves_no_trace(statistic):
    samples = np.full(2000, 0.1)
    samples[500] = 1e9
    got = sliding.rolled(samples, 400, statistic)
    want = {"mean": 0.1, "std": 0.0, "max": 0.1, "sum": 40.0, "quantile": 0.1, "mode": 0.1}[statistic]
    assert np.allclose(got[900:], want, rtol=1e-12, atol=1e-9)


def test_smallest_of_the_most_frequent():
    samples = np.array([5.0, 3.0, 5.0, 3.0, 1.0] * 40)
    assert sliding.rolled(samples, 40, "mode")[-1] == 3.0
    assert sliding.one_by_one(np.array([2.0, 1.0]), 5, "mode", 0.5).tolist() == [2.0, 1.0]


@pytest.mark.parametrize("statistic", ["mean", "std", "quantile", "mode"])
def test_cost_does_not_grow_with_the_window(statistic):
    samples = np.random.default_rng(1).normal(size=30_000)
    seconds = []
    for width in (100, 6400):
        begin = time.process_time()
        sliding.rolled(samples, width, statistic)
        seconds.append(time.process_time() - begin)
    assert seconds[1] < 4 * seconds[0] + 0.2, seconds


def test_few_pages_are_touched():
    samples = np.random.default_rng(2).normal(size=5000)
    _, _, touched = streamed(samples, 4000, "mean", 0.5, [4200, 4210, 4220])
    _, _, more = streamed(samples, 4000, "mean", 0.5, [4200])
    assert touched - more <= 8  # two batches of ten samples: the last pages and the head
