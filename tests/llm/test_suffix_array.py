import numpy as np
import pytest

from gaugeflow.llm import suffix_array
from llm_rows import frame, odd_rows


def expected(rows):
    """(key, kept, spans) by comparing all windows."""
    rows = [(k if k is not None else suffix_array.NEVER, (t or "").encode()) for k, t, *_ in rows]
    least = {}
    for k, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            least[w] = min(least.get(w, k), k)
    out = []
    for k, b in rows:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if least[b[i : i + 50]] < k:
                gone[i : i + 50] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])).astype(int)))
        out.append((k, bytes(np.frombuffer(b, np.uint8)[~gone]), [tuple(x) for x in edges.reshape(-1, 2).tolist()]))
    return sorted(out)


def found(docs, **options):
    rows = suffix_array.remove_repeats(docs, carry=("doc_id",), **options).collect()
    return sorted((r.row.doc_id if r.row.doc_id is not None else suffix_array.NEVER, bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in rows)


@pytest.mark.parametrize("block_bytes", [200, 4000, 8 << 20])
@pytest.mark.parametrize("many", [1, 4096])
def test_all_windows(odd, block_bytes, many, monkeypatch):
    monkeypatch.setattr(suffix_array, "MANY", many)
    assert found(odd, block_bytes=block_bytes) == expected(odd_rows())


def test_passages_that_meet_and_overlap(spark):
    a, b, c = ("".join(chr(97 + (i * k) % 23) for i in range(1, 90)) for k in (3, 5, 7))
    texts = [a, b, c, a + b, b[10:] + c[:60], a[:49] + c, "é" * 40 + a, "è" * 40 + a, c[5:54], c[5:55]]
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    assert found(frame(spark, rows), block_bytes=100) == expected(rows)


def test_radix_groups():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 2, (400, 11), dtype=np.uint8)
    rows, group = suffix_array.radix_groups(windows)
    by_text = {}
    for i, w in enumerate(windows):
        by_text.setdefault(w.tobytes(), []).append(i)
    want = sorted(sorted(x) for x in by_text.values() if len(x) > 1)
    got = sorted(sorted(rows[group == g].tolist()) for g in np.unique(group))
    assert got == want


def test_columns_and_empty(odd, nothing):
    told = suffix_array.remove_repeats(odd, as_text=True)
    assert told.columns == ["row", "n_bytes", "spans", "kept"] and told.schema["row"].dataType.names == [c for c in odd.columns if c != "text"]
    assert suffix_array.remove_repeats(nothing).count() == 0
