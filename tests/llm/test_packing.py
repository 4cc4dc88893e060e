import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_rows import odd_rows
from tokenizers import Tokenizer

from gaugeflow.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def encoded(text):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 2], np.uint32)


def proved(pieces, texts, size):
    """Every id of every row lies in one piece, sequences have no gap, and their sizes are `size` or a power of two."""
    sequences = defaultdict(list)
    want = defaultdict(list)
    for key, text in texts:
        want[key].append(encoded(text))
    covered = defaultdict(int)
    for p in pieces:
        match = [ids for ids in want[p.doc_id] if len(ids) == p.doc_tokens and zlib.crc32(ids[p.start : p.start + p.length].astype("<u4").tobytes()) == p.ids_crc32]
        assert match and p.length > 0 and p.start + p.length <= p.doc_tokens
        covered[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == {key: sum(map(len, all_ids)) for key, all_ids in want.items()}
    fills = []
    for runs in sequences.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        fills.append(at)
        assert at == size or (at < size and at & (at - 1) == 0)
    return fills


def test_odd_rows(spark, odd):
    for size in (4096, 64):
        told = packing.pack(odd, path=PATH, end_id=2, size=size).collect()
        proved(told, [r[:2] for r in odd_rows()], size)
        single = [p for p in told if p.doc_id == 301]
        assert [(p.start, p.length, p.doc_tokens) for p in single] == [(0, 1, 1)]


def test_production_query(spark, data):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    pieces = queries.QUERIES["op12_packing"](spark, data).collect()
    fills = proved(pieces, texts, 4096)
    assert sum(f == 4096 for f in fills) > len(fills) // 2
    again = queries.QUERIES["op12_packing"](spark, data).collect()
    assert sorted(pieces) == sorted(again)


def test_empty(spark, nothing):
    assert packing.pack(nothing, path=PATH, end_id=2).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_least_sum_of_squares(seed):
    """Each placement is one of those that make the sum of squared counts of open windows least."""
    rng, packer = random.Random(seed), packing.Packer(30, most_open=10**9)
    for doc in range(400):
        n = rng.randint(1, 29)
        before = packer.level.copy()
        packer.place(packing.Piece(doc, 0, np.zeros(n, np.uint32), n))
        options = []
        for h in [0, *(h for h in range(1, 31 - n) if before[h])]:
            after = before.copy()
            if h:
                after[h] -= 1
            if h + n < 30:
                after[h + n] += 1
            options.append(int((after**2).sum()))
        assert int((packer.level**2).sum()) == min(options)
        assert [len(w) for w in packer.windows] == packer.level[:30].tolist()


def test_open_windows_are_bounded_and_nothing_is_lost():
    packer = packing.Packer(100, most_open=20)
    for doc in range(5000):  # no two fit together
        packer.add(doc, np.full(51, doc, np.uint32))
        assert packer.open <= 20
    packer.end()
    assert sum(len(p.ids) for w in packer.done for p in w) == 5000 * 51
    assert sum(sum(len(p.ids) for p in w) != 100 for w in packer.done) <= 7


def test_words_give_the_ids_of_the_text():
    rng, words = random.Random(5), packing.Words(PATH)
    odd = [" ", "\n", "\t", "\r", "\x85", " ", "Σ", "ς", "A", "İ", "1", "é", "é", "̀", "ᄀ", "ᅡ", "'s", "'T", "ﬁ", "日", "!", "<|endoftext|>", "\x00", "‍", "😀"]
    for _ in range(1500):
        text = "".join(rng.choice(odd) if rng.random() < 0.8 else chr(rng.randrange(32, 0xD800)) for _ in range(rng.randrange(14)))
        assert words.encode(text).tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids
    mixed = [rng.choice(["", "a \x01 b", "\x01", "x\x01y", "plain words", "é" * 50, "\n \n"]) for _ in range(500)]
    assert [x.tolist() for x in words.encode_all(mixed)] == [TOKENIZER.encode(x, add_special_tokens=False).ids for x in mixed]


def test_words_are_forgotten_and_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(packing, "MOST_WORDS", 50)
    monkeypatch.setattr(packing, "PART_CHARS", 40)
    rng, words = random.Random(6), packing.Words(PATH)
    for _ in range(20):
        texts = [" ".join("".join(rng.choice("abcdé\n") for _ in range(rng.randint(0, 6))) for _ in range(rng.choice((1, 5, 300)))) for _ in range(9)]
        assert [x.tolist() for x in words.encode_all(texts)] == [TOKENIZER.encode(x, add_special_tokens=False).ids for x in texts]
