import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gaugeflow.llm import bpe
from llm_rows import frame, odd_rows

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(docs, texts, encoding):
    told = bpe.encode(docs, path=PATH, pattern=public_tokenizers.PATTERN, carry=("text",)).withColumn("back", bpe.decode(F.col("ids"), path=PATH)).collect()
    assert sorted(r.text or "" for r in told) == sorted(t or "" for t in texts)
    for r in told:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(r.text or "")
        assert bytes(r.back).decode() == (r.text or "")


def test_odd_rows(odd, encoding):
    check(odd, [t for _, t, *_ in odd_rows()], encoding)


def test_white_space_contractions_and_runs(spark, encoding):
    rng = random.Random(3)
    texts = ["it's we'll I'D 'S", "  a\n\n  b ", "\x1c\x1d\x85\xa0 x　y᠎", "a" * 999, "½١ 12", "\t\tx\r\n", "'", " '"]
    texts += ["".join(rng.choice(" \n\tabé日\U0001f9161½'s.,\x1f ́") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    check(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), texts, encoding)


def test_empty_null_and_unknown_ids(spark, nothing):
    assert bpe.encode(nothing, path=PATH, pattern=public_tokenizers.PATTERN).count() == 0
    df = spark.createDataFrame([(None,), (b"",), (np.array([70_000, 5], "<u4").tobytes(),)], "ids binary")
    assert [r[0] for r in df.select(bpe.decode("ids", path=PATH)).collect()] == [None, b"", bpe.vocabulary(PATH).bytes[5:6].tobytes()]
