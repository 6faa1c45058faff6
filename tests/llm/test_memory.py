"""What a task holds at once."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from crosspanel.llm import frames, pieces
from crosspanel.llm.queries import VOCABULARY

from .conftest import SCHEMA


def test_batches_of_long_texts_are_bounded(spark, make):
    def batch_bytes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(t) for t in b.column("text").to_pylist())], pa.int64())], ["n"])

    spark.conf.unset(frames.BATCH_KEY)
    docs = make([(i, f"w{i} " * 60_000, "en", "web", 0) for i in range(60)], SCHEMA).coalesce(1)
    corpus_pipeline.encoded(spark, docs, "")
    sizes = [r.n for r in docs.select("text").mapInArrow(batch_bytes, "n long").collect()]
    assert max(sizes) <= frames.BATCH_BYTES + 300_000
    assert sum(sizes) == sum(60_000 * len(f"w{i} ") for i in range(60))


def test_a_limit_of_the_session_stays(spark):
    before = spark.conf.get(frames.BATCH_KEY, None)
    try:
        spark.conf.set(frames.BATCH_KEY, "12345678")
        frames.bound_batches(spark)
        assert spark.conf.get(frames.BATCH_KEY) == "12345678"
    finally:
        spark.conf.unset(frames.BATCH_KEY) if before is None else spark.conf.set(frames.BATCH_KEY, before)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_vocabulary(VOCABULARY, "zipf")


def random_texts(seed, n):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789éüñ日本語😀"
    return [" ".join("".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(50)) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 5, 40])
def test_encoding_does_not_depend_on_the_rows_kept(vocabulary, monkeypatch, most):
    texts = [*random_texts(1, 30), "aaa", "", None, "abc", "xyz"]
    want = pieces.Encoder(vocabulary).encode_texts(texts)
    monkeypatch.setattr(pieces, "MAX_ROWS", most)
    encoder = pieces.Encoder(vocabulary)
    for some in (texts, texts[::-1][:4], texts):
        at = [texts.index(t) for t in some]
        for own, i in zip(encoder.encode_texts(some), at, strict=True):
            assert (own is None and want[i] is None) or np.array_equal(own, want[i])
        encoder._forget()


def test_encoder_holds_each_transition_once(vocabulary):
    encoder = pieces.Encoder(vocabulary)
    texts = [" ".join(chr(c) for c in encoder.alphabet[: pieces.MAX_ROWS - 1])]
    tracemalloc.start()
    try:
        encoder.encode_texts(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 1.5 * 4 * (1 + pieces.MAX_ROWS) * len(encoder.fail)
