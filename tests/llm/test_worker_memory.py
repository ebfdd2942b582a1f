"""What workers of the pipeline hold while they run, and after."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest
from test_exact import frame

from docketlake.llm import kernels, ngram_join, piece_codec, queries


@pytest.fixture()
def work(spark, monkeypatch):
    """The function that tasks run."""
    made = []
    docs = frame(spark, [""])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, function, schema: made.append(function) or self)
    path = queries.vocabulary("piece_bpe_32k.model")
    piece_codec.encode_documents(docs, path)
    piece_codec.codec(path)  # loaded before anything is measured
    return made[0]


def batch(texts: list[str]) -> pa.RecordBatch:
    return kernels.batch({"key": pa.array(range(len(texts))), "text": pa.array(texts)})


def run(work, texts: list[str]) -> int:
    """Bytes at the peak, beyond the texts."""
    batches = iter([batch(texts)])
    tracemalloc.start()
    try:
        for _ in work(batches):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_step_of_short_texts_is_small(work):
    rng = random.Random(31)
    known = [f"w{i}" for i in range(500)]
    assert run(work, [" ".join(rng.choices(known, k=400)) for _ in range(1000)]) < 24 << 20


def test_nothing_is_left_when_memory_is_given_back(work, monkeypatch):
    left = []
    monkeypatch.setattr(kernels, "release", lambda: left.append(tracemalloc.get_traced_memory()[0]))
    run(work, [" ".join(f"w{i * 200 + k}" for k in range(200)) for i in range(100)])
    assert len(left) == 1 and left[0] < 1 << 20


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(piece_codec, "PART_CHARS", 20)
    codec = piece_codec.codec(queries.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(32)
    for _ in range(300):
        text = "".join(rng.choices(["a", "word", " ", "  ", "▁", "é", "\n", "x" * 30], k=rng.randrange(60)))
        assert codec.encode(text) == codec.library.encode(text, add_eos=True)


def test_counting_ngrams_is_small_and_counts_over_long_steps(spark, monkeypatch):
    """Texts of 4 MB: an n-gram that is in four of them, far apart, is reported."""
    made = []

    class Caught(Exception):
        pass

    def catch(self, function, schema):
        made.append(function)
        raise Caught

    docs = frame(spark, [""])
    monkeypatch.setattr(type(docs), "mapInArrow", catch)
    with pytest.raises(Caught):
        ngram_join.frequent_grams(docs, 5)
    rng = random.Random(33)
    texts = [" ".join(f"w{rng.randrange(10**5)}" for _ in range(600)) for _ in range(1000)]
    for i in (0, 300, 600, 999):
        texts[i] += " five words that are shared"
    batches = iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])
    tracemalloc.start()
    try:
        found = [(b["gram"].to_pylist(), b["n"].to_pylist()) for b in made[0](batches)]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [n for _, n in found] == [[4]] and peak < 36 << 20
