"""Passages that repeat inside of longer texts."""

from __future__ import annotations

import random

import pyarrow as pa
from test_exact import frame

from docketlake.llm import kernels, paragraph_dedup


def plain(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


def block_keys(words):
    units = paragraph_dedup.Units(*kernels.buffers(pa.array([" ".join(words)])))
    starts = units.blocks(paragraph_dedup.MIN_WORDS)
    return set(zip(*[k.tolist() for k in units.keys(starts, starts + paragraph_dedup.MIN_WORDS)], strict=True))


def test_every_run_of_fifty_words_shares_a_block():
    rng = random.Random(21)
    for _ in range(200):
        run = plain(rng, 2 * paragraph_dedup.MIN_WORDS)
        a, b = (plain(rng, rng.randrange(90)) + run + plain(rng, rng.randrange(90)) for _ in range(2))
        assert block_keys(a) & block_keys(b)


def test_runs_without_sentences_are_found(spark):
    rng = random.Random(22)
    texts = []
    for _ in range(20):
        run = plain(rng, 2 * paragraph_dedup.MIN_WORDS)
        texts += [" ".join(plain(rng, 70) + run + plain(rng, 70)) for _ in range(2)]
    got = {r["doc_id"]: r["kept_in"] for r in paragraph_dedup.repeated_spans(frame(spark, texts)).collect()}
    assert got == {i: [i - 1] for i in range(1, 40, 2)}


def test_passages_are_reported_whole(spark):
    rng = random.Random(23)
    texts, want = [], {}
    for n in (50, 51, 80, 130, 200):
        run = plain(rng, n)
        for k in range(3):
            before, after = plain(rng, rng.randrange(40, 90)), plain(rng, rng.randrange(40, 90))
            if k:
                want[len(texts)] = [(len(before) + 1, len(before) + 1 + n)]
            texts.append(" ".join([*before, f"<{len(texts)}", *run, f"{len(texts)}>", *after]))
    run = plain(rng, 70)
    texts.append(" ".join([*run, "between", *run, "end"]))
    want[len(texts) - 1] = [(71, 141)]
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in paragraph_dedup.repeated_spans(frame(spark, texts)).collect()}
    assert got == want
    cut = {r["doc_id"]: r["text"].split() for r in paragraph_dedup.remove_repeats(frame(spark, texts)).collect()}
    for i, [(s, e)] in want.items():
        words = texts[i].split()
        assert cut[i] == words[:s] + words[e:]
