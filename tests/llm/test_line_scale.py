"""Line deduplication of tables of which no list is small enough to be sent to all tasks."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from docketlake.llm import line_dedup, storage
from docketlake.llm.storage import staged


def test_documents_are_not_shuffled_for_texts_of_lines(spark, monkeypatch):
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = ["é one\n\nthree", "", "\n", "last\n", "just one", "a\nb\nc\nlast one"] * 40
        docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "id string, text string").repartition(3)
        places = [(f"d{i}", n, line) for i, t in enumerate(texts) for n, line in enumerate(t.split("\n")) if (i + n) % 3 == 0]
        rows = [(k, i, n, int(line_dedup.digests([line])[0][0])) for k, (i, n, line) in enumerate(places)]
        wanted = staged(spark.createDataFrame(rows, "node long, id string, line int, k1 long"), "wanted")
        found = line_dedup.line_texts(docs, wanted, True)
        assert sorted((r["node"], r["text"]) for r in found.collect()) == [(k, line) for k, (_, _, line) in enumerate(places)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        indents = [(len(re.match(r"[\s:|+*()\d-]*", row)[0]), row) for row in plan.split("Initial Plan")[0].split("\n")]
        at = next(i for i, (_, row) in enumerate(indents) if "MapInArrow" in row)
        below = [row for _, row in indents[at + 1 :]]
        below = below[: next((i for i, (d, _) in enumerate(indents[at + 1 :]) if d <= indents[at][0]), len(below))]
        assert below and not any("Join" in row for row in below)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_rows_that_repeat_an_id_give_the_wanted_text(spark):
    docs = spark.createDataFrame([("a", "x\nwanted"), ("a", "x\nother"), ("a", "x\nwanted")], "id string, text string")
    wanted = staged(spark.createDataFrame([(5, "a", 1, int(line_dedup.digests(["wanted"])[0][0]))], "node long, id string, line int, k1 long"), "wanted")
    assert [tuple(r) for r in line_dedup.line_texts(docs, wanted, False).collect()] == [(5, "wanted")]


def test_shared_band_keys(spark):
    """Keys that one run finds twice, keys that only different runs share, a very frequent key, keys of one node."""
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.integers(-(2**63), 2**63, 500), np.arange(60)])
    table = [(n, *(7 if rng.random() < 0.3 else int(k) for k in rng.choice(keys, 3))) for n in range(600)]
    distinct = spark.createDataFrame(table, "node long, b0 long, b1 long, b2 long").repartition(5)
    nodes: dict[int, list[int]] = {}
    for n, *row in table:
        for k in row:
            nodes.setdefault(k, []).append(n)
    want = sorted((k, n) for k, of in nodes.items() if len(of) > 1 for n in of)
    for size in (8, 1 << 19):
        got = line_dedup.band_buckets(distinct, ["b0", "b1", "b2"], size).collect()
        assert sorted(map(tuple, got)) == want
    assert line_dedup.band_buckets(distinct.filter("node < 0"), ["b0", "b1", "b2"]).isEmpty()


def test_documents_are_read_once_for_texts(spark, monkeypatch):
    """Large buckets of lines that differ too much take a second step; their texts are there by then."""
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(line_dedup, "tune", lambda *_: (12, 1))
    calls, plain = [], line_dedup.line_texts
    monkeypatch.setattr(line_dedup, "line_texts", lambda *a: calls.append(1) or plain(*a))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(40)]
    lines = [" ".join(rng.choice(words, 8)) for _ in range(150)]
    lines += [line[:-1] + "z" for line in lines[:60]]
    docs = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "id long, text string")
    got = {r["id"] for r in line_dedup.removed_lines(docs).filter("n_kept = 0").collect()}

    def shingles(t):
        return {t[i : i + 5] for i in range(len(t) - 4)}

    sets, root = [shingles(t) for t in lines], list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    assert got == {i for i, r in enumerate(root) if r != i}
    assert len(calls) == 1
