"""What sketches rule out makes no rows and moves no texts."""

from __future__ import annotations

import random

from pyspark.sql import functions as F
from test_exact import components, frame

from docketlake.llm import ngram_join, resolve


def jaccard(a: str, b: str, size: int) -> float:
    x, y = ({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_buckets_make_no_rows_of_ruled_out_pairs(spark, monkeypatch):
    """Forty texts that share an opening, whose shingles put all in one bucket, and have nothing else in common."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 0)
    rng = random.Random(5)
    opening = [f"s{i}" for i in range(30)]
    texts = [" ".join([*opening, *[f"w{rng.randrange(10**6)}" for _ in range(60)]]) for _ in range(40)]
    texts += [texts[0] + " more", texts[1] + " more"]
    made = {}
    plain = resolve.staged

    def staged(df, name, *rest):
        made.setdefault(name, []).append(plain(df, name, *rest))
        return made[name][-1]

    monkeypatch.setattr(resolve, "staged", staged)
    monkeypatch.setattr(resolve, "discard", lambda *tables: None)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame(spark, texts), 3, (9, 10)).collect()}
    links = [(i, j) for j in range(len(texts)) for i in range(j) if jaccard(texts[i], texts[j], 3) >= 0.9]
    assert links == [(0, 40), (1, 41)] and got == components(range(len(texts)), links)
    few = made["few"][0]
    assert few.count() and "sketch" in few.columns and few.filter(F.size("sketch") != ngram_join.SKETCH_BITS // 64).isEmpty()


def test_long_texts_travel_only_for_pairs_that_finer_sketches_allow(spark, monkeypatch):
    rng = random.Random(6)
    long = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(9000)) for _ in range(2)]
    shared = " ".join(f"s{i}" for i in range(2500))
    texts = [f"{shared} {long[0]}", f"{shared} {long[1]}", f"{shared} {long[0]} end"]
    passed = []
    plain = ngram_join.similar_pairs

    def similar_pairs(pairs, *rest):
        passed.append(pairs.count())
        return plain(pairs, *rest)

    monkeypatch.setattr(ngram_join, "similar_pairs", similar_pairs)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(frame(spark, texts), 5, (4, 5)).collect()}
    assert got == {0: 0, 1: 1, 2: 0} and sum(passed) == 1
