"""Near copies of short lines."""

from __future__ import annotations

import random

from test_exact import components, frame, prose

from docketlake.llm import line_dedup


def test_one_changed_word_in_a_short_line(spark):
    rng = random.Random(24)
    texts = []
    for _ in range(30):
        words = prose(rng, 18).replace(".", "").split()
        texts += [" ".join(words), " ".join([*words[:9], "other", *words[10:]]), " ".join([*words[:-1], words[-1] + "z"])]
    sets = [{t[k : k + 5] for k in range(len(t) - 4)} for t in texts]
    n = range(len(texts))
    label = components(n, [(i, j) for i in n for j in n if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])])
    assert sum(label[i] != i for i in n) > 40
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(spark, texts)).collect()}
    assert got == {i: t if label[i] == i else "" for i, t in enumerate(texts)}
