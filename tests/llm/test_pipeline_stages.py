"""The pipeline against the same stages in plain Python."""

from __future__ import annotations

import collections
import random

import corpus_pipeline
from test_exact import docs_frame, prose

from docketlake.llm import piece_codec, queries


def test_pipeline(spark, tmp_path):
    rng = random.Random(20)
    base = [[prose(rng, 25) for _ in range(4)] for _ in range(20)]
    rows = [(i, "\n".join(b), "en", f"s{i % 3}", 0) for i, b in enumerate(base)]
    rows += [(100 + i, "\n".join(b), "en", "s1", 0) for i, b in enumerate(base[:5])]  # exact copies
    rows += [(200, "too short", "en", "s0", 0), (201, "same words here again now " * 20, "en", "s0", 0), (202, None, None, None, None)]  # rejected
    docs_frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{i}.parquet")
        seen[name] = docs.collect()
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in seen["quality"]} == {r[0] for r in rows} - {200, 201, 202}
    assert {r["doc_id"]: r["text"] for r in seen["lines"]} == {r[0]: r[1] for r in rows if r[0] < 100}
    assert all(r["n_chars"] == len(r["text"]) for r in seen["lines"])
    assert len(seen["near_duplicates"]) == 20
    copies = collections.Counter(r["doc_id"] for r in seen["mix"])
    # All documents have 100 words, so each of the three sources may be short of its target by less than one document.
    assert max(copies.values()) <= 3 and 0 <= 20 * 100 - sum(len(r["text"].split()) for r in seen["mix"]) < 3 * 100
    codec = piece_codec.codec(queries.vocabulary("piece_bpe_32k.model"))
    assert collections.Counter(r["n_tokens"] for r in seen["pieces"]) == collections.Counter(len(codec.encode(r["text"])) for r in seen["mix"])


def test_run_is_registered(spark):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and len(corpus_pipeline.STAGES) == 5


def test_quality_oracle(spark, tmp_path):
    import duckdb

    from docketlake.llm import quality_rules

    rng = random.Random(21)
    rows = [(i, rng.choice([prose(rng, 40), "a b c d e " * 9, "### $$ x\n### $$ x", "", "tiny"]), "en", rng.choice(["x", "y", None]), 0) for i in range(80)]
    df = docs_frame(spark, rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = con.execute(queries.ORACLES["op8_quality_rules"]).fetchall()
    got = [tuple(r) for r in quality_rules.judge(df).select(*names).collect()]
    assert sorted(got) == sorted(want)
