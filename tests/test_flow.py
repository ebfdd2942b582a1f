"""Runs side by side, comments in the flow, the command harness, publishing and dumps."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docketlake import cli, service
from docketlake.functions import pii
from docketlake.operators import classify, harness, records, views
from docketlake.plans import pipeline
from docketlake.schema import COMMENT_SCHEMA
from docketlake.sources import dumps

POST = {"id": "a", "title": "EB2 NIW approved", "selftext": "My I-140 NIW was approved, 3 citations", "author": "x", "created_utc": 1700000000, "subreddit": "s"}


def store_with(spark, path, *posts):
    w = pipeline.Warehouse(spark, f"file://{path}/w")
    raw = spark.read.json(spark.sparkContext.parallelize([json.dumps(p) for p in posts]))
    for c, kind in (("link_flair_text", "string"), ("url", "string"), ("score", "long"), ("num_comments", "long"), ("raw_json", "string")):
        raw = raw.withColumn(c, F.lit(None).cast(kind)) if c not in raw.columns else raw
    pipeline.ingest(w, raw, "s", "dump", 1700000100)
    return w


def test_runs_stand_side_by_side_and_resume(spark, tmp_path):
    w = store_with(spark, tmp_path, POST)
    assert [pipeline.classify_pending(w, 1), pipeline.classify_pending(w, 2, effort="high"), pipeline.classify_pending(w, 3, effort="high"), pipeline.classify_pending(w, 4, effort="low", label="x"), pipeline.classify_pending(w, 5)] == [1, 1, 0, 1, 0]
    assert {r["run_key"] for r in w.read("classified_records").collect()} == {"mock/mock", "mock/mock@high", "mock/mock@low#x"}

    class Fixed(classify.Classifier):
        def classify(self, *, title, body, flair, op_comments):
            return {"status": "ok", "model": "m9", "fields_json": json.dumps({"is_niw_i140_decision": True, "outcome": "denied"})}

    classify.register_backend("fixed", Fixed())
    assert [pipeline.classify_pending(w, 6, "fixed"), pipeline.classify_pending(w, 7, "fixed"), pipeline.classify_pending(w, 8, "fixed", effort="high")] == [1, 0, 1]
    known = Fixed()
    known.model = "m2"
    classify.register_backend("known", known)
    assert [pipeline.classify_pending(w, 9, "known"), pipeline.classify_pending(w, 10, "known")] == [1, 0]
    assert {r["run_key"] for r in w.read("classified_records").filter("classifier_backend in ('fixed', 'known')").collect()} == {"fixed/m9", "fixed/m9@high", "known/m2"}


def test_comments_reach_the_classifier_and_are_refreshed(spark, tmp_path):
    w = store_with(spark, tmp_path, POST, {**POST, "id": "b", "author": "[deleted]"})
    said = spark.createDataFrame([("a", "c1", "x", "it took 40 days", "t3_a", 5), ("a", "c2", "y", "how long?", "t3_a", 4)], COMMENT_SCHEMA)
    assert pipeline.classify_pending(w, 1) == 2
    assert pipeline.classify_pending(w, 2, said=said) == 1  # new content for one post only
    texts = {r["id"]: r["op_comments"] for r in w.read("raw_posts").collect()}
    assert texts == {"a": "OP comment: it took 40 days", "b": None}
    assert pipeline.refresh_comments(w, said) == 0
    old = w.read("raw_posts").withColumn("op_comments", F.when(F.col("id") == "a", "it took 40 days"))
    old.write.parquet(f"{tmp_path}/old")
    w.write("raw_posts", spark.read.parquet(f"file://{tmp_path}/old"))
    assert pipeline.refresh_comments(w, said) == 1 and pipeline.classify_pending(w, 3) == 0


def command(*answers):
    left, prompts, slept = list(answers), [], []

    def run(argv, prompt, timeout):
        prompts.append(prompt)
        answer = left.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return harness.CommandClassifier(["tool"], model="m", run=run, sleep=slept.append), prompts, slept


def ask(c):
    return c.classify(title="t", body=None, flair=None, op_comments=" said ")


def test_command_harness(spark):
    c, prompts, slept = command((0, '{"structured_output":{"outcome":"denied"},"total_cost_usd":0.25}', ""))
    assert ask(c) == {"status": "ok", "fields_json": '{"outcome": "denied"}', "model": "m", "raw_output": '{"structured_output":{"outcome":"denied"},"total_cost_usd":0.25}', "cost_usd": 0.25}
    from docketlake.functions.derive import user_prompt

    one = spark.range(1).select(user_prompt(F.lit("t"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(" said ")))
    assert prompts[0] == one.first()[0]
    c, prompts, slept = command((0, "no idea", ""), (0, 'Sure:\n```json\n{"outcome":"approved"}\n```', ""))
    assert ask(c)["fields_json"] == '{"outcome": "approved"}' and prompts[1] == prompts[0] + harness.STRICTER
    c, prompts, slept = command(TimeoutError("slow"), TimeoutError("slow"), TimeoutError("slow"))
    assert ask(c)["failure_reason"] == "slow" and slept == [5.0, 10.0]
    c, prompts, slept = command((1, "", "Usage limit reached"), (1, "", "usage limit"), (0, '{"result":"{\\"a\\": 1}"}', ""))
    assert ask(c)["fields_json"] == '{"a": 1}' and slept == [300.0, 300.0]
    c, prompts, slept = command((2, "", "bad flag"), OSError("gone"), (0, "[]", ""))
    assert ask(c) == {"status": "failed", "failure_reason": "no JSON object in the answer", "model": "m"}
    assert harness.run_command(["cat"], "hi", 5) == (0, "hi", "")
    with pytest.raises(TimeoutError):
        harness.run_command(["sleep", "5"], "", 0.1)


def test_version_follows_shown_values(spark, tmp_path):
    w = store_with(spark, tmp_path, POST)
    pipeline.classify_pending(w, 1)
    first = w.version()
    tag = service.route(w, "/api/stats/summary", {})[1]["ETag"]
    assert service.route(w, "/api/stats/summary", {}, tag)[0] == 304 and w.mark() == first
    spark.read.json(spark.sparkContext.parallelize([json.dumps({**POST, "title": POST["title"] + "!"})]))
    changed = w.read("raw_posts").withColumn("title", F.lit("EB2 NIW approved!"))
    changed.write.parquet(f"{tmp_path}/changed")
    w.write("raw_posts", spark.read.parquet(f"file://{tmp_path}/changed"))
    assert w.mark() != first and service.route(w, "/api/stats/summary", {}, tag)[0] == 200


def test_publishing_is_gated(spark, tmp_path, capsys):
    clean, dirty = store_with(spark, tmp_path / "c", POST), store_with(spark, tmp_path / "d", {**POST, "title": "NIW approved, mail me a.b@c.org"})
    for w, bad in ((clean, 0), (dirty, 1)):
        pipeline.classify_pending(w, 1)
        assert cli.main(["audit", "--warehouse", w.path], spark) == bad
        report = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert (report["authors"], report["deleted_authors"], report["removed_bodies"], report["hits"]["email"]) == (1, 0, 0, bad) and set(report["hits"]) == set(pii.DETECTORS)
    with pytest.raises(SystemExit):
        cli.main(["snapshot", "--public", "--warehouse", dirty.path, "--out", f"file://{tmp_path}/s"], spark)
    assert cli.main(["snapshot", "--public", "--warehouse", clean.path, "--out", f"file://{tmp_path}/s"], spark) == 0


def test_public_records_keep_their_flags(spark, tmp_path):
    w = store_with(spark, tmp_path, POST)
    pipeline.classify_pending(w, 1)
    all_records = records.records(w.read("classified_records"), w.read("raw_posts"))
    public = views.mark_refiled(all_records).withColumn("refiled", F.lit(True)).drop("author", "refile_approval")
    row = pipeline.dashboard(public).first()
    assert row["refiled"] is True and row["refile_approval"] is None
    assert "refiled" in pipeline.dashboard(all_records).columns


def test_arrays_are_streamed(spark, tmp_path):
    objects = [{"id": str(i), "title": "t" * (i % 7) + "é]},{[", "n": [1.5e3, {"x": None}]} for i in range(300)]
    text = json.dumps(objects, ensure_ascii=False, indent=1)
    (tmp_path / "a.json").write_text(text)
    got = [json.loads(r["raw_json"]) for r in dumps.read_dump(spark, f"file://{tmp_path}/a.json").collect()]
    assert got == objects
    for n, broken in enumerate((text[: len(text) // 2], text[:-1], "[1 2]", '[{"id":1},]x', "[" + json.dumps(objects[0])[:-2])):
        (tmp_path / f"b{n}.json").write_text(broken)
        with pytest.raises(Exception, match="array"):
            dumps.read_dump(spark, f"file://{tmp_path}/b{n}.json").collect()

    class Trickle:
        """Gives a few bytes at a time, so that elements and characters are cut everywhere."""

        def __init__(self, data, step):
            self.data, self.step = data, step

        def read(self, _):
            out, self.data = self.data[: self.step], self.data[self.step :]
            return out

    for step in (1, 3, 1000):
        assert [json.loads(x) for x in dumps.array_elements(Trickle(text[:4000].rsplit("},\n {", 1)[0].encode() + b"}]", step))] == json.loads(text[:4000].rsplit("},\n {", 1)[0] + "}]")
    assert list(dumps.array_elements(Trickle(b" [12, 3 ,\"a\",null] ", 1))) == ["12", "3", '"a"', "null"] and list(dumps.array_elements(Trickle(b"[]", 1))) == []


def test_an_array_beyond_one_variant(spark, tmp_path):
    n = 0
    with open(tmp_path / "large.json", "w") as f:
        f.write("[")
        for i in range(1500):
            f.write(("," if i else "") + json.dumps({"id": str(i), "title": "x" * 100_000}))
            n += 1
        f.write("]")
    assert dumps.submissions(dumps.read_dump(spark, f"file://{tmp_path}/large.json")).count() == n
