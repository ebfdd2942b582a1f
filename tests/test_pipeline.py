from __future__ import annotations

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from docketlake import cli, service
from docketlake.operators import classify
from docketlake.plans import pipeline
from docketlake.sources import archive_api, dumps, sinks

LINES = [
    {"id": "a1", "title": "Approved in 88 days!", "selftext": "NIW approved in 88 days. PhD in machine learning, no citations, 2 papers.", "link_flair_text": "APPROVED", "created_utc": 1700000000, "author": "u1", "subreddit": "s"},
    {"id": "a2", "title": "Denied", "selftext": "I-140 NIW denied after RFE, Master's in economics, 5 citations. Used WeGreened", "link_flair_text": "DENIAL", "created_utc": 1690000000, "author": "u1", "subreddit": ""},
    {"id": "a3", "title": "Approved, adjustment", "selftext": "I-485 approved", "link_flair_text": "APPROVED", "created_utc": 1700000100, "author": "[deleted]"},
    {"id": "a4", "title": "A question", "selftext": "how long?", "created_utc": 1700000200, "author": "u3"},
    {"id": "c1", "body": "a comment", "created_utc": 1},
    {"id": "", "title": "no id", "created_utc": 5},
    {"id": "a5", "title": None, "created_utc": 5},
]


def write(path, kind):
    lines = [json.dumps(x) for x in LINES]
    if kind == "json":
        path.write_text(json.dumps(LINES))
    elif kind == "zst":
        path.write_bytes(zstandard.ZstdCompressor().compress(("\n".join([*lines, "", "{broken"]) + "\n").encode()))
    else:
        path.write_text("\n".join([*lines, "", "{broken", "[]"]) + "\n")
    return str(path)


@pytest.mark.parametrize("kind", ["jsonl", "ndjson", "json", "zst"])
@pytest.mark.parametrize("long_windows", [False, True])
def test_dumps(spark, tmp_path, kind, long_windows):
    got = dumps.posts(dumps.submissions(dumps.read_dump(spark, write(tmp_path / f"d.{kind}", kind), long_windows)))
    rows = {r["id"]: r for r in got.collect()}
    assert set(rows) == {"a1", "a2", "a3", "a4", "a5", ""}
    assert rows["a1"]["created_utc"] == 1700000000 and json.loads(rows["a1"]["raw_json"])["author"] == "u1"


@pytest.mark.parametrize("name", ["x.csv", "x.zst_blocks"])
def test_unsupported_dump(spark, name):
    with pytest.raises(ValueError):
        dumps.read_dump(spark, name)


def test_end_to_end(spark, tmp_path, capsys):
    home, dump = f"file://{tmp_path}/w", write(tmp_path / "d.jsonl", "jsonl")
    run = lambda *a: (cli.main([*a, "--warehouse", home, "--subreddit", "s", "--now", "1700001000"], spark), json.loads(capsys.readouterr().out or "null"))[1]
    run("init-db")
    first = run("load-dump", "--dump", dump)
    assert (first["total"], first["candidates"], first["inserted"], first["updated"]) == (4, 3, 4, 0)
    assert run("load-dump", "--dump", dump)["updated"] == 4
    assert run("classify")["classified"] == 3
    assert run("classify")["classified"] == 0
    status = run("status")
    assert (status["classified_count"], status["excluded_count"], status["active_pending_count"], status["is_partial"]) == (2, 1, 0, False)
    assert run("runs")[0]["run_key"] == "mock/mock"
    assert run("stats")["summary"]["rate"] == 0.5
    run("renormalize")
    assert run("snapshot", "--public")["data_version"]
    envelope, rows = sinks.read_snapshot(spark, [f"{home}/nothing", f"{home}/snapshot"])
    wire = {r["id"]: r for r in sinks.parse_wire(rows).collect()}
    assert envelope["meta"]["latest_post_utc"] == 1700000000 and set(wire) == {"a1", "a2"}
    assert wire["a2"]["refiled"] is True and wire["a1"]["citations"]["value"] == 0 and wire["a1"]["author"] is None
    w = pipeline.Warehouse(spark, home)
    assert pipeline.incremental_window(w, "s", 1700001000) == (1700001000 - 730 * 86400, 1700001000)
    code, headers, body = service.route(w, "/api/stats/distribution", {"metric": "degree"}, now=1700001000)
    assert code == 200 and {b["label"] for b in json.loads(body)["buckets"]} == {"PhD", "Masters"}
    assert service.route(w, "/api/stats/distribution", {"metric": "degree"}, headers["ETag"])[0] == 304
    assert service.route(w, "/api/stats/distribution", {"metric": "x"})[0] == 422 and service.route(w, "/api/meta", {"range": "1y"})[0] == 422
    assert json.loads(service.route(w, "/api/stats/summary", {"range": "3m"}, now=1700001000)[2])["approved"] == 1
    assert run("clear-classifications", "--backend", "mock")["deleted"] == 3


def test_changed_content_is_classified_again(spark, tmp_path):
    w = pipeline.Warehouse(spark, f"file://{tmp_path}/w")
    raw = spark.createDataFrame([("x", "s", "Approved", "NIW approved", "a", 5)], "id string, subreddit string, title string, selftext string, author string, created_utc long")
    raw = raw.withColumns({c: F.lit(None).cast("string") for c in ("link_flair_text", "url")} | {c: F.lit(0).cast("long") for c in ("score", "num_comments")} | {"raw_json": F.lit("{}")})
    pipeline.ingest(w, raw, "s", "api", 1, advance=True)
    assert pipeline.classify_pending(w, 1) == 1
    pipeline.ingest(w, raw.withColumn("selftext", F.lit("NIW denied")), "s", "api", 2, advance=True)
    assert pipeline.classify_pending(w, 2) == 1 and w.read("classified_records").count() == 2
    assert pipeline.incremental_window(w, "s", 200_000)[0] == 0


def test_external_classifier(spark):
    class Echo(classify.Classifier):
        name = "echo"

        def classify(self, *, title, body, flair, op_comments):
            if title == "boom":
                raise RuntimeError("no")
            return {"status": "ok", "model": "m1", "fields_json": body}

    good = '{"is_niw_i140_decision":true,"outcome":"denied","law_firm_raw":"Raju","citations":{"value":0}}'
    posts = spark.createDataFrame([("1", "t", good), ("2", "boom", ""), ("3", "t", '{"is_niw_i140_decision":true}')], "id string, title string, selftext string")
    posts = classify.with_hash(posts.withColumns({"link_flair_text": F.lit(None).cast("string"), "op_comments": F.lit(None).cast("string")}))
    classify.register_backend("echo", Echo())
    rows = {r["post_id"]: r for r in classify.backend("echo")(posts, 9).collect()}
    assert (rows["1"]["status"], rows["1"]["law_firm_normalized"], rows["1"]["citations_known"], rows["1"]["run_key"]) == ("ok", "Raju Law", True, "echo/m1")
    assert rows["2"]["status"] == "failed" and "RuntimeError" in rows["2"]["failure_reason"] and rows["2"]["outcome"] is None
    assert rows["3"]["failure_reason"] == "decision without outcome"
    with pytest.raises(ValueError):
        classify.backend("nope")


def test_csv(spark):
    from test_records import make

    df = make(spark, {"id": "1", "citations": 3, "years_experience": 6.0, "permalink": "/p/", "premium_processing": False}).withColumns({"title": F.lit('a "b", c'), "rfe_date": F.lit(None).cast("string"), "rfe_response_date": F.lit(None).cast("string")})
    text = sinks.csv_text(df)
    assert text.startswith("﻿date,outcome") and text.endswith('2023-11-14,approved,,,,,3,,,6,,Regular,,,,,https://www.reddit.com/p/,"a ""b"", c"')


def test_walk_and_retries():
    posts = [{"id": str(i), "created_utc": t} for i, t in enumerate([1, 2, 2, 2, 3, 9, 10])]
    page = lambda a, b: [p for p in posts if a <= p["created_utc"] < b][:3]
    assert [p["id"] for p in archive_api.walk(page, 0, 10, page_size=3)] == ["0", "1", "2", "3", "4", "5"]
    answers, slept = [(429, {}, None), (200, {"X-RateLimit-Remaining": "1", "X-RateLimit-Reset": "7"}, {"data": [{"id": "x"}]})], []
    client = archive_api.Client("http://h", fetch=lambda u, p: answers.pop(0), sleep=slept.append, rate=0)
    assert client.get("/p", {}) == [{"id": "x"}] and slept[-1] == 7.0 and len(slept) == 2
    with pytest.raises(RuntimeError):
        archive_api.Client("http://h", fetch=lambda u, p: (404, {}, None), sleep=slept.append, rate=0).get("/p", {})
    with pytest.raises(RuntimeError):
        archive_api.Client("http://h", fetch=lambda u, p: (503, {}, None), sleep=slept.append, rate=0, retries=2).get("/p", {})


def test_streaming_ingest(spark, tmp_path):
    from docketlake.streaming.ingest import start_ingest

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "d.jsonl", "jsonl")
    args = (spark, f"file://{tmp_path}/in", f"file://{tmp_path}/w", f"file://{tmp_path}/c", "s", 1700001000)
    start_ingest(*args).awaitTermination()
    start_ingest(*args).awaitTermination()
    w = pipeline.Warehouse(spark, f"file://{tmp_path}/w")
    assert w.read("raw_posts").count() == 4 and w.read("classified_records").count() == 3
