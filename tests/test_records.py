from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docketlake.operators import comments, filters, records, stats, store, views
from docketlake.plans.pipeline import data_version

RECORD = (
    "id string, created_utc long, author string, permalink string, outcome string, degree string, field_normalized string, profession_normalized string, law_firm_normalized string, "
    "publications long, patents long, citations long, years_experience double, processing_days long, premium_processing boolean, was_rfed boolean, run string, classified_at long, prompt_version string, schema_version string"
)
NAMES = [c.split()[0] for c in RECORD.split(", ")]


def make(spark, *rows):
    base = {"created_utc": 1_700_000_000, "outcome": "approved", "run": "r1", "classified_at": 1, "prompt_version": "p3", "schema_version": "s3"}
    return spark.createDataFrame([tuple({"id": f"p{i}", **base, **r}.get(n) for n in NAMES) for i, r in enumerate(rows)], RECORD)


def chart(df, metric, hide=False):
    return [(r["label"], r["count"], r["approved"], r["denied"]) for r in stats.distribution(df, metric, hide).orderBy("ord").collect()]


def test_unknown_is_not_zero(spark):
    df = make(spark, {"citations": 0}, {"citations": None, "outcome": "denied"}, {"citations": 1500}, {"citations": 10})
    rows = chart(df, "citations")
    assert rows[0] == ("0", 1, 1, 0) and rows[1] == ("1–10", 1, 1, 0) and rows[8] == ("501+", 1, 1, 0) and rows[9] == ("Unknown", 1, 0, 1) and len(rows) == 10
    assert len(chart(df, "citations", True)) == 9
    s = stats.distribution_summary(df, ("citations",)).first()
    assert (s["unknown_count"], s["n"], s["total"]) == (1, 3, 4)


def test_long_tail(spark):
    rows = [{"law_firm_normalized": f"Firm{i}"} for i in range(12) for _ in range(20 - i)] + [{"law_firm_normalized": "Other"}, {"law_firm_normalized": None}]
    got = chart(make(spark, *rows), "law_firm")
    assert [g[0] for g in got] == [f"Firm{i}" for i in range(9)] + ["Other", "Unknown"]
    assert got[9][1] == 11 + 10 + 9 + 1


def test_few_categories_keep_other_last(spark):
    got = chart(make(spark, {"degree": "Other"}, {"degree": "Other"}, {"degree": "PhD"}), "degree")
    assert [g[0] for g in got] == ["PhD", "Other"]


def test_unknown_metric(spark):
    with pytest.raises(ValueError):
        stats.distribution(make(spark, {}), "nope")
    with pytest.raises(ValueError):
        stats.approval_rate_by(make(spark, {}), "nope")


def test_rates(spark):
    df = make(spark, {"degree": "PhD"}, {"degree": "PhD", "outcome": "denied"}, {"degree": None}, {"outcome": None})
    r = stats.approval_rate(df).first()
    assert (r["total"], r["approved"], r["denied"], r["total_decided"]) == (4, 2, 1, 3)
    assert stats.approval_rate(df.filter("outcome IS NULL")).first()["rate"] is None
    assert [(r["label"], r["n"], r["rate"]) for r in stats.approval_rate_by(df, "degree").orderBy("ord").collect()] == [("PhD", 2, 0.5), ("Unknown", 1, 1.0)]
    assert stats.approval_rate(df.filter("false")).first()["total"] == 0


def reference_vote(group):
    recency = lambda r: r["classified_at"] or 0
    by: dict = {}
    for r in group:
        by.setdefault(r["outcome"], []).append(r)
    best = max(by.values(), key=lambda rs: (len(rs), max(map(recency, rs)), rs[0]["outcome"] is None, [-ord(c) for c in rs[0]["outcome"] or ""]))
    return min(best, key=lambda r: (-recency(r), r["run"]))


def test_vote_against_plain_python(spark):
    rng = random.Random(1)
    rows = [{"id": f"p{rng.randrange(60)}", "run": f"r{i}", "outcome": rng.choice(["approved", "denied", None]), "classified_at": rng.choice([None, 1, 2, 3])} for i in range(400)]
    df = make(spark, *rows)
    groups: dict = {}
    for r in df.collect():
        groups.setdefault(r["id"], []).append(r.asDict())
    want = {k: reference_vote(g)["run"] for k, g in groups.items()}
    assert {r["id"]: r["run"] for r in views.select_view(df).collect()} == want
    assert {r["id"]: r["run"] for r in views.select_view(df.repartition(7)).collect()} == want


def test_single_run_and_versions(spark):
    df = make(spark, {"run": "a"}, {"run": "b"}, {"run": "b", "prompt_version": "p2"}, {"run": "c", "prompt_version": None, "schema_version": None})
    assert views.select_view(df, "b").count() == 2
    assert views.of_version(df, "p2/s3").count() == 2
    assert views.of_version(df, None).count() == 4


def reference_refile(rows):
    flags = {r["id"]: [None, None, None] for r in rows}
    for d in rows:
        if d["outcome"] != "denied" or d["author"] in (None, "", "[deleted]", "[removed]", "AutoModerator"):
            continue
        later = [a for a in rows if a["author"] == d["author"] and a["outcome"] == "approved" and a["created_utc"] > d["created_utc"]]
        if later:
            first = min(later, key=lambda a: (a["created_utc"], a["id"]))
            flags[d["id"]][:2] = [True, first["permalink"]]
            flags[first["id"]][2] = True
    return {k: tuple(v) for k, v in flags.items()}


def test_refiled_against_nested_loops(spark):
    rng = random.Random(2)
    rows = [{"id": f"p{i:03}", "author": rng.choice(["a", "b", "c", "[deleted]", None, ""]), "outcome": rng.choice(["approved", "denied", None]), "created_utc": rng.randrange(40), "permalink": f"/l{i}"} for i in range(300)]
    df = make(spark, *rows)
    got = {r["id"]: (r["refiled"], r["refiled_url"], r["refile_approval"]) for r in views.mark_refiled(df).collect()}
    assert got == reference_refile([r.asDict() for r in df.collect()])


def test_filters(spark):
    df = make(spark, {"created_utc": 10, "degree": "PhD", "citations": 5}, {"created_utc": 20, "degree": None, "citations": 50}, {"created_utc": 30, "degree": "MD"})
    assert filters.in_range(df, 10, 20).count() == 2 and filters.in_range(df).count() == 3
    assert filters.in_facets(df, {"degree": ["PhD", "Unknown"], "citations": []}).count() == 2
    assert filters.in_facets(df, {"degree": ["PhD", "Unknown"], "citations": ["31–50"]}).count() == 1
    assert filters.other_tail(df, "degree", ["PhD"]).count() == 1
    assert filters.in_quarters(df, ["1970-Q1"]).count() == 3 and filters.in_quarters(df, []).count() == 3
    assert [r["created_utc"] for r in filters.page(df, 1, 2).collect()] == [10]
    assert filters.window_from_range("3m", 90 * 86400) == (0, 90 * 86400)
    assert filters.resolve_window(None, "1970-01-02", "1970-01-02") == (86400, 2 * 86400 - 1)
    for bad in (lambda: filters.window_from_range("9m", 0), lambda: filters.resolve_window(None, "1970-13-01"), lambda: filters.page(df, -1)):
        with pytest.raises(ValueError):
            bad()


def test_series_and_options(spark):
    df = make(spark, {"created_utc": 0}, {"created_utc": 100 * 86400, "outcome": "denied", "degree": "PhD"})
    assert [(r["quarter"], r["rate"]) for r in stats.quarter_series(df).collect()] == [("1970-Q1", 1.0), ("1970-Q2", 0.0)]
    assert [r["quarter"] for r in stats.available_quarters(df).collect()] == ["1970-Q2", "1970-Q1"]
    assert [r["label"] for r in stats.distinct_values(df, "degree").orderBy("ord").collect()] == ["PhD", "Unknown"]
    assert {r["field"]: r["known"] for r in stats.completeness(df).collect()}["degree"] == 1


def test_slim_and_fingerprint(spark):
    df = make(spark, {"citations": 0}, {"citations": None}).withColumns({"selftext": F.lit("x"), "op_comments": F.lit("y")})
    public = records.slim(df, public=True)
    assert not {"selftext", "op_comments", "author"} & set(public.columns)
    assert sorted((r["citations"]["value"], r["citations"]["known"]) for r in public.collect() if r["citations"]["known"]) == [(0, True)]
    back = records.from_slim(records.slim(df)).select(*df.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    a = records.fingerprint(df).first()[0]
    assert len(a) == 16 and a == records.fingerprint(df.repartition(3)).first()[0] and a != records.fingerprint(df.withColumn("degree", F.lit("MD"))).first()[0]
    assert data_version("v", [], [], 1, a) != data_version("v", [], [], 2, a)


KV = "id string, created_utc long, title string, op_comments string, fetched_at long"


def test_merge(spark):
    old = spark.createDataFrame([("a", 1, "t", "c", 0), ("b", 2, "u", None, 0)], KV)
    new = spark.createDataFrame([("a", 9, "t2", "zz", 5), ("c", 3, "x", None, 5), ("c", 8, "y", None, 6)], KV)
    got = sorted(tuple(r) for r in store.upsert_posts(old, new).collect())
    assert got == [("a", 1, "t2", "c", 5), ("b", 2, "u", None, 0), ("c", 3, "y", None, 6)]
    assert tuple(store.merge_counts(old, new, ["id"]).first()) == (1, 1)
    assert tuple(store.merge_counts(old, new.filter("false"), ["id"]).first()) == (0, 0)


def test_clear(spark):
    df = spark.createDataFrame([("mock", "a", "m"), ("mock", "b", None), ("x", "a", "m")], "classifier_backend string, run_key string, classifier_model string")
    assert store.clear(df).count() == 0 and store.clear(df, backend="mock").count() == 1 and store.clear(df, backend="mock", model="m").count() == 2


def test_comments(spark):
    posts = spark.createDataFrame([("p", "op"), ("q", None)], "id string, author string")
    said = spark.createDataFrame(
        [("p", "1", "x", "how many?", "t3_p", 1), ("p", "2", "op", " 91 ", "t1_1", 2), ("p", "3", "op", "[deleted]", "t3_p", 3), ("p", "4", "op", "top", "t3_p", 4), ("p", "5", "z", "no", "t3_p", 5)],
        "post_id string, id string, author string, body string, parent_id string, created_utc long",
    )
    got = {r["id"]: r["op_comments"] for r in comments.op_comments(posts, said).collect()}
    assert got == {"p": "Parent comment (x): how many?\nOP reply: 91\n---\nOP comment: top", "q": ""}
    assert comments.op_comments(posts, said, cap=5).filter("id = 'p'").first()["op_comments"] == "Paren"


@pytest.mark.parametrize("backwards", [False, True])
def test_latest_per_key_decides_ties(spark, backwards):
    rows = [("k", 7, "b", 3), ("k", 7, "a", 4), ("k", 1, "d", 6), ("k", 1, "c", 5)]
    df = spark.createDataFrame(rows[::-1] if backwards else rows, "id string, at long, title string, created_utc long").coalesce(1)
    got = store.latest_per_key(df, ["id"], "at", ["created_utc"]).collect()
    assert [tuple(r) for r in got] == [("k", 7, "a", 5)]
    got = store.latest_per_key(df, ["id"], "at", ["created_utc"], ["created_utc"]).collect()
    assert [tuple(r) for r in got] == [("k", 7, "b", 5)]


def test_ingest_dedup_takes_the_first_in_the_file(spark, tmp_path):
    """Spark reads the larger file first, so neither partitions nor row order tell a row's place."""
    from docketlake.plans.queries import QUERIES

    columns = "id AS l_orderkey, CAST(1 AS INT) AS l_linenumber, {0} AS l_partkey, timestamp_seconds({0}) AS l_shipdate"
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, part, n in (("a", 1, 10), ("b", 2, 50_000)):
        spark.range(n).selectExpr(*columns.format(f"{part}L").split(", ", 3)).coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(folder / f"{name}.parquet")
    got = QUERIES["ingest_dedup"](spark, str(tmp_path)).filter("id < 10").select("title", "created_utc").distinct().collect()
    assert [tuple(r) for r in got] == [(1, 1)]


def test_ingest_dedup_skips_nulls_as_its_sql_does(spark, tmp_path):
    """Nulls count neither as text or time nor as an order; parts of a second are rounded, halves to even."""
    import duckdb

    from docketlake.plans.queries import ORACLES, QUERIES

    columns = "l_orderkey long, l_linenumber int, l_partkey long, s double"
    rows = [(1, 2, None, 5.0), (1, 1, 7, None), (1, None, 9, 1.0), (2, None, 8, 3.0), (3, 1, 4, -1.75), (4, 1, 4, 2.5), (5, 3, 6, 3.5), (5, 2, 3, None), (None, 1, 2, 9.25)]
    df = spark.createDataFrame(rows, columns).withColumn("l_shipdate", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).cast("timestamp_ntz"))
    df.drop("s").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    got = QUERIES["ingest_dedup"](spark, str(tmp_path)).select("id", "fetched_at", "title", "created_utc").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.execute(f"SELECT id, fetched_at, title, created_utc FROM ({ORACLES['ingest_dedup']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert (1, 2, 7, 5) in want and (2, None, None, None) in want and (3, 1, 4, -2) in want
