from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docketlake.functions import derive, extract, jsonx, pii, prefilter, taxonomy

FIELDS = [("Machine Learning and NLP", "CS/AI"), ("distributed systems", "Software/Systems"), ("VLSI", "EE/Hardware"), ("genomics", "Biology"), ("Public Health", "Biomedical/Medicine"), ("catalysis", "Chemistry"), ("polymer science", "Materials"), ("quantum", "Physics"), ("poetry", "Other"), ("", None), (None, None)]
PROFESSIONS = [
    ("PhD candidate", "PhD Student"), ("tenure-track faculty", "Professor/Faculty"), ("Data Scientist", "Data Scientist/Engineer"), ("Project Developer at a water company", "Engineer (other)"), ("Sr. SWE", "Software Engineer"),
    ("Post-doc", "Postdoc/Researcher"), ("nurse", "Physician/Clinician"), ("civil engineer", "Engineer (other)"), ("founder", "Entrepreneur/Founder"), ("supply chain", "Finance/Business"), ("undergrad", "Student (other)"), ("chef", "Other"), ("N/A", None), ("unknown", None), (None, None),
]
FIRMS = [
    ("self-petition", "DIY/Self-petition"), ("WeGreened", "Chen/WeGreened"), ("EP", "Ellis Porter"), ("raju law", "Raju Law"), ("C&H", "Colombo & Hurd"), ("Ashoori Law Firm", "Ashoori"), ("Ashoori", "Ashoori"), ("ABC Legal PLLC", "ABC"),
    ("Law Offices", "Law Offices"), ("BIG LLC law group", "BIG"), ("not mentioned", None), ("", None),
]


@pytest.mark.parametrize(("rule", "cases"), [(taxonomy.field_label, FIELDS), (taxonomy.profession_label, PROFESSIONS), (taxonomy.law_firm_label, FIRMS)])
def test_labels(spark, rule, cases):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string")
    got = {r["i"]: r["label"] for r in df.select("i", rule(F.col("raw")).alias("label")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


POSTS = [
    ("hello", "text", " approved ", "flair:APPROVED"), ("I-140 Approved", None, None, "kw:title"), ("I-485 approved", "", None, "excluded:i485"), ("i 485 and NIW approved", "", None, "kw:title"), ("Consular visa interview approved", "", None, "excluded:nvc"),
    ("Question", "my petition was approved", None, "kw:body"), ("Question", "my case: I-485 was approved", None, "excluded:i485"), ("Question", "the approval process", None, "no_signal"), ("Question", "[removed]", None, "no_signal"), (None, None, None, "no_signal"),
    ("x", "approved in 88 days", None, "kw:body"), ("x", "denied without an RFE", None, "kw:body"), ("x", "my i 140 approved", None, "kw:body"),
]


def test_prefilter(spark):
    df = spark.createDataFrame([(i, *p[:3]) for i, p in enumerate(POSTS)], "i int, t string, b string, f string")
    got = {r["i"]: (r["r"], r["c"]) for r in df.select("i", prefilter.prefilter_reason(F.col("t"), F.col("b"), F.col("f")).alias("r")).withColumn("c", prefilter.is_candidate(F.col("r"))).collect()}
    assert got == {i: (p[3], p[3].startswith(("kw:", "flair:"))) for i, p in enumerate(POSTS)}


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_counts_tell_zero_from_unknown(spark):
    count = lambda text: one(spark, extract.count_before(F.lit(text), extract.CITATIONS))
    assert [count(t) for t in ("no citations", "zero citations", "12+ citations", "many citations", "99999999999999999999 citations")] == [0, 0, 12, None, None]


def test_timeline_and_flags(spark):
    t = one(spark, extract.timeline(F.lit("approved in 88 days, premium processing, no RFE")))
    assert (t["processing_days"], t["processing_source"], t["premium_processing"], t["was_rfed"]) == (88, "stated_duration", True, False)
    t = one(spark, extract.timeline(F.lit("RD: 2023-01-01 AD: 2023-03-02")))
    assert (t["receipt_date"], t["decision_date"], t["processing_source"]) == ("2023-01-01", "2023-03-02", "dates")
    assert one(spark, extract.timeline(F.lit("decision in 3 months")))["processing_days"] == 90


def test_heuristic_gate(spark):
    f = one(spark, extract.heuristic_extract(F.lit("NIW approved"), F.lit("PhD in machine learning, 5 papers"), F.lit(None)))
    assert (f["is_niw_i140_decision"], f["outcome"], f["degree"], f["field_raw"], f["publications"]["value"], f["citations"]["known"]) == (True, "approved", "PhD", "machine learning", 5, False)
    f = one(spark, extract.heuristic_extract(F.lit("I-485 approved"), F.lit("NIW")))
    assert (f["is_niw_i140_decision"], f["outcome"]) == (False, None)


@pytest.mark.parametrize(("text", "want"), [('{"a":1}', 1), ('Here:\n```json\n{"a":2}\n```', 2), ('so {"a":3} then', 3), ("[1]", None), ("no", None), ("", None), ("{bad}", None)])
def test_json_object(spark, text, want):
    assert one(spark, F.try_variant_get(jsonx.extract_json_object(F.lit(text)), "$.a", "long")) == want


def test_contract(spark):
    check = lambda text: one(spark, jsonx.violations(F.lit(text)))
    assert check('{"is_niw_i140_decision":true,"outcome":"approved","citations":{"value":0,"known":false},"timeline":{"receipt_date":"2024-01-05"}}') == []
    assert check('{"is_niw_i140_decision":true}') == ["decision without outcome"]
    assert check('{"is_niw_i140_decision":false,"extra":1}') == ["unknown key"]
    assert check('{"is_niw_i140_decision":false,"timeline":{"receipt_date":"2024-1-5","processing_days":-1}}') == ["receipt_date", "processing_days"]
    assert "not an object" in check("nonsense")
    parsed = one(spark, jsonx.parse_extracted(F.lit('{"is_niw_i140_decision":false,"citations":{"value":0,"known":false}}')))
    assert parsed["citations"]["known"] is True


def test_usage_limit(spark):
    u = one(spark, extract.usage_limit(F.lit("usage limit reached, 1700000000")))
    assert (u["hit"], u["reset_epoch"]) == (True, 1700000000)
    assert one(spark, extract.usage_limit(F.lit("fine 1700000000")))["reset_epoch"] is None


def test_pii(spark):
    text = "a@b.co 212-555-1234 (212) 555-1234 123-45-6789 IOE1234567890 A12345678 linkedin.com/in/x"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    found = {(r["kind"], r["found"]) for r in pii.find(df, "id", F.col("t")).collect()}
    assert {("email", "a@b.co"), ("phone", "212-555-1234"), ("ssn", "123-45-6789"), ("uscis_receipt", "IOE1234567890"), ("a_number", "A12345678"), ("linkedin", "linkedin.com/in/x")} <= found
    assert {r["kind"]: r["n"] for r in pii.counts(df, F.col("t")).collect()}["phone"] == 2
    assert any("hard identifiers" in p for p in pii.publish_problems(df, "id", F.col("t")))
    assert pii.publish_problems(df.filter("id = 2"), "id", F.col("t")) == []


def test_derived(spark):
    assert one(spark, derive.run_key(F.lit("b"), F.lit(""), F.lit("high"), F.lit(None))) == "b/b@high"
    assert one(spark, derive.quarter_key(F.lit(1700000000))) == "2023-Q4"
    assert [one(spark, derive.bin_label(F.lit(v), "citations")) for v in (0, 10, 11, 500, 501, -3)] == ["0", "1–10", "11–20", "201–500", "501+", "501+"]
    assert [one(spark, derive.infer_premium(F.lit(None).cast("boolean"), F.lit(d), F.lit(r).cast("boolean"))) for d, r in ((91, None), (90, None), (200, True), (None, None))] == [False, None, None, None]
    assert [one(spark, derive.duration_text(F.lit(s))) for s in (5, 184, 3720)] == ["5s", "3m04s", "1h02m"]
    import hashlib

    want = hashlib.sha256(b"t\n\n\nc").hexdigest()
    assert one(spark, derive.content_hash(F.lit(" t "), F.lit(None), F.lit(""), F.lit("c\n"))) == want


def test_utc_text_beyond_four_digits(spark):
    df = spark.sql("SELECT * FROM VALUES (0L), (253402300799L), (253402300800L), (900000L * 1000003L) AS v(e)").orderBy("e")
    assert [r[0] for r in df.select(derive.utc_text(F.col("e"))).collect()] == ["1970-01-01 00:00", "9999-12-31 23:59", "10000-01-01 00:00", "30489-12-12 22:00"]
