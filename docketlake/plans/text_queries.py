"""More registered queries: texts built from customers' numbers, so that the SQL knows the answer by arithmetic or by literal values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions import derive, extract, jsonx, pii, taxonomy
from docketlake.operators import comments, filters, records, store
from docketlake.operators.classify import Backend, heuristic_rows, with_hash
from docketlake.plans import pipeline
from docketlake.plans.queries import BASE, CLASSIFIED_SQL, POSTS_SQL, VOTE_SQL, _E, _m, _stories, _story_sql, bound_classified, bound_posts, bound_records, bound_view, query, table
from docketlake.sources import dumps


def _k() -> Column:
    """The customer's number; Columns need a session, so none is made on import."""
    return F.col("c_custkey")


def _k_text() -> Column:
    return _k().cast("string")



def customers(s, d) -> DataFrame:
    return table(s, d, "customer").select("c_custkey")


def pick(*values: str | None, step: int = 1) -> Column:
    """One of the values, by the customer's number."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (F.floor(_k() / step) % len(values) + 1).cast("int"))


def pick_sql(*values: str | None, step: int = 1) -> str:
    listed = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[(c_custkey // {step}) % {len(values)} + 1]"


# ---- labels, against literal values -----------------------------------------

FIELDS = {
    "Machine Learning": "CS/AI", "VLSI circuits": "EE/Hardware", "cloud security": "Software/Systems", "Clinical oncology": "Biomedical/Medicine", "ai/robotics": "CS/AI", "Quantum optics": "Physics", "chemical engineering": "Chemistry",
    "polymer metallurgy": "Materials", "applied math": "Math/Stats", "Actuarial finance": "Economics/Finance", "petroleum geology": "Environmental/Energy", "Education": "Social Sciences", "Poetry": "Other", "email marketing": "Other", "": None,
}
PROFESSIONS = {
    "PhD student in physics": "PhD Student", "Asst. Professor": "Professor/Faculty", "ML Engineer": "Data Scientist/Engineer", "Senior SWE": "Software Engineer", "Post-Doc": "Postdoc/Researcher", "Resident physician": "Physician/Clinician",
    "Civil Engineer": "Engineer (other)", "Founder & CEO": "Entrepreneur/Founder", "MSc": "Student (other)", "Cook": "Other", "N/A": None, "": None,
}
FIRMS = {"self-petitioned": "DIY/Self-petition", "WeGreened (Chen)": "Chen/WeGreened", "EP": "Ellis Porter", "Raju Law Firm": "Raju Law", "C & H": "Colombo & Hurd", "Peak Immigration": "Peak Immigration", "ABC Legal, PLLC": "ABC", "none": None, "": None}


@query("labels_literal", "SELECT c_custkey, " + ", ".join(f"{pick_sql(*v.values())} AS {n}" for n, v in (("field", FIELDS), ("profession", PROFESSIONS), ("firm", FIRMS))) + " FROM customer")
def labels_literal(s, d):
    return customers(s, d).select("c_custkey", taxonomy.field_label(pick(*FIELDS)).alias("field"), taxonomy.profession_label(pick(*PROFESSIONS)).alias("profession"), taxonomy.law_firm_label(pick(*FIRMS)).alias("firm"))


@query("renormalize", f"SELECT c_custkey::VARCHAR AS post_id, {pick_sql(*FIELDS.values())} AS field_normalized, {pick_sql(*PROFESSIONS.values())} AS profession_normalized, {pick_sql(*FIRMS.values())} AS law_firm_normalized FROM customer")
def renormalize(s, d):
    stale = customers(s, d).select(_k_text().alias("post_id"), pick(*FIELDS).alias("field_raw"), pick(*PROFESSIONS).alias("profession_raw"), pick(*FIRMS).alias("law_firm_raw"), *[F.lit("old").alias(c) for c in ("field_normalized", "profession_normalized", "law_firm_normalized")])
    return store.renormalize(stale).select("post_id", "field_normalized", "profession_normalized", "law_firm_normalized")


REASONS = {
    ("My case", "approved soon", " approved "): "flair:APPROVED", ("I-485 approved", "", None): "excluded:i485", ("i485 and niw approved", "", "Question"): "kw:title", ("NVC visa interview approved", "", ""): "excluded:nvc",
    ("My case", "my petition got approved in 88 days", ""): "kw:body", ("My case", "I-485 was approved today", None): "excluded:i485", ("My case", "[removed]", "Question"): "no_signal", ("Approval rates?", None, "Denial"): "flair:DENIAL",
}


@query("prefilter_literal", f"SELECT c_custkey, {pick_sql(*REASONS.values())} AS reason FROM customer")
def prefilter_literal(s, d):
    from docketlake.functions.prefilter import prefilter_reason

    return customers(s, d).select("c_custkey", prefilter_reason(*[pick(*[r[i] for r in REASONS]) for i in range(3)]).alias("reason"))


@query("classify_status", f"""WITH {_story_sql()}, u AS (SELECT *, CASE WHEN {_m('text', _E.DENIED)} THEN 'denied' WHEN {_m('text', _E.APPROVED)} THEN 'approved' END AS o FROM t),
  v AS (SELECT *, o IS NOT NULL AND {_m('text', _E.CONTEXT)} AND NOT {_m('text', _E.OTHER_FORM)} AS decision FROM u)
  SELECT c_custkey::VARCHAR AS post_id, sha256('case' || chr(10) || text || chr(10) || chr(10)) AS content_hash, 'mock/mock@high#x' AS run_key, CASE WHEN decision THEN 'ok' ELSE 'excluded' END AS status, CASE WHEN decision THEN o END AS outcome, TRUE AS body_available, 7::BIGINT AS classified_at FROM v""")
def classify_status(s, d):
    nothing = F.lit(None).cast("string")
    posts = _stories(s, d).select(_k_text().alias("id"), F.lit("case").alias("title"), F.col("text").alias("selftext"), nothing.alias("link_flair_text"), nothing.alias("op_comments"))
    return heuristic_rows(with_hash(posts), 7, "high", "x").select("post_id", "content_hash", "run_key", "status", "outcome", "body_available", "classified_at")


# ---- prompts and texts ------------------------------------------------------

BODIES, FLAIRS, SAID = ("a body", "[removed]", "", None), ("Approved", "", None), (" said ", "", None)


def _parts() -> list[Column]:
    return [F.concat(F.lit("case "), _k_text()), pick(*BODIES), pick(*FLAIRS, step=2), pick(*SAID, step=3)]


_PARTS_SQL = f"t AS (SELECT c_custkey, 'case ' || c_custkey AS title, {pick_sql(*BODIES)} AS body, {pick_sql(*FLAIRS, step=2)} AS flair, trim(coalesce({pick_sql(*SAID, step=3)}, '')) AS said FROM customer)"


@query("user_prompt", f"""WITH {_PARTS_SQL} SELECT c_custkey, 'Flair: ' || coalesce(nullif(flair, ''), 'none') || chr(10) || 'Title: ' || title || chr(10) || chr(10) || 'Body:' || chr(10) || CASE WHEN body = 'a body' THEN body ELSE '[body unavailable]' END
  || CASE WHEN said <> '' THEN chr(10) || chr(10) || 'OP''s own comments on this post, sometimes with parent-comment context (authoritative detail about the same case):' || chr(10) || said ELSE '' END || chr(10) || chr(10) || 'Extract the structured data as a single JSON object.' AS prompt FROM t""")
def user_prompt(s, d):
    title, body, flair, said = _parts()
    return customers(s, d).select("c_custkey", derive.user_prompt(title, body, flair, said).alias("prompt"))


@query("source_text", f"""WITH {_PARTS_SQL} SELECT c_custkey, 'TITLE: ' || title || CASE WHEN flair <> '' THEN chr(10) || 'FLAIR: ' || flair ELSE '' END || chr(10) || chr(10) || coalesce(nullif(body, ''), '[body unavailable]')
  || CASE WHEN said <> '' THEN chr(10) || chr(10) || 'OP COMMENTS:' || chr(10) || said ELSE '' END AS shown FROM t""")
def source_text(s, d):
    title, body, flair, said = _parts()
    return customers(s, d).select("c_custkey", derive.source_text(title, flair, body, said).alias("shown"))


@query("durations_and_times", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '—' WHEN c_custkey * 7 >= 3600 THEN (c_custkey * 7 // 3600) || 'h' || lpad((c_custkey * 7 % 3600 // 60)::VARCHAR, 2, '0') || 'm'
  WHEN c_custkey * 7 >= 60 THEN (c_custkey * 7 // 60) || 'm' || lpad((c_custkey * 7 % 60)::VARCHAR, 2, '0') || 's' ELSE (c_custkey * 7) || 's' END AS took, strftime(make_timestamp(c_custkey * 1000003 * 1000000), '%Y-%m-%d %H:%M') AS at_utc, round(c_custkey % 101 / 100.0 * 100)::INT AS percent FROM customer""")
def durations_and_times(s, d):
    seconds = F.when(_k() % 10 != 0, _k() * 7)
    return customers(s, d).select("c_custkey", derive.duration_text(seconds).alias("took"), derive.utc_text(_k() * 1000003).alias("at_utc"), derive.percent(_k() % 101 / 100).alias("percent"))


@query("usage_limit", f"SELECT c_custkey, c_custkey % 5 < 3 AS hit, CASE WHEN c_custkey % 5 = 0 THEN 1700000000 + c_custkey END::BIGINT AS reset_epoch FROM customer")
def usage_limit(s, d):
    text = F.when(_k() % 5 == 0, F.concat(F.lit("Usage limit reached|"), (_k() + 1700000000).cast("string"))).otherwise(pick("x", "Your limit will reset soon", "5-HOUR LIMIT", "delimit reach", "done"))
    found = extract.usage_limit(text)
    return customers(s, d).select("c_custkey", found["hit"].alias("hit"), found["reset_epoch"].alias("reset_epoch"))


# ---- contract and answers ---------------------------------------------------

ANSWERS = {
    '{"is_niw_i140_decision":true,"outcome":"denied","citations":{"value":3}}': "",
    '{"is_niw_i140_decision":true}': "decision without outcome",
    '{"is_niw_i140_decision":false,"outcome":"maybe"}': "outcome",
    '{"is_niw_i140_decision":false,"degree":"BA","extra":1}': "unknown key,degree",
    '{"is_niw_i140_decision":false,"timeline":{"receipt_date":"2023-02-30","processing_days":-1}}': "receipt_date,processing_days",
    '{"outcome":"approved"}': "is_niw_i140_decision",
}


@query("contract_violations", f"SELECT c_custkey, {pick_sql(*ANSWERS.values())} AS broken FROM customer")
def contract_violations(s, d):
    return customers(s, d).select("c_custkey", F.array_join(jsonx.violations(pick(*ANSWERS)), ",").alias("broken"))


@query("tool_answers", "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN c_custkey END::BIGINT AS n, CASE WHEN c_custkey % 4 = 0 THEN c_custkey / 4.0 END::DOUBLE AS cost FROM customer")
def tool_answers(s, d):
    one = F.concat(F.lit('{"n":'), _k_text(), F.lit("}"))
    quoted = F.concat(F.lit('{\\"n\\": '), _k_text(), F.lit("}"))
    out = (
        F.when(_k() % 4 == 0, F.concat(F.lit('{"structured_output":'), one, F.lit(',"result":"no","total_cost_usd":'), (_k() / 4).cast("string"), F.lit("}")))
        .when(_k() % 4 == 1, F.concat(F.lit('{"result":"So: '), quoted, F.lit('"}')))
        .when(_k() % 4 == 2, F.concat(F.lit("```json\n"), one, F.lit("\n```")))
        .otherwise("no answer")
    )
    return customers(s, d).select("c_custkey", F.try_variant_get(jsonx.envelope_answer(out), "$.n", "long").alias("n"), jsonx.envelope_cost(out).alias("cost"))


# ---- personal data: the text is built around what must be found -------------

_ID4 = "lpad((c_custkey % 10000)::VARCHAR, 4, '0')"
PII_SQL = {
    "ssn": f"'123-45-' || {_ID4}", "uscis_receipt": f"'ioe 091234' || {_ID4}", "a_number": f"'A-21234' || {_ID4}", "google_scholar": "'scholar.google.co.uk/citations?user=' || c_custkey",
    "orcid": f"'orcid.org/0000-0002-1825-' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || 'X'", "researchgate": "'ResearchGate.net/profile/A-' || c_custkey", "linkedin": "'linkedin.com/in/p-' || c_custkey",
    "phone": f"'(415) 555-' || {_ID4}", "other_profile": "'x.com/u' || c_custkey", "github_profile": "'github.com/u' || c_custkey || '/r.x'", "email": "'a.b+' || c_custkey || '@mail.example.org'",
}


def _planted(s, d) -> DataFrame:
    four = F.lpad((_k() % 10000).cast("string"), 4, "0")
    parts = {
        "ssn": F.concat(F.lit("123-45-"), four), "uscis_receipt": F.concat(F.lit("ioe 091234"), four), "a_number": F.concat(F.lit("A-21234"), four), "google_scholar": F.concat(F.lit("scholar.google.co.uk/citations?user="), _k_text()),
        "orcid": F.concat(F.lit("orcid.org/0000-0002-1825-"), F.lpad((_k() % 1000).cast("string"), 3, "0"), F.lit("X")), "researchgate": F.concat(F.lit("ResearchGate.net/profile/A-"), _k_text()), "linkedin": F.concat(F.lit("linkedin.com/in/p-"), _k_text()),
        "phone": F.concat(F.lit("(415) 555-"), four), "other_profile": F.concat(F.lit("x.com/u"), _k_text()), "github_profile": F.concat(F.lit("github.com/u"), _k_text(), F.lit("/r.x")), "email": F.concat(F.lit("a.b+"), _k_text(), F.lit("@mail.example.org")),
    }
    text = F.concat_ws(" ; ", *[F.when(_k() % (i + 2) == 0, F.concat(F.lit("see "), v, F.lit(" ok"))) for i, v in enumerate(parts.values())], F.lit("1234567-89-01234 12345"))
    return customers(s, d).select("c_custkey", text.alias("text"))


_FOUND_SQL = " UNION ALL ".join(f"SELECT c_custkey, '{k}' AS kind, {v} AS found FROM customer WHERE c_custkey % {i + 2} = 0" for i, (k, v) in enumerate(PII_SQL.items()))


@query("pii_all_kinds", _FOUND_SQL)
def pii_all_kinds(s, d):
    return pii.find(_planted(s, d), "c_custkey", F.col("text"))


@query("pii_all_counts", " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM customer WHERE c_custkey % {i + 2} = 0" for i, k in enumerate(PII_SQL)))
def pii_all_counts(s, d):
    return pii.counts(_planted(s, d), F.col("text"))


@query("pii_redacted", f"""WITH f AS ({_FOUND_SQL}), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY c_custkey, found) AS rank FROM f)
  SELECT kind, rank::INT AS rank, c_custkey, CASE WHEN kind IN ('email', 'phone', 'ssn', 'a_number') THEN left(found, 2) || '…' || right(found, 2) ELSE found END AS shown FROM r WHERE rank <= 6""")
def pii_redacted(s, d):
    return pii.samples(_planted(s, d), "c_custkey", F.col("text"))


@query("author_counts", f"WITH {POSTS_SQL} SELECT count(DISTINCT author) FILTER (WHERE author <> '[deleted]') AS authors, count(*) FILTER (WHERE author = '[deleted]') AS deleted_authors, count(*) FILTER (WHERE selftext = '[removed]') AS removed_bodies FROM posts")
def author_counts(s, d):
    return pii.author_counts(bound_posts(s, d))


# ---- ingest -----------------------------------------------------------------


@query("dump_submissions", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 4 = 0 THEN 't \"' || c_custkey || '\"' END AS title, c_custkey AS created_utc FROM customer WHERE c_custkey % 4 IN (0, 3)")
def dump_submissions(s, d):
    """A quarter each: a post, a broken line, a comment, and a post whose title is null."""
    line = (
        F.when(_k() % 4 == 0, F.to_json(F.struct(_k_text().alias("id"), F.concat(F.lit('t "'), _k_text(), F.lit('"')).alias("title"), (_k() + 0.25).alias("created_utc"))))
        .when(_k() % 4 == 1, F.concat(F.lit('{"id":"'), _k_text(), F.lit('","title":')))
        .when(_k() % 4 == 2, F.to_json(F.struct(_k_text().alias("id"), F.lit("c").alias("body"))))
        .otherwise(F.concat(F.lit('{"id":"'), _k_text(), F.lit('","title":null,"created_utc":'), _k_text(), F.lit("}")))
    )
    return dumps.posts(dumps.submissions(dumps.parsed(customers(s, d).select(line.alias("value"))))).select("id", "title", "created_utc")


@query("normalize_posts", f"""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 's' END AS subreddit, '/r/' || CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE 's' END || '/comments/' || c_custkey || '/' AS permalink,
  9::BIGINT AS fetched_at, 'dump' AS source, CASE WHEN c_custkey % 2 = 0 THEN 'kw:title' ELSE 'no_signal' END AS prefilter_reason, c_custkey % 2 = 0 AS is_candidate FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0""")
def normalize_posts(s, d):
    """Every fifth has no title and every seventh no time: not posts."""
    text = lambda c: c.cast("string")
    raw = customers(s, d).select(
        _k_text().alias("id"), F.when(_k() % 3 == 0, "other").when(_k() % 3 == 1, "").alias("subreddit"), F.when(_k() % 5 != 0, F.when(_k() % 2 == 0, "NIW approved").otherwise("hello")).alias("title"), F.when(_k() % 7 != 0, _k()).alias("created_utc"),
        *[text(F.lit(None)).alias(c) for c in ("selftext", "link_flair_text", "author", "url", "raw_json")], *[F.lit(None).cast("long").alias(c) for c in ("score", "num_comments")],
    )
    return pipeline.normalize_posts(raw, "s", "dump", 9).select("id", "subreddit", "permalink", "fetched_at", "source", "prefilter_reason", "is_candidate")


@query("comment_refresh", f"WITH {POSTS_SQL} SELECT id FROM posts WHERE is_candidate AND author <> '[deleted]' AND (id::BIGINT // 32) % 4 IN (0, 1)")
def comment_refresh(s, d):
    """Orders' comments by turn: none yet, old ones, none said, and with context."""
    n = F.floor(F.col("id").cast("long") / 32) % 4
    said = F.when(n == 1, "plain").when(n == 2, "").when(n == 3, "Parent comment (x): y\nOP reply: z")
    return pipeline.due_comments(bound_posts(s, d).withColumn("op_comments", said)).select("id")


@query("run_identity", f"""WITH {POSTS_SQL}, {CLASSIFIED_SQL} SELECT id, title FROM posts WHERE is_candidate AND id NOT IN (SELECT post_id FROM cls WHERE run_key = 'm2' AND prompt_version = 'p3')""")
def run_identity(s, d):
    """What a run that is known by its settings has still to do, whatever other runs did."""
    run = Backend("b", "m2", heuristic_rows)
    done = bound_classified(s, d).withColumns({"content_hash": F.lit("h"), "run_key": F.concat(F.lit("b/"), F.col("classifier_model"), F.lit("@high"))})
    todo = store.pending(bound_posts(s, d).withColumn("content_hash", F.lit("h")), run.own(done, "high"), run.run_key("high"), "p3", "s3")
    return todo.select("id", "title")


@query("meta_values", "SELECT n_name AS key, CASE WHEN n_nationkey = 3 THEN 'new' ELSE n_nationkey::VARCHAR END AS value FROM nation UNION ALL SELECT 'data_version', 'v1'")
def meta_values(s, d):
    nation = table(s, d, "nation")
    meta = nation.select(F.col("n_name").alias("key"), F.col("n_nationkey").cast("string").alias("value"))
    third = nation.filter("n_nationkey = 3").select("n_name").first()[0]
    return store.set_meta(store.set_meta(meta, "data_version", "v1"), third, "new")


@query("latest_post", f"{BASE} SELECT max(created_utc) AS latest_post_utc, count(*) AS n FROM rec")
def latest_post(s, d):
    return pipeline.latest(bound_records(s, d))


# ---- output -----------------------------------------------------------------


@query("public_slim", f"{BASE} SELECT id, run, title, outcome, field_normalized AS field, citations, classified_at FROM rec JOIN (SELECT id AS pid, title FROM posts) ON pid = id")
def public_slim(s, d):
    wire = records.slim(bound_records(s, d), public=True)
    if leaked := {"selftext", "op_comments", "author"} & set(wire.columns):
        raise ValueError(f"personal columns: {sorted(leaked)}")
    return wire.select("id", "run", "title", "outcome", "field", F.col("citations.value").alias("citations"), "classified_at")


@query("last_page", f"{BASE}, {VOTE_SQL}, n AS (SELECT count(*) AS n FROM voted) SELECT id, outcome FROM (SELECT *, row_number() OVER (ORDER BY created_utc DESC, id) AS r FROM voted) WHERE r > (SELECT (n - 1) // 25 * 25 FROM n)")
def last_page(s, d):
    return filters.page(bound_view(s, d), 10**9).select("id", "outcome")


@query("comment_ids", "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE conv_id || 'x_' || turn END AS id FROM conversations")
def comment_ids(s, d):
    reference = F.when(F.col("turn") % 3 != 0, F.concat(F.lit("t1_"), F.col("conv_id").cast("string"), F.lit("x_"), F.col("turn").cast("string"))).otherwise("")
    return table(s, d, "conversations").select("conv_id", "turn", F.coalesce(comments.comment_id(reference), F.lit("")).alias("id"))
