"""Ingest, classify and publish over a warehouse folder of Parquet tables.

A table is rewritten into a new version folder, and a pointer names the current
one; a job that dies leaves the old version in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.functions import pii
from docketlake.functions.derive import version_key
from docketlake.functions.prefilter import is_candidate, prefilter_reason
from docketlake.operators import classify, comments, records, store, views
from docketlake.schema import CLASSIFIED_SCHEMA, COMPOSITE, DAY, META_SCHEMA, PROMPT_VERSION, RAW_SCHEMA, SCHEMA_VERSION, STATE_SCHEMA

TABLES: dict[str, T.StructType] = {"raw_posts": RAW_SCHEMA, "classified_records": CLASSIFIED_SCHEMA, "ingest_state": STATE_SCHEMA, "meta": META_SCHEMA}
LOOK_BACK_DAYS, OVERLAP = 730, DAY


class Warehouse:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _current(self, table: str) -> str | None:
        pointer = f"{self.path}/{table}/_current"
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(pointer)
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return None
        names = self.spark.read.schema("seq long, version string").json(pointer).orderBy(F.desc("seq")).limit(1).collect()
        return f"{self.path}/{table}/{names[0]['version']}" if names else None

    def read(self, table: str) -> DataFrame:
        """The table with its full schema; columns that older files lack are null, a missing run key is derived."""
        schema, current = TABLES[table], self._current(table)
        df = self.spark.read.schema(schema).parquet(current) if current else self.spark.createDataFrame([], schema)
        if table == "classified_records":
            old = F.concat_ws("/", "classifier_backend", F.coalesce(F.nullif("classifier_model", F.lit("")), F.col("classifier_backend")))
            df = df.withColumn("run_key", F.coalesce("run_key", old))
        return df

    def write(self, table: str, df: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[table]]).write.parquet(f"{self.path}/{table}/{version}")
        pointer = f"{self.path}/{table}/_current"
        last = 0
        if self._current(table):
            last = self.spark.read.schema("seq long, version string").json(pointer).agg(F.max("seq")).first()[0] or 0
        self.spark.createDataFrame([(last + 1, version)], "seq long, version string").coalesce(1).write.mode("append").json(pointer)

    def mark(self) -> str:
        """Note the version of what is shown now, for conditional requests; every change of posts or records ends with this."""
        posts, classified = self.read("raw_posts"), self.read("classified_records")
        version = records.fingerprint(records.records(classified, posts), f"{posts.count()}|{classified.count()}").first()[0]
        if version != self.version():
            self.write("meta", store.set_meta(self.read("meta"), "data_version", version))
        return version

    def version(self) -> str | None:
        """The version noted last: one row, no aggregate."""
        rows = self.read("meta").filter("key = 'data_version'").select("value").collect()
        return rows[0][0] if rows else None

    def create(self) -> None:
        for table in TABLES:
            if not self._current(table):
                self.write(table, self.read(table))


def normalize_posts(raw: DataFrame, subreddit: str, source: str, fetched_at: int) -> DataFrame:
    """Valid posts with defaults, a rebuilt permalink and the pre-filter's verdict."""
    valid = (F.coalesce("id", F.lit("")) != "") & F.col("title").isNotNull() & F.col("created_utc").isNotNull()
    sub = F.coalesce(F.nullif("subreddit", F.lit("")), F.lit(subreddit))
    reason = prefilter_reason(F.col("title"), F.col("selftext"), F.col("link_flair_text"))
    columns = {
        "subreddit": sub, "permalink": F.concat(F.lit("/r/"), sub, F.lit("/comments/"), F.col("id"), F.lit("/")), "fetched_at": F.lit(fetched_at).cast("long"),
        "source": F.lit(source), "prefilter_reason": reason, "is_candidate": is_candidate(reason), "op_comments": F.lit(None).cast("string"),
    }
    return raw.filter(valid).withColumns(columns).select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA])


def ingest(warehouse: Warehouse, raw: DataFrame, subreddit: str, source: str, fetched_at: int, advance: bool = False) -> dict[str, int]:
    """Upsert posts by id; returns total, candidates, inserted, updated and max_created_utc."""
    from pyspark.sql import Observation

    seen = Observation("ingest")
    new = normalize_posts(raw, subreddit, source, fetched_at).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if("is_candidate").alias("candidates"), F.max("created_utc").alias("max_created_utc"))
    staging = f"{warehouse.path}/staging/{uuid.uuid4().hex}"
    new.write.parquet(staging)
    staged = warehouse.spark.read.schema(RAW_SCHEMA).parquet(staging)
    existing = warehouse.read("raw_posts")
    changed = store.merge_counts(existing, staged, ["id"]).first().asDict()
    warehouse.write("raw_posts", store.upsert_posts(existing, staged))
    if advance:
        warehouse.write("ingest_state", store.advance_watermark(warehouse.read("ingest_state"), staged, fetched_at))
    warehouse.mark()
    return {**seen.get, **changed}


def incremental_window(warehouse: Warehouse, subreddit: str, now: int, look_back_days: int = LOOK_BACK_DAYS, overlap: int = OVERLAP) -> tuple[int, int]:
    """From a day before the newest post so far, or the look-back, to now. Keyed upserts absorb the overlap."""
    state = warehouse.read("ingest_state").filter(F.col("subreddit") == subreddit).select("last_created_utc").collect()
    last = state[0][0] if state else None
    return (max(0, last - overlap), now) if last is not None else (now - look_back_days * DAY, now)


def due_comments(posts: DataFrame) -> DataFrame:
    """Candidates whose author's comments weren't gathered yet, or without the context that later versions add."""
    named = views.usable_author(F.col("author"))
    return posts.filter(F.col("is_candidate") & named & (F.col("op_comments").isNull() | comments.needs_refresh(F.col("op_comments"))))


def refresh_comments(warehouse: Warehouse, said: DataFrame) -> int:
    """Gather the authors' comments from ``said`` (COMMENT_SCHEMA) for the posts that are due; returns their number.

    A post without such comments gets an empty text, so it isn't asked for
    again. New text changes the content, so the post is classified again.
    """
    posts = warehouse.read("raw_posts")
    gathered = comments.op_comments(due_comments(posts), said)
    staging = f"{warehouse.path}/staging/{uuid.uuid4().hex}"
    gathered.write.parquet(staging)
    staged = warehouse.spark.read.schema(gathered.schema).parquet(staging)
    n = staged.count()
    if n:
        warehouse.write("raw_posts", store.set_op_comments(posts, staged))
        warehouse.mark()
    return n


def classify_pending(warehouse: Warehouse, now: int, backend: str = "mock", effort: str = "", label: str = "", limit: int | None = None, said: DataFrame | None = None) -> int:
    """Classify what this run hasn't in its present content; returns the number of rows written.

    The run is known by backend, model, effort and label before it starts, so
    runs of different settings stand side by side and each resumes its own
    work. Comments ``said`` are gathered first.
    """
    if said is not None:
        refresh_comments(warehouse, said)
    chosen = classify.backend(backend)
    posts, done = classify.with_hash(warehouse.read("raw_posts")), warehouse.read("classified_records")
    todo = store.pending(posts, chosen.own(done, effort, label), chosen.run_key(effort, label), PROMPT_VERSION, SCHEMA_VERSION, limit)
    rows = chosen(todo, now, effort, label)
    staging = f"{warehouse.path}/staging/{uuid.uuid4().hex}"
    rows.write.parquet(staging)
    staged = warehouse.spark.read.schema(CLASSIFIED_SCHEMA).parquet(staging)
    n = staged.count()
    if n:
        warehouse.write("classified_records", store.upsert_classified(done, staged))
        warehouse.mark()
    return n


def publish_problems(wire: DataFrame) -> list[str]:
    """Why wire rows must not be published: columns or hard identifiers."""
    return pii.publish_problems(wire, "id", F.concat_ws("\n", *[c for c, kind in wire.dtypes if kind == "string" and c not in ("id", "permalink", "run")]))


def build_snapshot(posts: DataFrame, classified: DataFrame, generated_at: int, public: bool = False, view: str = COMPOSITE, subreddit: str = "") -> tuple[dict, DataFrame]:
    """(envelope, wire rows) of all versions and runs; the envelope holds runs, versions and counts, a few rows each."""
    all_records = records.records(classified, posts)
    wire = records.slim(views.mark_refiled(all_records) if public else all_records, public)
    runs = [r.asDict() for r in store.list_runs(classified).collect()]
    versions = []
    for v in store.list_versions(classified).collect():
        own = [r for r in runs if (r["prompt_version"], r["schema_version"]) == (v["prompt_version"], v["schema_version"])]
        counts = store.counts(posts, classified, v["prompt_version"], v["schema_version"]).first().asDict()
        versions.append({"prompt_version": v["prompt_version"], "schema_version": v["schema_version"], "version_key": v["version_key"], "runs": own, **counts})
    counts = store.counts(posts, classified, PROMPT_VERSION, SCHEMA_VERSION, None if view == COMPOSITE else view).first().asDict()
    total = latest(all_records).first()
    content = records.fingerprint(all_records).first()[0]
    meta = {
        **counts, "subreddit": subreddit, "prompt_version": PROMPT_VERSION, "schema_version": SCHEMA_VERSION, "view_run": view,
        "runs": [r for r in runs if (r["prompt_version"], r["schema_version"]) == (PROMPT_VERSION, SCHEMA_VERSION)], "all_runs": runs, "versions": versions, "latest_post_utc": total["latest_post_utc"],
    }
    return {"data_version": data_version(view, versions, runs, total["n"], content), "generated_at": generated_at, "meta": meta}, wire


def data_version(view: str, versions: list[dict], runs: list[dict], n: int, content: str) -> str:
    """16 digits that change whenever shown data does."""
    import hashlib

    text = json.dumps({"active": [PROMPT_VERSION, SCHEMA_VERSION, view], "versions": versions, "runs": runs, "record_count": n, "content": content}, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def latest(all_records: DataFrame) -> DataFrame:
    """(latest_post_utc, n) of records; 0 without any."""
    return all_records.agg(F.coalesce(F.max("created_utc"), F.lit(0)).alias("latest_post_utc"), F.count(F.lit(1)).alias("n"))


def version_runs(classified: DataFrame) -> DataFrame:
    """(version_key, runs): runs by version, latest first."""
    rows = store.list_runs(classified).withColumn("version_key", version_key(F.col("prompt_version"), F.col("schema_version")))
    runs = F.sort_array(F.collect_list(F.struct("last_classified_at", "run_key", "ok", "excluded", "failed", "posts")), asc=False)
    return rows.groupBy("version_key").agg(runs.alias("runs"))


def dashboard(all_records: DataFrame, version: str | None = None, run: str = COMPOSITE) -> DataFrame:
    """Version, then vote or run, then re-file flags: the order that all further filters build on."""
    chosen = views.select_view(views.of_version(all_records, version), run)
    return views.mark_refiled(chosen) if views.has_usable_author(chosen) else views.with_given_flags(chosen)


def refresh(warehouse: Warehouse, raw: DataFrame, subreddit: str, source: str, now: int, out: str, public: bool = False) -> dict:
    """Ingest, classify and publish in one go."""
    from docketlake.sources.sinks import write_snapshot

    ingested = ingest(warehouse, raw, subreddit, source, now, advance=True)
    classified = classify_pending(warehouse, now)
    envelope, wire = build_snapshot(warehouse.read("raw_posts"), warehouse.read("classified_records"), now, public, subreddit=subreddit)
    if public and (problems := publish_problems(wire)):
        raise ValueError("; ".join(problems))
    write_snapshot(wire, envelope, out)
    return {**ingested, "classified": classified, "data_version": envelope["data_version"]}
