"""Command line: python -m docketlake.cli COMMAND --warehouse PATH ..."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import functions as F

from docketlake.functions import pii
from docketlake.operators import stats, store, views
from docketlake.operators.filters import in_range, resolve_window
from docketlake.operators.records import records, slim
from docketlake.operators.views import mark_refiled
from docketlake.plans import pipeline
from docketlake.schema import COMPOSITE, PROMPT_VERSION, SCHEMA_VERSION
from docketlake.session import build_session, ship_package

COMMANDS = ("init-db", "backfill", "load-dump", "ingest", "classify", "renormalize", "runs", "clear-classifications", "snapshot", "status", "refresh", "stats", "serve", "comments", "audit")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docketlake", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--warehouse", required=True)
    p.add_argument("--subreddit", default="posts")
    p.add_argument("--dump")
    p.add_argument("--api-url")
    p.add_argument("--days", type=int, default=pipeline.LOOK_BACK_DAYS)
    p.add_argument("--slices", type=int, default=8)
    p.add_argument("--backend", default=None)
    p.add_argument("--run-key")
    p.add_argument("--model")
    p.add_argument("--effort", default="")
    p.add_argument("--label", default="")
    p.add_argument("--comments", help="a dump of comments, gathered before classifying")
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--out", default=None)
    p.add_argument("--public", action="store_true")
    p.add_argument("--range", default="all")
    p.add_argument("--port", type=int, default=8000)
    p.add_argument("--now", type=int, default=None)
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    if a.limit < 0:
        raise SystemExit("--limit can't be negative")
    spark = spark or build_session()
    ship_package(spark)
    now = a.now if a.now is not None else int(time.time())
    w = pipeline.Warehouse(spark, a.warehouse)

    def from_api(after: int, before: int):
        from docketlake.sources.archive_api import PostArchive
        from docketlake.sources.dumps import posts

        spark.dataSource.register(PostArchive)
        options = {"url": a.api_url, "subreddit": a.subreddit, "after": after, "before": before, "slices": a.slices}
        lines = spark.read.format("post_archive").options(**options).load()
        return posts(lines.select("raw_json", F.try_parse_json("raw_json").alias("v")))

    def from_dump():
        from docketlake.sources.dumps import posts, read_dump, submissions

        return posts(submissions(read_dump(spark, a.dump)))

    def said():
        """Comments from a dump, or from the archive for the posts that are due; None if neither is named."""
        from docketlake.sources.dumps import comments, read_dump

        if a.comments:
            return comments(read_dump(spark, a.comments))
        if not a.api_url:
            return None
        from docketlake.sources.archive_api import PostArchive

        ids = [r["id"] for r in pipeline.due_comments(w.read("raw_posts")).select("id").toLocalIterator()]  # one request each, at the archive's rate
        if not ids:
            return None
        spark.dataSource.register(PostArchive)
        lines = spark.read.format("post_archive").options(table="comments", url=a.api_url, subreddit=a.subreddit, link_ids=",".join(ids), slices=len(ids)).load()
        return comments(lines.select("raw_json", F.try_parse_json("raw_json").alias("v")))

    def show(value) -> int:
        print(json.dumps(value, default=str, ensure_ascii=False))
        return 0

    if a.command == "init-db":
        w.create()
    elif a.command in ("backfill", "ingest"):
        window = (now - a.days * 86_400, now) if a.command == "backfill" else pipeline.incremental_window(w, a.subreddit, now, a.days)
        return show(pipeline.ingest(w, from_api(*window), a.subreddit, "api", now, advance=True))
    elif a.command == "load-dump":
        return show(pipeline.ingest(w, from_dump(), a.subreddit, "dump", now))
    elif a.command == "classify":
        return show({"classified": pipeline.classify_pending(w, now, a.backend or "mock", a.effort, a.label, a.limit, said())})
    elif a.command == "comments":
        gathered = said()
        return show({"comments": 0 if gathered is None else pipeline.refresh_comments(w, gathered)})
    elif a.command == "audit":
        posts, wire = w.read("raw_posts"), slim(mark_refiled(records(w.read("classified_records"), w.read("raw_posts"))), public=True)
        problems = pipeline.publish_problems(wire)
        kinds = {r["kind"]: r["n"] for r in pii.counts(posts, F.concat_ws("\n", "title", "selftext")).collect()}
        show({"hits": kinds, **pii.author_counts(posts).first().asDict(), "top_authors": [r.asDict() for r in pii.top_authors(posts).collect()], "problems": problems})
        return 1 if problems else 0
    elif a.command == "renormalize":
        w.write("classified_records", store.renormalize(w.read("classified_records")))
        w.mark()
    elif a.command == "runs":
        return show([r.asDict() for r in store.list_runs(w.read("classified_records")).collect()])
    elif a.command == "clear-classifications":
        before = w.read("classified_records")
        left = store.clear(before, a.backend, a.run_key, a.model)
        n = before.count() - left.count()
        w.write("classified_records", left)
        w.mark()
        return show({"deleted": n})
    elif a.command in ("snapshot", "refresh"):
        out = a.out or f"{a.warehouse}/snapshot"
        if a.command == "refresh":
            return show(pipeline.refresh(w, from_dump() if a.dump else from_api(*pipeline.incremental_window(w, a.subreddit, now, a.days)), a.subreddit, "dump" if a.dump else "api", now, out, a.public))
        from docketlake.sources.sinks import write_snapshot

        envelope, wire = pipeline.build_snapshot(w.read("raw_posts"), w.read("classified_records"), now, a.public, subreddit=a.subreddit)
        if a.public and (problems := pipeline.publish_problems(wire)):
            raise SystemExit("; ".join(problems))
        write_snapshot(wire, envelope, out)
        return show({"data_version": envelope["data_version"]})
    elif a.command == "status":
        counts = store.counts(w.read("raw_posts"), w.read("classified_records"), PROMPT_VERSION, SCHEMA_VERSION, a.run_key).first().asDict()
        return show({**counts, "notice": stats.partial_data(counts)})
    elif a.command == "stats":
        r = views.select_view(records(w.read("classified_records"), w.read("raw_posts"), PROMPT_VERSION, SCHEMA_VERSION), a.run_key or COMPOSITE)
        r = in_range(r, *resolve_window(a.range, now=now))
        return show({"summary": stats.approval_rate(r).first().asDict(), "degree": [x.asDict() for x in stats.distribution(r, "degree").orderBy("ord").collect()]})
    elif a.command == "serve":
        from docketlake.service import serve

        serve(w, a.port)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
