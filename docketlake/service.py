"""The read-only HTTP routes over a warehouse, on the standard library's server."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl, urlsplit


from docketlake.functions.derive import METRICS
from docketlake.operators import filters, records, stats, store, views
from docketlake.plans import pipeline
from docketlake.schema import COMPOSITE, PROMPT_VERSION, RANGE_DAYS, SCHEMA_VERSION
from docketlake.sources.sinks import etag, snapshot_text, wire_json

GROUPS = ("degree", "field", "profession", "law_firm", "citation_bucket", "premium", "rfe")


def route(w: pipeline.Warehouse, path: str, query: dict[str, str], if_none_match: str | None = None, now: int | None = None) -> tuple[int, dict[str, str], str]:
    """(status, headers, body) of a request. Parameters are checked before anything is planned; an unchanged version, one row of the meta table, answers 304 before posts or records are read."""
    now = int(time.time()) if now is None else now
    if path == "/api/health":
        return 200, {}, '{"status":"ok"}'
    try:
        if query.get("range", "all") not in ("all", *RANGE_DAYS):
            raise ValueError("unknown range")
        window = filters.resolve_window(query.get("range"), query.get("start"), query.get("end"), now)
        limit = int(query.get("limit", "1000"))
        if path == "/api/stats/distribution" and query.get("metric") not in METRICS:
            raise ValueError("unknown metric")
        if path == "/api/stats/approval-rate-by" and query.get("group") not in GROUPS:
            raise ValueError("unknown group")
        if limit < 0:
            raise ValueError("limit can't be negative")
    except ValueError as e:
        return 422, {}, json.dumps({"detail": str(e)})
    version = w.version() or w.mark()
    headers = {"ETag": etag(version, query), "Cache-Control": "public, max-age=86400"}
    if if_none_match == headers["ETag"]:
        return 304, headers, ""
    posts, classified = w.read("raw_posts"), w.read("classified_records")
    run, hide = query.get("run") or COMPOSITE, query.get("hide_unknown", "false").lower() in ("1", "true")
    view = filters.in_range(views.select_view(records.records(classified, posts, PROMPT_VERSION, SCHEMA_VERSION), run), *window)
    rows = lambda df: [r.asDict() for r in df.collect()]
    if path == "/api/meta":
        out: object = {**store.counts(posts, classified, PROMPT_VERSION, SCHEMA_VERSION).first().asDict(), "view_run": run, "runs": rows(store.list_runs(classified, PROMPT_VERSION, SCHEMA_VERSION)), "data_version": version}
    elif path == "/api/stats/summary":
        out = stats.approval_rate(view).first().asDict()
    elif path == "/api/stats/distribution":
        metric = query["metric"]
        summary = stats.distribution_summary(view, (metric,)).collect()
        totals = summary[0].asDict() if summary else {"metric": metric, "unknown_count": 0, "n": 0, "total": 0}
        kind = "duration" if metric == "processing_days" else "categorical" if metric in ("outcome", "degree", "field", "profession", "law_firm", "premium", "rfe") else "numeric"
        out = {**totals, "kind": kind, "buckets": rows(stats.distribution(view, metric, hide).orderBy("ord").drop("metric", "ord"))}
    elif path == "/api/stats/approval-rate-by":
        out = {"group": query["group"], "groups": rows(stats.approval_rate_by(view, query["group"], hide).orderBy("ord").drop("ord"))}
    elif path == "/api/stats/records":
        wire = wire_json(records.slim(filters.first_records(view, limit)))
        return 200, headers, f'{{"count":{view.count()},"records":[{",".join(r["json"] for r in wire.collect())}]}}'
    elif path == "/api/snapshot":
        envelope, wire = pipeline.build_snapshot(posts, classified, now)
        return 200, headers, snapshot_text(wire, envelope)
    else:
        return 404, {}, '{"detail":"not found"}'
    return 200, headers, json.dumps(out, separators=(",", ":"), default=str)


def serve(w: pipeline.Warehouse, port: int = 8000) -> None:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            url = urlsplit(self.path)
            status, headers, body = route(w, url.path, dict(parse_qsl(url.query)), self.headers.get("If-None-Match"))
            self.send_response(status)
            for k, v in {**headers, "Content-Type": "application/json"}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body.encode())

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()


