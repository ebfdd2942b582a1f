"""A post archive's HTTP API as a Python data source.

The window [after, before) is cut into time slices, one per input partition,
so a slice that fails is read again alone. Within a slice pages follow the
creation time; the last second of a full page is asked for again, so posts of
one second aren't lost at a page's end, and ids are kept apart. The archive has
no way to ask for more than a page of one second: a full page of one is warned
of. Comments of a post are paged in the same way.
"""

from __future__ import annotations

import json
import random
import time
import urllib.error
import urllib.parse
import urllib.request
import warnings
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY_STATUS = frozenset({408, 422, 425, 429, 500, 502, 503, 504, 520, 521, 522, 523, 524})
PAGE_SIZE, MAX_RETRIES, TIMEOUT, REQUESTS_PER_SECOND = 100, 6, 30.0, 1.5

Fetch = Callable[[str, dict], tuple[int, dict, object]]


def http_get(url: str, params: dict, timeout: float = TIMEOUT) -> tuple[int, dict, object]:
    """(status, headers, JSON)."""
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=timeout) as answer:
            return answer.status, dict(answer.headers), json.load(answer)
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers or {}), None


class Client:
    """Rate-limited requests with retries: status and transport errors back off exponentially, up to a minute."""

    def __init__(self, base: str, fetch: Fetch = http_get, sleep: Callable[[float], None] = time.sleep, rate: float = REQUESTS_PER_SECOND, retries: int = MAX_RETRIES):
        self.base, self.fetch, self.sleep, self.retries = base.rstrip("/"), fetch, sleep, retries
        self.gap, self.last = (1 / rate if rate > 0 else 0.0), 0.0

    def get(self, path: str, params: dict) -> list[dict]:
        problem: object = None
        for attempt in range(self.retries + 1):
            if (wait := self.last + self.gap - time.monotonic()) > 0:
                self.sleep(wait)
            self.last = time.monotonic()
            try:
                status, headers, body = self.fetch(self.base + path, params)
            except OSError as e:
                status, headers, body, problem = 0, {}, None, e
            if status == 200:
                self._ease(headers)
                data = body.get("data", []) if isinstance(body, dict) else body
                return data if isinstance(data, list) else []
            if status and status not in RETRY_STATUS:
                raise RuntimeError(f"{path}: HTTP status {status}")
            problem = problem if not status else f"HTTP status {status}"
            if attempt < self.retries:
                self.sleep(min(60.0, 2.0**attempt + random.random()))
        raise RuntimeError(f"{path}: no answer after {self.retries + 1} attempts ({problem})")

    def _ease(self, headers: dict) -> None:
        low = {k.lower(): v for k, v in headers.items()}
        try:
            if float(low["x-ratelimit-remaining"]) < 5:
                self.sleep(min(60.0, float(low["x-ratelimit-reset"])))
        except (KeyError, ValueError):
            return


def walk(fetch_page: Callable[[int, int], list[dict]], after: int, before: int, page_size: int = PAGE_SIZE) -> Iterator[dict]:
    """Posts with after <= created_utc < before, each id once."""
    seen: set[str] = set()
    while after < before:
        page = sorted(fetch_page(after, before), key=lambda p: int(p["created_utc"]))
        new = [p for p in page if p.get("id") not in seen and int(p["created_utc"]) < before]
        for post in new:
            seen.add(post["id"])
            yield post
        if not page:
            return
        last = int(page[-1]["created_utc"])
        if len(page) >= page_size and int(page[0]["created_utc"]) == last:
            warnings.warn(f"a full page of items at {last}; if there are more, the archive can't be asked for them", stacklevel=2)
        # A full page may have cut its last second in two: ask for that second again, unless nothing else came.
        after = last if len(page) >= page_size and new and last > after else last + 1
        if not new and last < after - 1:
            return


class Slice(InputPartition):
    def __init__(self, after: int, before: int):
        self.after, self.before = after, before


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Slice]:
        after, before = int(self.options["after"]), int(self.options["before"])
        n = max(1, int(self.options.get("slices", "1")))
        edges = [after + (before - after) * i // n for i in range(n + 1)]
        return [Slice(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]

    def client(self) -> Client:
        rate = float(self.options.get("rate", REQUESTS_PER_SECOND)) / max(1, int(self.options.get("slices", "1")))
        return Client(self.options["url"], rate=rate)

    def read(self, partition: Slice) -> Iterator[tuple]:
        client, subreddit = self.client(), self.options["subreddit"]

        def page(after: int, before: int) -> list[dict]:
            return client.get("/api/posts/search", {"subreddit": subreddit, "after": after, "before": before, "limit": PAGE_SIZE, "sort": "asc"})

        for post in walk(page, partition.after, partition.before):
            yield (json.dumps(post, separators=(",", ":")),)


class _CommentReader(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in self.options["link_ids"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client = self.client()
        params = {"link_id": partition.value, "limit": PAGE_SIZE, "sort": "asc"} | ({"author": self.options["author"]} if self.options.get("author") else {})
        for comment in walk(lambda after, before: client.get("/api/comments/search", {**params, "after": after, "before": before}), 0, 1 << 33):
            yield (json.dumps({"link_id": partition.value, **comment}, separators=(",", ":")),)


class PostArchive(DataSource):
    """spark.read.format("post_archive") with url, subreddit, after, before and slices; table=comments with link_ids. One column, raw_json."""

    @classmethod
    def name(cls) -> str:
        return "post_archive"

    def schema(self) -> str:
        return "raw_json string"

    def reader(self, schema) -> DataSourceReader:
        return (_CommentReader if self.options.get("table") == "comments" else _Reader)(dict(self.options))
