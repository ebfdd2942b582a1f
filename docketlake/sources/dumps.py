"""Post dumps: NDJSON, JSON arrays and Zstandard streams, as a table of raw objects."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest window of a long-distance Zstandard stream.
MAX_WINDOW = 1 << 31


#: Bytes read from a file at once.
BLOCK = 1 << 20


def _open(path: str):
    """A file as a byte stream; read where Spark's own readers can't split or stream it."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path else re.sub("^(\\w+):/+", r"\1:///", path))
    return store.open_input_stream(inner, compression=None)


def _from_files(spark: SparkSession, path: str, rows: Callable[[object], Iterator[str]]) -> DataFrame:
    """``rows`` of each file's stream as (value); a task reads one file in blocks, so memory doesn't follow the file."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name in part["path"]:
                held: list[str] = []
                with _open(name) as stream:
                    for value in rows(stream):
                        held.append(value)
                        if len(held) == 1024:
                            yield pd.DataFrame({"value": held})
                            held = []
                yield pd.DataFrame({"value": held})

    return spark.read.format("binaryFile").load(path).select("path").mapInPandas(read, "value string")


def _zst_lines(stream) -> Iterator[str]:
    import io

    import zstandard

    reader = zstandard.ZstdDecompressor(max_window_size=MAX_WINDOW).stream_reader(stream, read_across_frames=True)
    for line in io.TextIOWrapper(io.BufferedReader(reader, BLOCK), encoding="utf-8", errors="replace"):
        if line.strip():
            yield line.rstrip("\r\n")


def array_elements(stream) -> Iterator[str]:
    """The elements of one JSON array, as their text; ValueError if it is cut or isn't one."""
    decoder, decode = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")("strict")
    text, at, ended, state = "", 0, False, "start"  # then first, value, comma, end
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        mark = text[at : at + 1]
        if state == "start" and mark == "[":
            at, state = at + 1, "first"
            continue
        if state in ("first", "comma") and mark == "]":
            at, state = at + 1, "end"
            continue
        if state == "comma" and mark == ",":
            at, state = at + 1, "value"
            continue
        if mark and state in ("first", "value"):
            try:
                _, end = decoder.raw_decode(text, at)
            except json.JSONDecodeError:
                end = -1
            # A number may go on in the next block; an object or a text ends by itself.
            if end >= 0 and (ended or text[end - 1] in '}]"' or end < len(text)):
                yield text[at:end]
                at, state = end, "comma"
                continue
        elif mark:
            raise ValueError(f"not a JSON array: {mark!r} where none belongs")
        if ended:
            if state == "end":
                return
            raise ValueError("the JSON array is cut short or malformed")
        block = stream.read(max(BLOCK, len(text) - at))
        ended = not block
        text, at = text[at:] + decode.decode(block, ended), 0


def _is_array(spark: SparkSession, path: str) -> bool:
    """Whether a .json file holds one array: looks at the first line with something in it."""
    first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(first) and first[0]["value"].lstrip("﻿ \t").startswith("[")


def read_dump(spark: SparkSession, path: str, long_windows: bool = False) -> DataFrame:
    """(raw_json, v): the objects of a dump as text and VARIANT; blank and malformed lines are left out, a malformed or cut array is an error.

    The ending says what it is: .jsonl, .ndjson, .json (an array or NDJSON) or
    .zst; ValueError for others. ``long_windows`` reads .zst with windows of up
    to 2 GiB.
    """
    name = path.lower().rstrip("/")
    if name.endswith(".zst_blocks"):
        raise ValueError("block-compressed dumps are not supported; use .zst")
    if name.endswith(".zst"):
        lines = _from_files(spark, path, _zst_lines) if long_windows else spark.read.text(path)
    elif name.endswith((".jsonl", ".ndjson")):
        lines = spark.read.text(path)
    elif name.endswith(".json"):
        if _is_array(spark, path):
            lines = _from_files(spark, path, array_elements)
            return lines.select(F.col("value").alias("raw_json"), F.parse_json("value").alias("v"))
        lines = spark.read.text(path)
    else:
        raise ValueError(f"unsupported dump: {path}")
    return parsed(lines)


def parsed(lines: DataFrame) -> DataFrame:
    """(raw_json, v) of the lines (value) that are JSON."""
    return lines.select(F.col("value").alias("raw_json"), F.try_parse_json("value").alias("v")).filter(F.col("v").isNotNull())


def submissions(dump: DataFrame) -> DataFrame:
    """Objects that have the keys id and title (comments have no title)."""
    keys = F.json_object_keys("raw_json")
    return dump.filter(F.coalesce(F.array_contains(keys, "id") & F.array_contains(keys, "title"), F.lit(False)))


def posts(dump: DataFrame) -> DataFrame:
    """The fields of a post, and the object it came from."""
    field = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind).alias(name)
    texts = [field(c) for c in ("id", "subreddit", "title", "selftext", "link_flair_text", "author", "url")]
    created = F.try_variant_get("v", "$.created_utc", "double").cast("long").alias("created_utc")
    return dump.select(*texts, field("score", "long"), field("num_comments", "long"), created, "raw_json")


def comments(dump: DataFrame) -> DataFrame:
    """The fields of comments: objects with id and body."""
    field = lambda name, kind="string": F.try_variant_get("v", f"$.{name}", kind).alias(name)
    post = F.regexp_replace(F.try_variant_get("v", "$.link_id", "string"), "^[^_]*_", "").alias("post_id")
    return dump.select(post, field("id"), field("author"), field("body"), field("parent_id"), F.try_variant_get("v", "$.created_utc", "double").cast("long").alias("created_utc")).filter(F.col("id").isNotNull() & F.col("body").isNotNull())
