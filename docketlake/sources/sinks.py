"""Snapshot and CSV output, and reading snapshots back."""

from __future__ import annotations

import hashlib
import json
import urllib.parse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.functions.derive import premium_label
from docketlake.operators.records import METRIC_COLUMNS
from docketlake.schema import CSV_COLUMNS


def csv_escape(text: Column) -> Column:
    """RFC 4180: quoted where it holds a quote, a comma or a line end; null is blank."""
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def number_text(value: Column) -> Column:
    """A number as short as can be: no decimals where there are none."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def csv_fields(base: str = "https://www.reddit.com") -> dict[str, Column]:
    label = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = {
        "date": F.date_format(F.timestamp_seconds("created_utc"), "yyyy-MM-dd"),
        "field": label("field_normalized"), "profession": label("profession_normalized"), "law_firm": label("law_firm_normalized"),
        **{m: number_text(F.col(m)) for m in METRIC_COLUMNS},
        "premium_processing": premium_label(F.col("premium_processing")),
        "rfe": F.when(F.col("was_rfed"), "Yes").when(~F.col("was_rfed"), "No"),
        "refiled": F.when(F.col("refiled"), "Yes"),
        "reddit_url": F.when(F.col("permalink") != "", F.concat(F.lit(base), F.col("permalink"))),
    }
    return {c: fields.get(c, F.col(c)) for c in CSV_COLUMNS}


def csv_lines(records: DataFrame) -> DataFrame:
    """(id, created_utc, line): a CSV line per record; needs the refiled flag, which is null if absent."""
    df = records if "refiled" in records.columns else records.withColumn("refiled", F.lit(None).cast("boolean"))
    return df.select("id", "created_utc", F.concat_ws(",", *[csv_escape(c) for c in csv_fields().values()]).alias("line"))


def write_csv(records: DataFrame, path: str) -> None:
    """A folder of CSV parts in order, newest first: CRLF, UTF-8; the first starts with a BOM and the header.

    Parts are written where they are sorted; joined in name order they are the
    one file that ``csv_text`` gives for small tables.
    """
    lines = csv_lines(records).orderBy(F.desc("created_utc"), "id").select("line")
    lines.write.mode("overwrite").text(path + "/rows", lineSep="\r\n")
    header = records.sparkSession.createDataFrame([("﻿" + ",".join(CSV_COLUMNS),)], "line string")
    header.coalesce(1).write.mode("overwrite").text(path + "/header", lineSep="\r\n")


def csv_text(records: DataFrame) -> str:
    """The CSV file of a download, for what fits the driver: no line end after the last row."""
    rows = csv_lines(records).orderBy(F.desc("created_utc"), "id").select("line").toLocalIterator()
    return "﻿" + "\r\n".join([",".join(CSV_COLUMNS), *(r["line"] for r in rows)])


def wire_json(slim: DataFrame) -> DataFrame:
    """(id, json): a record as on the wire, metrics as [value, known], nulls kept."""
    pair = lambda c: F.concat(F.lit(f'"{c}":['), F.coalesce(number_text(F.col(c)["value"]), F.lit("null")), F.when(F.col(c)["known"], ",true]").otherwise(",false]"))
    plain = [c for c in slim.columns if c not in METRIC_COLUMNS]
    rest = F.to_json(F.struct(*plain), {"ignoreNullFields": "false"})
    metrics = [pair(c) for c in METRIC_COLUMNS if c in slim.columns]
    return slim.select("id", F.concat(F.left(rest, F.length(rest) - 1), F.lit(","), F.concat_ws(",", *metrics), F.lit("}")).alias("json"))


def write_snapshot(slim: DataFrame, envelope: dict, path: str) -> None:
    """A snapshot as a folder: records as JSON lines, in parallel, and the envelope."""
    wire_json(slim).select("json").write.mode("overwrite").text(path + "/records")
    text = json.dumps(envelope, separators=(",", ":"), sort_keys=True)
    slim.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")


def snapshot_text(slim: DataFrame, envelope: dict) -> str:
    """The one-document snapshot, for what fits the driver."""
    head = json.dumps(envelope, separators=(",", ":"))[:-1]
    rows = wire_json(slim).orderBy("id").select("json").toLocalIterator()
    return head + ',"records":[' + ",".join(r["json"] for r in rows) + "]}"


def read_snapshot(spark: SparkSession, paths: list[str]) -> tuple[dict, DataFrame]:
    """(envelope, wire rows as JSON text) of the first path that has a snapshot, one document or a folder."""
    problem: Exception | None = None
    for path in paths:
        try:
            if path.endswith(".json"):
                whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
                rows = whole.lateralJoin(spark.tvf.variant_explode(F.variant_get("v", "$.records", "variant").outer()))
                envelope = json.loads(whole.select(F.to_json("v")).first()[0])
                envelope.pop("records", None)
                return envelope, rows.select(F.to_json("value").alias("json"))
            envelope = json.loads(spark.read.text(path + "/meta").first()[0])
            return envelope, spark.read.text(path + "/records").select(F.col("value").alias("json"))
        except Exception as e:  # absent or unreadable: the next may do
            problem = e
    raise FileNotFoundError(f"no snapshot in {paths}") from problem


def parse_wire(rows: DataFrame) -> DataFrame:
    """Wire rows (json) as the slim table; an absent pair is null and unknown."""
    texts = ("id", "title", "permalink", "flair", "author", "selftext", "op_comments", "outcome", "degree", "field", "profession", "law_firm", "rfe_date", "rfe_response_date", "run", "prompt_version", "schema_version", "refiled_url")
    v = F.try_parse_json("json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    metric = lambda m: F.struct(get(f"$.{m}[0]", "double" if m == "years_experience" else "long").alias("value"), F.coalesce(get(f"$.{m}[1]", "boolean"), F.lit(False)).alias("known")).alias(m)
    flags = [get(f"$.{c}", "boolean").alias(c) for c in ("premium_processing", "was_rfed", "refiled")]
    return rows.select(*[get(f"$.{c}", "string").alias(c) for c in texts], *[get(f"$.{c}", "long").alias(c) for c in ("created_utc", "classified_at")], *flags, *[metric(m) for m in METRIC_COLUMNS])


def etag(data_version: str, query: dict[str, str]) -> str:
    """Weak tag of a version and a query, for conditional requests."""
    return f'W/"{data_version}-{hashlib.sha1(urllib.parse.urlencode(query).encode()).hexdigest()[:10]}"'


def respond(data_version: str, query: dict[str, str], if_none_match: str | None, payload) -> tuple[int, dict[str, str], str | None]:
    """(status, headers, body): 304 without computing ``payload()`` where the client has this version."""
    tag = etag(data_version, query)
    headers = {"ETag": tag, "Cache-Control": "public, max-age=86400"}
    return (304, headers, None) if if_none_match == tag else (200, headers, json.dumps(payload(), separators=(",", ":")))
