"""Classification: the built-in heuristic as Columns, others by mapInPandas, and rows for the store."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketlake.functions.derive import body_available, content_hash, processing_days, run_key, run_key_text
from docketlake.functions.extract import heuristic_extract
from docketlake.functions.jsonx import parse_extracted, violations
from docketlake.functions.taxonomy import field_label, law_firm_label, profession_label
from docketlake.schema import CLASSIFIED_SCHEMA, PROMPT_VERSION, SCHEMA_VERSION


class Classifier(ABC):
    """Extension point: an object that turns one post into an answer; it is sent to executors."""

    #: Part of a run's identity. Without a model each answer's own counts.
    name = "external"
    model = ""

    @abstractmethod
    def classify(self, *, title: str, body: str | None, flair: str | None, op_comments: str | None) -> dict:
        """status ("ok" or "failed"), fields_json, failure_reason, model, raw_output and cost_usd."""


ANSWER = "id string, status string, fields_json string, failure_reason string, model string, raw_output string, cost_usd double"


def external_answers(posts: DataFrame, classifier: Classifier) -> DataFrame:
    """Answers of an external classifier; an error in one post is that post's failure."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for p in part.itertuples(index=False):
                try:
                    answer = classifier.classify(title=p.title, body=p.selftext, flair=p.link_flair_text, op_comments=p.op_comments)
                except Exception as e:
                    answer = {"status": "failed", "failure_reason": f"{type(e).__name__}: {e}"}
                rows.append((p.id, *[answer.get(k) for k in ("status", "fields_json", "failure_reason", "model", "raw_output", "cost_usd")]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])

    return posts.select("id", "title", "selftext", "link_flair_text", "op_comments").mapInPandas(run, ANSWER)


def with_hash(posts: DataFrame) -> DataFrame:
    return posts.withColumn("content_hash", content_hash(F.col("title"), F.col("selftext"), F.col("link_flair_text"), F.col("op_comments")))


def heuristic_rows(posts: DataFrame, now: int, effort: str = "", label: str = "") -> DataFrame:
    """Classified rows of ``posts`` (with content_hash) by the built-in heuristic; all of it stays in the JVM."""
    fields = heuristic_extract(F.col("title"), F.col("selftext"), F.col("op_comments"))
    bad_date = lambda d: d.isNotNull() & d.try_cast("date").isNull()
    t = F.col("f.timeline")
    failed = F.when(F.coalesce(bad_date(t["receipt_date"]) | bad_date(t["decision_date"]), F.lit(False)), "invalid date")
    return classified_rows(posts.withColumn("f", fields), F.col("f"), failed, backend="mock", run=F.lit(run_key_text("mock", "mock", effort, label)), model=F.lit("mock"), raw=F.lit(None).cast("string"), now=now, effort=effort, label=label)


def external_rows(posts: DataFrame, classifier: Classifier, now: int, effort: str = "", label: str = "") -> DataFrame:
    """Classified rows of ``posts`` (with content_hash) by an external classifier; answers that break the contract fail."""
    joined = posts.join(external_answers(posts, classifier), "id")
    broken = F.when(F.col("fields_json").isNull(), "no fields").otherwise(F.nullif(F.array_join(violations(F.col("fields_json")), ", "), F.lit("")))
    failed = F.when(F.coalesce(F.col("status") != "ok", F.lit(True)), F.coalesce("failure_reason", F.lit("failed"))).otherwise(broken)
    return classified_rows(joined.withColumn("f", parse_extracted(F.col("fields_json"))), F.col("f"), failed, backend=classifier.name, run=run_key(F.lit(classifier.name), F.coalesce(F.lit(classifier.model or None), "model"), F.lit(effort), F.lit(label)), model=F.coalesce("model", F.lit(classifier.model or None)), raw=F.col("raw_output"), now=now, effort=effort, label=label)


def classified_rows(posts: DataFrame, f: Column, failure: Column, *, backend: str, run: Column, model: Column, raw: Column, now: int, effort: str, label: str) -> DataFrame:
    """Rows of CLASSIFIED_SCHEMA: failed with all fields null, else ok for a decision and excluded for others, which keep theirs."""
    good = failure.isNull()
    days, source = processing_days(f["timeline"])
    value: dict[str, Column] = {
        "outcome": f["outcome"], "degree": f["degree"],
        "field_raw": f["field_raw"], "field_normalized": field_label(f["field_raw"]),
        "profession_raw": f["profession_raw"], "profession_normalized": profession_label(f["profession_raw"]),
        "law_firm_raw": f["law_firm_raw"], "law_firm_normalized": law_firm_label(f["law_firm_raw"]),
        "processing_days": days, "processing_source": source,
        **{m: f[m]["value"] for m in ("publications", "patents", "citations", "recommendation_letters", "years_experience")},
        **{c: f["timeline"][c] for c in ("receipt_date", "decision_date", "premium_processing", "was_rfed", "rfe_date", "rfe_response_date")},
    }
    columns: dict[str, Column] = {
        "post_id": F.col("id"), "content_hash": F.col("content_hash"), "prompt_version": F.lit(PROMPT_VERSION), "schema_version": F.lit(SCHEMA_VERSION),
        "run_key": run, "classifier_backend": F.lit(backend), "classifier_model": model,
        "run_effort": F.lit(effort or None).cast("string"), "run_label": F.lit(label or None).cast("string"),
        "status": F.when(~good, "failed").when(F.coalesce(f["is_niw_i140_decision"], F.lit(False)), "ok").otherwise("excluded"),
        "failure_reason": failure, "body_available": body_available(F.col("selftext")), "classified_at": F.lit(now), "raw_llm_output": raw,
        **{c: F.when(good, v) for c, v in value.items()},
    }
    for name in CLASSIFIED_SCHEMA.fieldNames():
        if name.endswith("_known"):
            columns[name] = columns[name.removesuffix("_known")].isNotNull()
    return posts.select(*[columns[x.name].cast(x.dataType).alias(x.name) for x in CLASSIFIED_SCHEMA])


class Backend:
    """A named way to classify: the model it is known by, and (posts, now, effort, label) -> classified rows."""

    def __init__(self, name: str, model: str, rows: Callable[..., DataFrame]):
        self.name, self.model, self.rows = name, model, rows

    def __call__(self, posts: DataFrame, now: int, effort: str = "", label: str = "") -> DataFrame:
        return self.rows(posts, now, effort, label)

    def run_key(self, effort: str = "", label: str = "") -> str:
        """The identity of a run with these settings."""
        return run_key_text(self.name, self.model, effort, label)

    def own(self, classified: DataFrame, effort: str = "", label: str = "") -> DataFrame:
        """The rows of that run, all under its key; without a known model, those of any model."""
        if self.model:
            return classified.filter(F.col("run_key") == self.run_key(effort, label))
        same = F.col("classifier_backend") == self.name
        for column, value in (("run_effort", effort), ("run_label", label)):
            same = same & F.col(column).eqNullSafe(F.lit(value or None))
        return classified.filter(same).withColumn("run_key", F.lit(self.run_key(effort, label)))


BACKENDS: dict[str, Backend] = {"mock": Backend("mock", "mock", heuristic_rows)}


def backend(name: str) -> Backend:
    if name not in BACKENDS:
        raise ValueError(f"unknown classifier backend: {name!r}")
    return BACKENDS[name]


def register_backend(name: str, classifier: Classifier) -> None:
    """Make a classifier known by ``name``, which becomes its own name too."""
    classifier.name = name
    BACKENDS[name] = Backend(name, classifier.model, lambda posts, now, effort="", label="": external_rows(posts, classifier, now, effort, label))
