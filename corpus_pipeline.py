"""Training-corpus pipeline over ``documents``.

Quality rules reject documents; repeated lines go; of each group of near
duplicates one document stays; sources are mixed to their target weights; what
remains is encoded. Every stage but the last returns the columns of documents,
and every stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import line_dedup, mixing, ngram_join, piece_codec, quality_rules
from docketlake.llm.queries import vocabulary
from docketlake.llm.storage import bound_batches
from docketlake.llm.storage import stage as stage_tables
from docketlake.llm.storage import staged
from docketlake.session import ship_package


def _releasing(function: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first deletes the tables of the stage before, whose result is written by now."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with stage_tables():
            ship_package(spark)
            bound_batches(spark)
            return function(spark, docs, sf_dir)

    return run_stage


@_releasing
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their host's verdict."""
    return quality_rules.judge(docs).filter("kept").select(*docs.columns)


@_releasing
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines kept elsewhere; those of which no line with a word is left go."""
    left = line_dedup.dedup_lines(docs).filter((F.col("n_kept") > 0) | (F.col("n_lines") == 0))
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return left.select(*columns)


@_releasing
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles at 0.8; documents without an id stay."""
    groups = ngram_join.ngram_components(docs, size=5, threshold=(4, 5))
    removed = staged(groups.filter(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct(), "removed")
    return docs.join(removed, "doc_id", "left_anti").select(*docs.columns)


@_releasing
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    taken = mixing.mix(docs).filter("taken > 0")
    copies = F.array_repeat(F.lit(0), (F.col("taken") / F.col("size")).cast("int"))
    return taken.withColumn("__copy", F.explode(copies)).select(*docs.columns)


@_releasing
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document of the mix, as digests."""
    return piece_codec.encode_documents(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pieces", pieces),
]

#: The stages use a dynamic program, set similarity and a tokenizer, which SQL can't express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
