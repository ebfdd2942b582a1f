"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import embedding_dedup, html_text, line_dedup, mixing, ngram_join, paragraph_dedup, piece_codec, quality_rules, token_counts, warc
from docketlake.llm.storage import bound_batches
from docketlake.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; ``PUBLIC_TOKENIZERS_DIR`` may name another folder."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS_DIR"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), with_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_dedup.repeated_spans(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(table(spark, sf_dir, "embeddings"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), size=3, threshold=(9, 10))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.encode_documents(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marks = line_dedup.removed_lines(docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))
    counts = marks.select(F.col("id").alias("doc_id"), "n_lines", "n_kept", F.transform("removed", lambda r: r["line"]).alias("marked_lines"))
    rows = docs.select("doc_id").join(counts, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_kept", F.lit(0)).alias("n_kept"), "marked_lines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_paragraph_dedup": op2_paragraph_dedup,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_html_text": op4_html_text,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc": op6_warc,
    "op7_token_counts": op7_token_counts,
    "op8_quality_rules": op8_quality_rules,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_line_dedup": op10_line_dedup,
}

# What DuckDB can say. The others are tested against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op8_quality_rules": """
        WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
                     [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM d),
        g AS (SELECT *, CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i+4], ' ') FOR i IN range(1, len(words) - 3)] ELSE [] END AS grams FROM w),
        x AS (SELECT doc_id, unnest(range(1, len(grams) + 1)) AS i, unnest(grams) AS gram FROM g),
        twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM x) WHERE c > 1),
        hit AS (SELECT DISTINCT doc_id, i + k AS at FROM twice, (SELECT unnest(range(0, 5)) AS k)),
        rep AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id),
        m AS (SELECT g.doc_id, host, len(words)::BIGINT AS n_words,
                     length(array_to_string(words, ''))::BIGINT AS word_chars,
                     length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                     len(lines)::BIGINT AS n_lines,
                     (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                     coalesce(rep.n, 0)::BIGINT AS n_repeat_words
              FROM g LEFT JOIN rep ON rep.doc_id = g.doc_id),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                     100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines OR 100 * n_repeat_words > 10 * n_words
                     OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS soft FROM m),
        h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft) AS f FROM b GROUP BY host),
        pr AS (SELECT avg(f / n) AS mu, var_pop(f / n) AS v FROM h),
        ps AS (SELECT mu, CASE WHEN v > 0 THEN greatest(mu * (1 - mu) / v - 1, 1.0) ELSE 1e12 END AS s FROM pr),
        s AS (SELECT host, (f + mu * s) / (n + s) > 0.3 AS suspect FROM h, ps)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT (suspect AND soft) AS kept
        FROM b JOIN s USING (host)""",
}
