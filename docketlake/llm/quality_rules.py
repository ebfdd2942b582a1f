"""Quality rules with host-level verdicts.

Base rules judge a document alone: too few words, or too much repetition.
Softer signs (many symbols, repeated lines, some repetition, odd word lengths)
are evidence about the document's host. Per host, failures are summed and the
failure rate is shrunk towards a beta prior fitted to all hosts by moments, so
that a host of few documents isn't condemned by one of them. On a host whose
shrunk rate is above the limit a document with any soft sign is rejected too;
documents without one stay, whatever their host.

Null text has no words (and so fails the base rule); a null host is a host.
Repeated rows count each. An empty table gives an empty result. Other columns
pass through; columns named like a result are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketlake.llm import kernels as K
from docketlake.llm.frames import anonymous
from docketlake.llm.storage import staged

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Soft signs, in percent: symbols of words, repeated lines of lines, repeated words of words; and word lengths in code points.
SOFT_SYMBOL_PERCENT, SOFT_DUP_LINE_PERCENT, SOFT_REPEAT_PERCENT = 10, 30, 10
SOFT_WORD_LENGTH = (2, 15)
MAX_HOST_RATE = 0.3

METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2:  # one text, however long
        return np.array([np.count_nonzero(flags)], np.int64)
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _copies(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each entry, how often its value occurs in its row."""
    if not len(values):
        return np.zeros(0, np.int64)
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    new = np.ones(len(v), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(v), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The metrics of each text of a buffer."""
    n = len(offsets) - 1
    if not len(data):
        return {m: np.zeros(n, np.int64) for m in METRICS}
    words = K.Words(data, offsets)
    code_points = (data & 0xC0) != 0x80
    blank = K.SPACE[data]
    out = {"n_words": words.counts, "word_chars": _per_row(code_points & ~blank, offsets), "n_symbols": _per_row(_SYMBOL[data], offsets)}

    # Lines: cut at \n and at the texts' ends; those that hold a word count.
    newline = np.flatnonzero(data == 0x0A)
    starts = np.union1d(newline + 1, offsets[:-1])
    starts = starts[starts < len(data)]
    row = np.searchsorted(offsets, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    ends = ends - (data[ends - 1] == 0x0A)
    worded = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends, row = starts[worded], ends[worded], row[worded]
    hashes = K.runs_hashed(data, starts, ends)
    lines = np.bincount(row, minlength=n)
    _, kept_rows = K.distinct(hashes, row)
    out |= {"n_lines": lines, "n_dup_lines": lines - np.bincount(kept_rows, minlength=n)}

    hashes, row = K.windows(words.hashes, words.first, WINDOW)
    again = _copies(hashes, row) > 1
    per_window = np.maximum(words.counts - WINDOW + 1, 0)
    at = np.arange(len(row)) - np.repeat(np.cumsum(per_window) - per_window, per_window) + words.first[:-1][row]
    change = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(change, at[again], 1)
    np.subtract.at(change, at[again] + WINDOW, 1)
    out["n_repeat_words"] = _per_row(np.cumsum(change)[:-1] > 0, words.first)
    return out


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in METRICS]))
def _measured(text: pa.Array) -> pa.Array:
    data, offsets = K.buffers(text)
    parts = [measure(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in K.row_slices(offsets)]
    columns = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, np.int64) for m in METRICS]
    K.release()
    return pa.StructArray.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=list(METRICS))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])


def soft_failed(m: Column) -> Column:
    low, high = SOFT_WORD_LENGTH
    return (
        (100 * m["n_symbols"] > SOFT_SYMBOL_PERCENT * m["n_words"])
        | (100 * m["n_dup_lines"] > SOFT_DUP_LINE_PERCENT * m["n_lines"])
        | (100 * m["n_repeat_words"] > SOFT_REPEAT_PERCENT * m["n_words"])
        | (m["word_chars"] < low * m["n_words"])
        | (m["word_chars"] > high * m["n_words"])
    )


def host_verdicts(judged: DataFrame, host: str = "host", failed: str = "failed", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk) and suspect, a row per host.

    The prior's mean m and strength s come from the mean and variance v of the
    hosts' raw rates: s = m (1 - m) / v - 1, at least 1; without variance all
    hosts take the common rate.
    """
    # Written, as both the prior and the verdicts read it.
    hosts = staged(judged.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col(failed)).alias("n_failed")), "host_sums")
    prior = hosts.select((F.col("n_failed") / F.col("n_docs")).alias("raw")).agg(F.avg("raw").alias("m"), F.var_pop("raw").alias("v"))
    prior = prior.select("m", F.when(F.col("v") > 0, F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0))).otherwise(F.lit(1e12)).alias("s"))
    rate = (F.col("n_failed") + F.col("m") * F.col("s")) / (F.col("n_docs") + F.col("s"))
    return hosts.join(F.broadcast(prior)).select(host, "n_docs", "n_failed", rate.alias("rate"), (rate > max_rate).alias("suspect"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE, with_text: bool = True) -> DataFrame:
    """``docs`` with the metrics, base_failed, suspect_host and kept.

    Texts are never shuffled while the host table is small enough for Spark to
    broadcast by its own size check. They are measured twice, once for the
    hosts' sums and once for the result; without the column of texts
    (``with_text``) they are measured once and what is measured is written.
    """
    results = [*METRICS, "base_failed", "suspect_host", "kept"]
    inner, named = anonymous(docs)
    key = F.coalesce(F.concat(F.lit("="), named[host].cast("string")), F.lit(""))
    measured = inner.withColumns({"host": key, "m": _measured(F.coalesce(named[text].cast("string"), F.lit("")))})
    if not with_text:
        named = {name: c for name, c in named.items() if name != text}
        measured = staged(measured.select(*named.values(), "host", "m"), "measured")
    m = F.col("m")
    measured = measured.withColumns({"base": base_failed(m), "soft": soft_failed(m)})
    verdicts = staged(host_verdicts(measured.select("host", (F.col("base") | F.col("soft")).alias("failed")), max_rate=max_rate), "hosts")
    joined = measured.join(verdicts.select("host", "suspect"), "host", "left")
    suspect = F.coalesce("suspect", F.lit(False))
    return joined.select(
        *[c.alias(name) for name, c in named.items() if name not in results], *[m[c].alias(c) for c in METRICS],
        F.col("base").alias("base_failed"), suspect.alias("suspect_host"), (~F.col("base") & ~(suspect & F.col("soft"))).alias("kept"),
    )
