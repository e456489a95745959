"""Quality rules: base counts, and a hashed n-gram likelihood ratio of trusted to raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from orogen.llm.common import stored

_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_PARTS = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _repeated(words: list[str], window: int) -> int:
    """Words that lie in a window of ``window`` words found twice or more."""
    n = len(words)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    if n <= window or len(number) > n - window:  # the second of two equal windows brings no new word
        return 0
    ids, bits = np.array([number[w] for w in words], np.int64), len(number).bit_length()
    views = np.lib.stride_tricks.sliding_window_view(ids, window)
    key, wide = views[:, 0].copy(), bits
    for k in range(1, window):
        if wide + bits > 62:  # number the windows so far anew, so that the next word fits
            key = np.unique(key, return_inverse=True)[1]
            wide = n.bit_length()
        key = key << bits | views[:, k]
        wide += bits
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str, window: int = 5) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = _WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACES):
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), dup, _repeated(words, window)


class Hasher:
    """Buckets of a text's 1-grams and 2-grams of parts; a part's hash is kept for the task, up to a bound.

    Parts are runs of letters and digits and runs of other visible characters. Case doesn't
    count, but parts all in upper case hash apart.
    """

    def __init__(self, buckets: int, limit: int = 600_000):
        self.buckets, self.limit, self.kept = buckets, limit, {}

    def __call__(self, text: str) -> np.ndarray:
        parts, kept = _PARTS.findall(text), self.kept
        if len(kept) > self.limit:
            kept.clear()
        try:
            ids = [kept[p] for p in parts]
        except KeyError:
            for p in parts:
                if p not in kept:
                    kept[p] = xxh32_intdigest("A" + p.lower() if len(p) > 1 and p.isupper() else p.lower())
            ids = [kept[p] for p in parts]
        one = np.array(ids, np.uint64)
        two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA77) + np.uint64(1)) >> np.uint64(7)
        return np.concatenate((one, two)) % np.uint64(self.buckets)


def ratios(docs: DataFrame, trusted: DataFrame, buckets: int = 1 << 18, smooth: float = 1.0) -> np.ndarray:
    """Log of target to raw probability of every bucket.

    The raw multinomial counts every document, the target those whose doc_id is in ``trusted``. One pass adds up arrays of ``buckets`` counts in each task; Spark sums
    them by bucket, so the driver gets as many rows as there are buckets at most, whatever the input.
    """
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(trusted.withColumn("mark", F.lit(True)).hint("merge"), "doc_id", "left").select("text", F.col("mark").isNotNull().alias("mark"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, total = Hasher(buckets), np.zeros((2, buckets), np.int64)
        for frame in frames:
            for at in range(0, len(frame), 500):
                part = frame.iloc[at : at + 500]
                grams = [hasher(t).astype(np.int64) for t in part["text"]]
                total[0] += np.bincount(np.concatenate(grams), minlength=buckets)
                target = [g for g, m in zip(grams, part["mark"], strict=True) if m]
                if target:
                    total[1] += np.bincount(np.concatenate(target), minlength=buckets)
        at = np.flatnonzero(total[0])
        yield pd.DataFrame({"bucket": at, "raw": total[0][at], "target": total[1][at]})

    got = marked.mapInPandas(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, buckets))
    counts[:, got["bucket"].to_numpy(int)] = got[["raw", "target"]].to_numpy(float).T
    counts += smooth
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1]) - np.log(share[0])


def threshold(scored: DataFrame, trusted: DataFrame, errors: float = 8.0) -> float:
    """``errors`` standard deviations under the mean ratio of the trusted documents with ten words or more.

    However the trusted ratios are spread, at most one in ``errors`` squared of them lies so far out (Chebyshev), so the
    default of 8 keeps all but 1.6 % of text like it at worst.
    """
    r = scored.join(trusted, "doc_id", "left_semi").where("n_words >= 10").agg(F.count("*").alias("n"), F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("std")).first()
    return r["mean"] - errors * max(r["std"], 1e-3) if r["n"] else -float("inf")


_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double"


def _scored(docs: DataFrame, table: np.ndarray) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, hasher = shared.value, None
        hasher = Hasher(len(values))
        for frame in frames:
            out = []
            for t in frame["text"]:
                grams = hasher(t)
                out.append((*base_counts(t), float(values[grams].mean()) if len(grams) else 0.0))
            yield pd.DataFrame(out, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "ratio"]).assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(dtype=object))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.mapInPandas(run, "doc_id long, " + _COUNTS)


def judge(docs: DataFrame, labels: DataFrame, buckets: int = 1 << 18, errors: float = 8.0) -> DataFrame:
    """doc_id, the base counts, ``base_failed``, ``ratio`` (log-likelihood ratio a gram) and ``kept`` of every document.

    Trusted text is every document with ``quality`` 1 in ``labels``; the model and the threshold count all of them. Documents are scored
    once and their counts, without texts, are stored, so the threshold reads those. A null or empty text has no words and fails. Without trusted documents only the
    base rules decide. A ratio at the threshold is kept. Rows that repeat give repeated results and count as
    often; a null doc_id stays null. Texts of any length are counted whole. An empty table gives no rows; other columns are not read.
    """
    trusted = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().hint("merge")  # both sides are dealt by doc_id at every size
    scored = stored(_scored(docs, ratios(docs, trusted, buckets)), "scored")
    least = threshold(scored, trusted, errors)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("ratio") >= least))
