"""Toxic passages: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orogen.llm.common import drawn, stored

_TOKEN = re.compile(r"[^\W_]+")


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def features_of(word: str) -> list[str]:
    """A word and its beginnings of four to six characters, so that forms of one stem count together."""
    return [word, *["^" + word[:k] for k in (4, 5, 6) if len(word) > k]]


def segments(at: list[int], value: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, token after the last, score), in linear time.

    Tokens score ``value`` at the places ``at`` and ``-drift`` elsewhere (``drift`` is also taken
    off at those places). The scan keeps candidate segments with the sums before and after each and
    merges them as they grow (Ruzzo and Tompa).
    """
    found: list[list] = []  # first, after, sum before, sum to the end
    total, last = 0.0, -1
    for i, v in zip(at, value, strict=True):
        total -= drift * (i - last - 1)
        last = i
        v -= drift
        if v <= 0:
            total += v
            continue
        first, before, total = i, total, total + v
        own = [first, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= own[2]:
                j -= 1
            if j < 0 or found[j][3] >= own[3]:
                break
            own = [found[j][0], own[1], found[j][2], own[3]]
            del found[j:]
        found.append(own)
    return [(a, b, end - before) for a, b, before, end in found]


@dataclass
class Model:
    """Scores of features and calibration. ``rate`` and ``scale`` are the exponential tail of clean segments (lambda and K)."""

    scores: dict[str, float] = field(default_factory=dict)
    drift: float = 0.2
    rate: float = 1.0
    scale: float = 1e-3
    intercept: float = -4.0
    slope: float = 0.0

    def __post_init__(self):
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def word(self, word: str) -> float:
        """A word's score: that of its strongest feature, 0 if none is known. Kept for the task, up to a bound."""
        if len(self._words) > 500_000:
            self._words.clear()
        value = self._words[word] = max((self.scores.get(f, 0.0) for f in features_of(word)), key=abs)
        return value

    def passages(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Tokens of the text, and its segments."""
        words, known = tokens_of(text), self._words
        try:
            values = [known[w] for w in words]
        except KeyError:
            for w in words:
                if w not in known:
                    self.word(w)
            values = [known[w] if w in known else self.word(w) for w in words]
        at = [i for i, v in enumerate(values) if v]
        return len(words), segments(at, [values[i] for i in at], self.drift) if at else []

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        """Sum over segments of -log of the expected number of such segments in a clean text of n tokens, where below 0."""
        base = math.log(self.scale * max(n, 1))
        return sum(max(0.0, self.rate * s - base) for _, _, s in found)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.intercept + self.slope * evidence))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def log_odds(a, b, totals: tuple[int, int], prior: float, floor: float, log, sqrt):
    """(log-odds of toxic against other text, its standard error) of counts a and b, under an informative Dirichlet prior.

    The prior is ``prior`` tokens dealt like the pooled counts, and ``floor`` for each feature.
    """
    toxic, clean = totals
    alpha = prior * (a + b) / (toxic + clean) + floor
    odds = log((a + alpha) / (toxic + prior - a - alpha)) - log((b + alpha) / (clean + prior - b - alpha))
    return odds, sqrt(1 / (a + alpha) + 1 / (b + alpha))


def _tail_rate(background: list[tuple[float, float]]) -> float:
    """Lambda: where the mean of exp(lambda * score) over clean text is 1 again."""
    def mean(r: float) -> float:
        return sum(p * math.exp(min(500.0, r * s)) for s, p in background) - 1

    if not any(s > 0 and p > 0 for s, p in background) or sum(s * p for s, p in background) >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while mean(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    return low


def fit(docs: DataFrame, labels: DataFrame, prior: float = 1000.0, floor: float = 0.5, sure: float = 3.5, effect: float = 3.5, drift: float = 0.2, sample: int = 30_000) -> Model:
    """Learn from the labelled rows that aren't held out: ``sample`` of them at most, drawn by a hash of the doc_id.

    The sample's labels are broadcast, under half a megabyte, so that no text is shuffled.

    Words and word beginnings are counted by class in Spark. A feature scores its log-odds, drawn a
    standard error to 0, if these are ``sure`` errors from 0 and at least ``effect`` afterwards; all such
    features are kept, all else scores 0. Tokens also cost ``drift``. The tail of clean segments gives lambda and K; the
    calibration is a logistic curve on counts of the evidence in bins. The features and bins that reach the driver come from
    the sample alone, so its bound is theirs. Without both classes, or without a labelled row, the model scores every text
    the same.
    """
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(drawn(known, sample)), "doc_id").select("text", "toxic")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(words: dict[int, Counter]) -> pd.DataFrame:
            got: dict[str, list[int]] = {}
            for y, c in words.items():
                for w, n in c.items():
                    for f in features_of(w):
                        got.setdefault(f, [0, 0])[y] += n
            return pd.DataFrame({"feature": list(got), "a": [v[1] for v in got.values()], "b": [v[0] for v in got.values()]})

        words = {0: Counter(), 1: Counter()}
        for frame in frames:
            for t, y in zip(frame["text"], frame["toxic"], strict=True):
                words[int(y > 0)].update(tokens_of(t))
            if sum(map(len, words.values())) > 200_000:
                yield rows(words)
                words = {0: Counter(), 1: Counter()}
        if any(words.values()):  # a task without labelled rows has no frame to give
            yield rows(words)

    counted = stored(train.mapInPandas(count, "feature string, a long, b long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "feature-counts")
    words = counted.where("not startswith(feature, '^')")
    sums = words.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    totals = int(sums["a"]), int(sums["b"])
    model = Model(drift=drift)
    if not all(totals):
        return model
    odds, error = log_odds(F.col("a"), F.col("b"), totals, prior, floor, F.log, F.sqrt)
    most = counted.withColumn("odds", odds).withColumn("error", error).where((F.abs("odds") > sure * F.col("error")) & (F.abs("odds") - F.col("error") >= effect))
    rows = most.select("feature", "odds", "error").collect()
    model.scores = {r["feature"]: r["odds"] - math.copysign(r["error"], r["odds"]) for r in rows}

    def background(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = pd.Series([round(max((model.scores.get(f, 0.0) for f in features_of(w)), key=abs), 2) for w in frame["feature"]], dtype=float)
            yield frame["b"].groupby(s.to_numpy()).sum().rename("n").rename_axis("score").reset_index()

    shares = words.select("feature", "b").where("b > 0").mapInPandas(background, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.rate = _tail_rate([(r["score"] - drift, r["n"] / totals[1]) for r in shares])

    def found(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t, y in zip(frame["text"], frame["toxic"], strict=True):
                n, got = model.passages(t)
                out.append((n, [float(s) for _, _, s in got], int(y > 0)))
            if out:
                yield pd.DataFrame(out, columns=["n", "s", "toxic"])

    seen = stored(train.mapInPandas(found, "n long, s array<double>, toxic int"), "segments")
    # Peaks over a threshold: clean segments of score u or more come K * exp(-lambda * u) to a token.
    u = 1.0
    tail = seen.where("toxic = 0").agg(F.sum(F.size(F.filter("s", lambda x: x >= u))).alias("k"), F.sum("n").alias("n")).first()
    model.scale = (float(tail["k"] or 0) + 1) / (float(tail["n"] or 0) + 1) * math.exp(model.rate * u)
    base = F.log(F.lit(model.scale) * F.greatest("n", F.lit(1)))
    evidence = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + F.greatest(F.lit(0.0), F.lit(model.rate) * x - base))
    bins = seen.groupBy(F.round(evidence * 4).alias("bin"), "toxic").count().collect()
    model.intercept, model.slope = _logistic([(r["bin"] / 4, r["toxic"], r["count"]) for r in bins])
    return model


def _logistic(rows: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Weighted logistic regression on one feature, with a weak ridge, by Newton steps."""
    x = np.array([r[0] for r in rows])
    y = np.array([r[1] for r in rows], float)
    w = np.array([r[2] for r in rows], float)
    beta = np.zeros(2)
    design = np.stack((np.ones_like(x), x), 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (w * (y - p)) - 1e-3 * beta
        hessian = (design * (w * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -2, 2)
        if abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, n_tokens and the significant passages (tokens from, to) of every document.

    A null or empty text has no tokens and no evidence, and so the score of a text without any. Rows that repeat give
    repeated results, a null doc_id stays null and isn't held out as no remainder is known. Texts of any length are scanned
    whole, in linear time. An empty table gives no rows; other columns are not read.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t in frame["text"]:
                n, got = model.passages(t or "")
                e = model.evidence(n, got)
                base = math.log(model.scale * max(n, 1))
                out.append((model.probability(e), e, n, [f"{a}:{b}" for a, b, s in got if model.rate * s > base]))
            yield pd.DataFrame(out, columns=["score", "evidence", "n_tokens", "passages"]).assign(doc_id=frame["doc_id"].astype("Int64").to_numpy(dtype=object), held_out=frame["held_out"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    got = slim.mapInPandas(run, "doc_id long, held_out boolean, score double, evidence double, n_tokens long, passages array<string>")
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs``, columns as they are, that score below ``most``; nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [model.probability(model.evidence(*model.passages(t or ""))) < most for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
