"""Toxic passages as maximum-scoring segments of token log-odds.

A model is fitted on labelled documents: each token feature (the word, and its first 4, 5 and 6 letters) gets
its log-odds between the classes' documents under an informative Dirichlet prior; a feature counts where the
lower end of its interval is above zero. All other tokens cost ``DRIFT``. One linear scan (Ruzzo and Tompa)
finds every maximal segment of a text; extreme-value statistics (Karlin and Altschul) turn the scores of its
best segments, taken together, into the chance that clean text of that length has any as good. Labelled
documents that the weights were not learned from turn that chance into a probability of the label.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutflow.llm.common import drop_table, load, unit_hash, written

# Bound of the fit: about so many labelled documents are drawn by a hash of their id.
TRAIN_ROWS = 20_000
DRIFT = 0.3
PRIOR = 20.0
SIDE = 2.0
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
LEAST = 4
# A segment is significant where clean text of its length has one as good in under this share of cases.
SIGNIFICANT = 0.01
TOKEN = re.compile(r"[^\W\d_]+")
SEGMENTS = "array<struct<first:int,last:int,score:double,evalue:double,significant:boolean>>"
RESULT = f"struct<score:double,surprise:double,n_tokens:int,segments:{SEGMENTS}>"


def features(word: str) -> list[str]:
    """The word and the prefixes that are shorter than it."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def held_out() -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


DOCUMENTS, ALL = "", " "


def count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per task: how many clean and toxic texts hold each feature. ``DOCUMENTS`` and ``ALL`` count texts and sums."""
    out: dict[str, list[int]] = {DOCUMENTS: [0, 0], ALL: [0, 0]}
    for batch in batches:
        for text, toxic in zip(batch["text"], batch["toxic"]):
            side = int(toxic)
            held = {f for w in set(TOKEN.findall((text or "").lower())) for f in features(w)}
            out[DOCUMENTS][side] += 1
            out[ALL][side] += len(held)
            for f in held:
                out.setdefault(f, [0, 0])[side] += 1
    names = list(out)
    for i in range(0, len(names), 50_000):
        part = names[i : i + 50_000]
        yield pd.DataFrame({"feature": part, "clean": [out[f][0] for f in part], "toxic": [out[f][1] for f in part]})


class Model:
    """Weights of the toxic features and the extreme-value parameters; small, and broadcast."""

    def __init__(self, weights: dict[str, float], rates: dict[str, float], drift: float = DRIFT):
        self.weights, self.drift = weights, drift
        self.lam, self.k = self._decay(rates), 0.1
        self.bias, self.slope = -2.0, 1.0

    def _decay(self, rates: dict[str, float]) -> float:
        """The positive root of E[exp(x * score)] = 1 for tokens of clean text."""
        pairs = [(self.weights[f], r) for f, r in rates.items()]
        rest = max(1e-9, 1 - sum(r for _, r in pairs))
        low, high = 1e-6, 20.0
        for _ in range(80):
            mid = (low + high) / 2
            if rest * math.exp(-mid * self.drift) + sum(r * math.exp(min(700.0, mid * w)) for w, r in pairs) < 1:
                low = mid
            else:
                high = mid
        return low

    def set_scale(self, best: np.ndarray, n_words: np.ndarray) -> None:
        """The scale of the extreme-value law by maximum likelihood, from the best segment scores of clean texts (0: none, censored)."""
        if len(best) and (best > 0).any():
            self.k = float((best > 0).sum() / (n_words * np.exp(-self.lam * best)).sum())

    def probability(self, surprise: float) -> float:
        """Of the label, from ``-log`` of the chance that clean text does as well."""
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.bias + self.slope * math.log1p(surprise)))))

    def calibrate(self, surprises: np.ndarray, labels: np.ndarray) -> None:
        """Logistic regression of the label on the logarithm of the surprise (Newton, lightly damped)."""
        if not len(labels) or labels.min() == labels.max():
            return
        x = np.column_stack([np.ones(len(labels)), np.log1p(surprises)])
        beta = np.array([self.bias, self.slope])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            beta = beta + np.linalg.solve(hess, x.T @ (labels - p) - 1e-2 * (beta - [-2.0, 1.0]))
        self.bias, self.slope = float(beta[0]), float(max(beta[1], 0.0))

    def weight(self, word: str) -> float:
        return max((self.weights.get(f, -self.drift) for f in features(word)), default=-self.drift)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, seed: str = "tox-1") -> Model:
    """Learn from labelled documents outside the held-out fourth.

    Labels that are null don't count; of several labels of one id the largest does. Without any labels the
    model finds nothing. The sampled ids are broadcast: about ``train_rows`` of them at any input size.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rate = min(1.0, train_rows / max(1, known.count()))
    sample = known.filter(unit_hash(seed, F.col("doc_id")) < rate).withColumn("side", unit_hash(seed + "-side", F.col("doc_id")) < 0.6)
    # Written, as counting, the scale and the calibration read it: about the sample's texts at any input size.
    rows = written(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", "side"), "toxic-sample")
    counts = rows.filter("side").mapInPandas(count_features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # A feature needs LEAST toxic texts, so this list is bounded by the sample's toxic words over LEAST.
    kept = counts.filter((F.col("toxic") >= LEAST) | F.col("feature").isin(DOCUMENTS, ALL)).collect()
    table = {r["feature"]: (float(r["clean"]), float(r["toxic"])) for r in kept}
    d0, d1 = table.pop(DOCUMENTS, (0.0, 0.0))
    all0 = table.pop(ALL, (0.0, 0.0))[0]
    weights, rates = {}, {}
    for feature, (clean, toxic) in table.items():
        prior = PRIOR * (clean + toxic) / (d0 + d1)
        a, b = toxic + prior, clean + prior
        odds = math.log(a / max(d1 + PRIOR - a, 0.5)) - math.log(b / max(d0 + PRIOR - b, 0.5))
        sure = odds - SIDE * math.sqrt(1 / a + 1 / b)
        if sure > 0.5:
            weights[feature], rates[feature] = sure, (clean + 0.5) / (all0 + 1)
    model = Model(weights, rates)
    if weights:
        raw = scorer(docs.sparkSession, model)
        best = F.coalesce(F.array_max(F.transform(F.col("t.segments"), lambda x: x["score"])), F.lit(0.0))
        # At most the sample. Texts without words go here, as a filter in the plan would score every text once more, in a second worker a task.
        clean = rows.filter("not side and toxic = 0").select(raw("text").alias("t")).select(best.alias("best"), F.col("t.n_tokens").alias("n")).toPandas()
        clean = clean[clean["n"] > 0]
        model.set_scale(clean["best"].to_numpy(np.float64), clean["n"].to_numpy(np.float64))
        raw = scorer(docs.sparkSession, model)
        fresh = rows.filter("not side").select(raw("text")["surprise"].alias("x"), "toxic").toPandas()  # at most the sample
        model.calibrate(fresh["x"].to_numpy(np.float64), fresh["toxic"].to_numpy(np.float64))
    drop_table(rows)
    return model


def maximal_segments(at: list[int], gains: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence that is ``-drift`` but for ``gains`` at the places ``at``.

    Linear time: each candidate keeps a link to the last one that starts lower.
    """
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, link
    total, before = 0.0, -1
    for place, gain in zip(at, gains):
        total -= drift * (place - before - 1)
        first, low = place, total
        total += gain
        before = place
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, place, low, total, j))
                break
            first, low = found[j][0], found[j][2]
            del found[j:]
    return [(f, last, high - low) for f, last, low, high, _ in found]


class Weights(dict):
    """Word to weight, filled as words come; emptied when it gets large."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
        self[word] = w = self.model.weight(word)
        return w


def surprise_of(scores: list[float], n_words: int, lam: float, k: float) -> float:
    """``-log`` of the chance of segments as good as the best one, two, three ... of ``scores`` in clean text."""
    best = total = 0.0
    for r, s in enumerate(sorted(scores, reverse=True), 1):
        total += lam * s - math.log(k * n_words)
        if total <= 0:
            break
        if total > r * (r - 1):  # the form holds for large sums; each further segment pays for being a choice
            best = max(best, total - (r - 1) * math.log(2 * total) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def score_text(text: str | None, model: Model, weights: Weights) -> tuple[float, int, list[tuple[int, int, float, float]]]:
    """Surprise, number of tokens, and segments ``(first, last, score, evalue)`` by token number."""
    words = TOKEN.findall((text or "").lower())
    if not words or not model.weights:
        return 0.0, len(words), []
    gains = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    at = np.flatnonzero(gains > 0)
    if not len(at):
        return 0.0, len(words), []
    found = maximal_segments(at.tolist(), gains[at].tolist(), model.drift)
    marked = [(f, last, s, model.k * len(words) * math.exp(-model.lam * s)) for f, last, s in found]
    return surprise_of([s for *_, s, _ in marked], len(words), model.lam, model.k), len(words), marked


def scorer(spark: SparkSession, model: Model) -> Callable[[Column | str], Column]:
    """A column function: text to ``struct<score, surprise, n_tokens, segments>``. Texts without words score 0."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        weights = Weights(model)
        for texts in batches:
            rows = [score_text(t, model, weights) for t in texts]
            yield pd.DataFrame(
                {
                    "score": [model.probability(r[0]) if r[1] and model.weights else 0.0 for r in rows],
                        "surprise": [r[0] for r in rows],
                    "n_tokens": [r[1] for r in rows],
                    "segments": [[{"first": f, "last": last, "score": s, "evalue": e, "significant": e < SIGNIFICANT} for f, last, s, e in r[2]] for r in rows],
                }
            )

    return toxicity


def score(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_tokens, segments`` for each row of ``docs``.

    Repeated rows are each returned; a null id is never held out of the fit, having no label.
    """
    toxic = scorer(docs.sparkSession, fit(docs, labels, train_rows))
    rows = docs.select("doc_id", toxic("text").alias("t"))
    return rows.select("doc_id", held_out().alias("held_out"), "t.score", F.when(F.col("t.score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "t.n_tokens", "t.segments")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that score at or over ``threshold``; null, empty and repeated rows are judged like any other, and all columns stay."""
    toxic = scorer(docs.sparkSession, fit(docs, labels))
    return docs.filter(toxic("text")["score"] < threshold)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def in_held_out(doc_id: int) -> bool:
    """The Python form of ``held_out``."""
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_toxicity": op4_toxicity}
ORACLES: dict[str, str] = {}
