"""Quality classifier: a sparse ensemble of rules over text statistics.

1. Statistics of each text are Spark column expressions (shares of signs, capitals, repeated lines and words, lengths).
2. Shallow boosted trees over the statistics of a bounded set of labelled documents give candidate rules: every path from a root
   to a node is a conjunction of comparisons.
3. A lasso-penalised logistic regression over the rules' 0/1 columns keeps few of them.
4. The kept rules compile into one Spark column expression, so that scoring is a projection of the scan.

Training reads the statistics (numbers only) of at most BOUND labelled documents, in hash order of their ids, outside fold 0.

Defined results: null and empty texts have all statistics 0 and are scored like any other; with no usable label or one class the score
is the labels' share (0.5 without labels); repeated rows score alike; other columns are kept by score() and never read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import fold, fresh, labelled_ids

BOUND = 30_000
SIGNS = {"percent": "%", "hash": "#", "star": "*", "dollar": "$", "amp": "&", "bang": "!", "pipe": "|", "lines": "\n", "stops": ".", "commas": ",", "at": "@", "angle": "<", "slash": "/"}
TREES, DEPTH, RATE, MIN_LEAF, BINS = 40, 3, 0.3, 15, 64
LASSO = 2e-3


def statistics(text: Column) -> dict[str, Column]:
    """name -> double, for a text that is not null."""
    size = F.octet_length(text)
    chars = F.greatest(F.char_length(text), F.lit(1))
    words = F.split(text, " ")
    n_words = F.size(words)
    rows = F.split(text, "\n")
    out = {k: (size - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / chars for k, c in SIGNS.items()}
    out["signs"] = sum((out[k] for k in ("hash", "star", "dollar", "amp")), out["percent"])
    out["capitals"] = F.regexp_count(text, F.lit("[A-Z]")) / chars
    out["digits"] = F.regexp_count(text, F.lit("[0-9]")) / chars
    out["bytes_per_char"] = size / chars
    out["log_chars"] = F.log(chars.cast("double"))
    out["word_length"] = chars / n_words
    out["new_words"] = F.size(F.array_distinct(words)) / n_words
    out["new_lines"] = F.size(F.array_distinct(rows)) / F.size(rows)
    out["line_length"] = F.log(chars / F.size(rows))
    return {k: c.cast("double") for k, c in out.items()}


NAMES = [*SIGNS, "signs", "capitals", "digits", "bytes_per_char", "log_chars", "word_length", "new_words", "new_lines", "line_length"]
#: (statistic, True: above / False: at most, threshold)
Test = tuple[int, bool, float]
Rule = tuple[Test, ...]


def grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, rules: set[Rule], step: np.ndarray) -> None:
    """One regression tree on gradient g and curvature h; x: bin numbers.  Adds its paths to rules and its leaves' values to step."""
    if path:
        rules.add(path)
    best: tuple[float, int, int] = (1e-6, -1, -1)
    G, H = g[rows].sum(), h[rows].sum()
    if depth < DEPTH and len(rows) >= 2 * MIN_LEAF:
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = x[rows, j]
            n, gs, hs = (np.cumsum(np.bincount(b, w, len(e) + 1))[:-1] for w in (None, g[rows], h[rows]))
            gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G * G / (H + 1)
            gain[(n < MIN_LEAF) | (len(rows) - n < MIN_LEAF)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), j, k)
    if best[1] < 0:
        step[rows] = G / (H + 1)
        return
    _, j, k = best
    up = x[rows, j] > k
    for above in (False, True):
        grow(x, edges, g, h, rows[up == above], (*path, (j, above, float(edges[j][k]))), depth + 1, rules, step)


def simplified(path: Rule) -> Rule:
    """Of several comparisons of one statistic in one direction only the tightest, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for j, above, t in path:
        tight[j, above] = t if (j, above) not in tight else (max if above else min)(tight[j, above], t)
    return tuple(sorted((j, above, t) for (j, above), t in tight.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, above, t in rule:
        out &= (x[:, j] > t) == above
    return out


def candidate_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    edges = [(lambda q: (q[:-1] + q[1:]) / 2)(np.unique(np.quantile(c, np.linspace(0, 1, BINS), method="nearest"))) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1)
    rules: set[Rule] = set()
    f = np.full(len(y), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        step = np.zeros(len(y))
        grow(bins, edges, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), (), 0, rules, step)
        f += RATE * step
    return sorted({simplified(r) for r in rules})


class Model:
    """Rules, their weights and the intercept."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Model:
        share = float(y.mean()) if len(y) else 0.5
        base = math.log(max(share, 1e-4) / max(1 - share, 1e-4))
        if not len(y) or share in (0.0, 1.0):
            return cls([], [], base)
        rules = candidate_rules(x, y)
        if not rules:
            return cls([], [], base)
        cols = np.stack([holds(r, x) for r in rules], 1).astype(float)
        _, first = np.unique(cols, axis=1, return_index=True)
        keep = [i for i in np.sort(first) if 0 < cols[:, i].mean() < 1]
        rules, cols = [rules[i] for i in keep], cols[:, keep]
        mean, spread = cols.mean(0), cols.std(0)
        z = (cols - mean) / spread
        # accelerated proximal gradient steps
        w, b, pw, pb, t = np.zeros(z.shape[1]), base, np.zeros(z.shape[1]), base, 1.0
        reach = 0.25 * np.linalg.norm(z.T @ z, 2) / len(y) + 0.25
        vw, vb = w, b
        for _ in range(400):
            e = 1 / (1 + np.exp(-np.clip(z @ vw + vb, -40, 40))) - y
            pw, pb = w, b
            w = vw - z.T @ e / len(y) / reach
            w = np.sign(w) * np.maximum(np.abs(w) - LASSO / reach, 0)
            b = vb - e.mean() / reach
            t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
            vw, vb = w + (last - 1) / t * (w - pw), b + (last - 1) / t * (b - pb)
        on = np.flatnonzero(np.abs(w) > 1e-4)
        return cls([rules[i] for i in on], [float(w[i] / spread[i]) for i in on], float(b - (w[on] * mean[on] / spread[on]).sum()))

    def column(self, stats: dict[str, Column]) -> Column:
        """The score as an expression over the statistics' columns."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            cond = F.lit(True)
            for j, above, t in rule:
                cond = cond & (stats[NAMES[j]] > t if above else stats[NAMES[j]] <= t)
            total = total + F.when(cond, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs beside a struct of the statistics, under the fresh name quality_stats."""
    held, out = fresh(docs, "quality_text"), fresh(docs, "quality_stats")
    stats = F.struct(*(c.alias(k) for k, c in statistics(F.col(held)).items()))
    return docs.withColumn(held, F.coalesce(F.col("text").cast("string"), F.lit(""))).withColumn(out, stats).drop(held)


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    few = F.broadcast(labelled_ids(labels, "quality", bound))  # at most `bound` rows of 12 bytes
    met = with_statistics(docs.select("doc_id", "text").join(few, F.col("doc_id") == F.col("label_id")))
    one = met.groupBy("label_id", "label").agg(F.min_by("quality_stats", F.xxhash64("text")).alias("stats"))  # a repeated id counts once, by the text of the least hash
    rows = one.select("label", "label_id", "stats.*").toPandas().sort_values("label_id")
    return Model.fit(rows[NAMES].to_numpy(float), rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs beside quality_score (0 to 1), under a fresh name."""
    stats = fresh(docs, "quality_stats")
    return with_statistics(docs).withColumn(fresh(docs, "quality_score"), model.column({k: F.col(f"{stats}.{k}") for k in NAMES})).drop(stats)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.3).cast("int").alias("predicted"))
