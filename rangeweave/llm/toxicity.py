"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  A sentence's probability is logistic in its distinct words and their beginnings, a document's is the noisy-or of its
sentences, 1 - prod(1 - p), and only documents carry labels: the gradient of the bag's likelihood goes to the sentences that explain it.
The trained sentence scores then point at the offending sentences.

Training reads at most `bound` labelled documents (in hash order of their ids, outside fold 0), twice.  First executors count the documents of each hashed
feature, and the driver keeps those whose share among toxic and other documents differs beyond chance; then executors name the kept ones sentence by
sentence, and the driver, holding at most ENTRIES numbers, fits by full-batch gradient steps.  Scoring is one map over the scan; the model has at most KEEP weights.

Defined results: null and empty texts hold no sentence and score 0; without a usable label (or with one class) all weights are
zero and the bias is that of the labels' share; repeated rows score alike; long texts are scored whole; other columns are kept by locate().
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import fold, fresh, labelled_ids, materialize, release, settings, slices, tidy

BOUND = 10_000
#: Sentences and features in sentences that the driver fits on, at most.
ENTRIES = 8_000_000
BITS = 20
KEEP = 20_000
STEPS = 200
SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")


def hashed(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def parts_of(word: str) -> tuple[int, ...]:
    """Hashed features of a word: itself, and its first four and five characters."""
    return tuple({hashed(word), *(hashed(f"^{word[:k]}") for k in (4, 5) if len(word) > k)})


class Parts(dict):
    """word -> features, bounded."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        out = self[word] = parts_of(word)
        return out


def known_documents(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(label_id, label, text) of at most `bound` documents; where an id is repeated among them, the text of the least hash."""
    few = F.broadcast(labelled_ids(labels, "toxic", bound))  # at most `bound` rows of 12 bytes
    met = docs.join(few, docs["doc_id"] == few["label_id"])
    return materialize(met.groupBy("label_id", "label").agg(F.min_by(F.col("text").cast("string"), F.xxhash64("text")).alias("text")), "labelled")


def telling(known: DataFrame) -> tuple[np.ndarray, float, int]:
    """The features that differ between the classes beyond chance, the share of toxic documents, and the number of documents.  Tasks add up the documents of each feature; those of less than 4 stay there."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, n = Parts(), np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(label > 0)][np.unique([p for w in set(WORD.findall((text or "").lower())) for p in of[w]]).astype("<i4")] += 1
                n[int(label > 0)] += 1
        at = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), *(pa.array(np.append(c[at], m), pa.int64()) for c, m in zip(counts, n))], ["part", "clean", "toxic"])

    with settings(known.sparkSession):
        got = known.select("label", "text").mapInArrow(tidy(bags), "part int, clean long, toxic long").groupBy("part").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where("part < 0 OR clean + toxic >= 4").toPandas().sort_values("part")
    at, clean, toxic = (got[c].to_numpy(np.int64) for c in ("part", "clean", "toxic"))
    n, hits = int(clean[at < 0].sum() + toxic[at < 0].sum()), int(toxic[at < 0].sum())
    share = hits / n if n else 0.0
    if not 0 < share < 1:
        return np.empty(0, np.int64), share, n
    at, toxic, every = (x[at >= 0] for x in (at, toxic, clean + toxic))
    z = (toxic - every * share) / np.sqrt(every * share * (1 - share))
    kept = np.argsort(-np.abs(z), kind="stable")[:KEEP]
    return np.sort(at[kept[np.abs(z[kept]) > 3.5]]), share, n


def sentences(known: DataFrame, kept: np.ndarray, entries: int = ENTRIES) -> list:
    """(label, places of kept features by sentence, sentences they stand in, number of sentences) of documents in the order of their ids' hash, as long as sentences and features stay within `entries`."""

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, place = Parts(), {int(k): i for i, k in enumerate(kept)}
        for batch in batches:
            cols, rows, sizes = [], [], []
            for text in batch.column(2).to_pylist():
                col, row, n = [], [], 0
                for s in SENTENCE.findall((text or "").lower()):
                    if own := set(WORD.findall(s)):
                        found = [place[p] for w in sorted(own) for p in of[w] if p in place]
                        col += found
                        row += [n] * len(found)
                        n += 1
                cols.append(np.array(col, "<i4").tobytes())
                rows.append(np.array(row, "<i4").tobytes())
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cols, pa.binary()), pa.array(rows, pa.binary()), pa.array(sizes, pa.int32())], ["label_id", "label", "cols", "rows", "n"])

    made = materialize(known.select("label_id", "label", "text").mapInArrow(tidy(bags), "label_id long, label int, cols binary, rows binary, n int"), "bags")
    order = [F.xxhash64("label_id"), F.col("label_id")]
    so_far = F.sum(F.octet_length("cols") / 4 + F.col("n")).over(Window.orderBy(*order))  # no more rows than labelled documents
    out = made.withColumn("so_far", so_far).where(F.col("so_far") <= entries).orderBy(*order).select("label", "cols", "rows", "n").collect()
    release(made)
    return out


class Model:
    """Weights of hashed features and the bias of a sentence."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias = weights, bias

    @classmethod
    def fit(cls, rows: list, kept: np.ndarray, share: float) -> Model:
        per_doc = np.array([r[3] for r in rows])
        bias = float(np.log(np.clip(share, 1e-4, 1 - 1e-4) / max(1.0, per_doc.mean() if len(rows) else 1.0)))
        if not len(kept) or not len(rows):
            return cls({}, bias)
        y = np.array([r[0] > 0 for r in rows], float)
        doc = np.repeat(np.arange(len(y)), per_doc)
        first = np.cumsum(per_doc) - per_doc
        col = np.concatenate([np.frombuffer(r[1], "<i4") for r in rows])
        row = np.concatenate([np.frombuffer(r[2], "<i4") + f for r, f in zip(rows, first)])
        theta, m, v = np.zeros(len(kept) + 1), np.zeros(len(kept) + 1), np.zeros(len(kept) + 1)
        theta[-1] = bias
        total, rate, ridge = len(y), 0.1, 1e-5
        for step in range(1, STEPS + 1):
            s = theta[-1] + np.bincount(row, theta[col], len(doc))
            soft, p = np.logaddexp(0, s), 1 / (1 + np.exp(-np.clip(s, -40, 40)))
            bag = np.bincount(doc, soft, total)
            pull = np.where(y > 0, np.exp(-bag) / np.maximum(1 - np.exp(-bag), 1e-9), -1.0)
            g = pull[doc] * p
            grad = np.append(np.bincount(col, g[row], len(kept)), g.sum()) / total
            grad[:-1] -= ridge * theta[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls({int(k): float(t) for k, t in zip(kept, theta)}, float(theta[-1]))

    def known(self) -> dict:
        """word -> weight, worked out where a word is met for the first time; bounded."""
        weights = self.weights

        class Weights(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 500_000:
                    self.clear()
                x = self[word] = sum(weights.get(p, 0.0) for p in parts_of(word))
                return x

        return Weights()

    def sentences(self, text: str | None, weight: dict) -> list[tuple[int, int, float]]:
        """(start, end, logit) of each sentence that has a word."""
        of, out = weight.__getitem__, []
        lower = (text or "").lower()
        if len(lower) != len(text or ""):  # rare: a character whose lower case is longer
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        for m in SENTENCE.finditer(lower):
            if own := set(WORD.findall(m[0])):
                out.append((m.start(), m.end(), self.bias + sum(map(of, own))))
        return out


def noisy_or(logits: np.ndarray) -> float:
    return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


def train(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Model:
    known = known_documents(docs.select("doc_id", "text"), labels, bound)
    kept, share, _ = telling(known)
    rows = sentences(known, kept) if len(kept) else []
    release(known)
    return Model.fit(rows, kept, share)


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with tox_score and tox_spans (underscores added where docs has the name): (start, end, score) in characters of the sentences that reach the threshold, or the highest one of a document that does."""
    added = [fresh(docs, "tox_score"), fresh(docs, "tox_spans")]
    kind = f"{added[0]} double, {added[1]} array<struct<start:int,end:int,score:double>>"
    sent = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    names = docs.columns
    at = names.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = model.known()
        for batch in slices(batches):
            scores, spans = [], []
            for text in batch.column(at).to_pylist():
                found = model.sentences(text, weight)
                x = np.array([s[2] for s in found])
                scores.append(noisy_or(x))
                p = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
                hot = np.flatnonzero(p >= threshold)
                if not len(hot) and scores[-1] >= threshold:
                    hot = np.array([p.argmax()])
                spans.append([{"start": found[i][0], "end": found[i][1], "score": float(p[i])} for i in hot])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(spans, sent)], [*batch.schema.names, *added])

    from pyspark.sql.types import StructType, _parse_datatype_string

    return docs.mapInArrow(tidy(score), StructType([*docs.schema.fields, *_parse_datatype_string(kind).fields]))


def report(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> DataFrame:
    scored = locate(docs.select("doc_id", "text"), train(docs, labels, bound))
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("tox_score").alias("score"), (F.col("tox_score") >= 0.5).cast("int").alias("predicted"), F.size("tox_spans").alias("n_sentences"), F.transform("tox_spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("sentences"))


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = BOUND) -> DataFrame:
    """docs whose score stays below the threshold, with their own columns."""
    return locate(docs, train(docs, labels, bound), threshold).where(F.col(fresh(docs, "tox_score")) < threshold).select(*docs.columns)
