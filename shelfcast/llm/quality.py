"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common

THRESHOLD = 0.3
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """bits: size of the hashed space. rows: bound on the labelled rows that are learned from.

    shards: models learned apart, each from its share of those rows, and averaged.
    """

    bits: int = 18
    rows: int = 12_000
    shards: int = 1
    passes: int = 4
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.0


def features(text: str | None, cache: common.HashCache, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of a text with damped counts of unit length.

    Words keep their case and marks. The last place is the constant.
    """
    words = common.hashes((text or "").encode().split(), cache)
    pairs = common.mix(words[:-1] * common.MULTIPLIER + words[1:])
    shift = np.uint64(64 - bits)
    place = (np.concatenate((words, pairs)) >> shift).astype(np.int64)
    index, count = np.unique(place, return_counts=True)
    value = 1 + np.log(count)
    norm = np.sqrt((value**2).sum()) or 1.0
    return np.append(index, 1 << bits), np.append(value / norm, 1.0)


class Ftrl:
    """Follow the regularised leader: lazy weights from sums of gradients."""

    def __init__(self, s: Settings):
        self.s, n = s, (1 << s.bits) + 1
        self.z, self.n = np.zeros(n), np.zeros(n)

    def weights(self, index: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, s = self.z[index], self.s
        step = (s.beta + np.sqrt(self.n[index])) / s.alpha + s.l2
        return np.where(np.abs(z) <= s.l1, 0.0, (np.sign(z) * s.l1 - z) / step)

    def learn(self, index: np.ndarray, value: np.ndarray, label: int) -> None:
        w = self.weights(index)
        gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        sigma = (np.sqrt(self.n[index] + gradient**2) - np.sqrt(self.n[index])) / self.s.alpha
        self.z[index] += gradient - sigma * w
        self.n[index] += gradient**2


def held_out() -> Column:
    """Documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learning_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text, label, shard): at most ``rows`` labelled rows, least hash first.

    The bound on the rows bounds the broadcast.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").dropDuplicates(["doc_id"])
    return rows.withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id), {s.shards}) as int)"))


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:  # noqa: B008
    """Weights of the hashed places and, last, the constant. Zeros without labelled rows."""

    def fit(table: pa.Table) -> pa.Table:
        model, cache = Ftrl(s), common.HashCache()
        order = np.argsort([i * 2654435761 % (1 << 32) for i in table["doc_id"].to_pylist()], kind="stable")
        texts, labels_ = table["text"].to_pylist(), table["label"].to_pylist()
        rows = [(*features(texts[i], cache, s.bits), labels_[i]) for i in order]
        for _ in range(s.passes):
            for index, value, label in rows:
                model.learn(index, value, label)
        return pa.table(
            {
                "weights": pa.array([model.weights().astype(np.float32).tobytes()], pa.binary()),
                "rows": pa.array([len(rows)], pa.int64()),
            }
        )

    fitted = learning_rows(docs, labels, s).groupBy("shard").applyInArrow(fit, "weights binary, rows long").collect()
    total = np.zeros((1 << s.bits) + 1)
    for r in fitted:
        total += np.frombuffer(r.weights, np.float32) * r.rows
    return (total / max(1, sum(r.rows for r in fitted))).astype(np.float32)


def scored(docs: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all its columns, score (double) and predicted (int).

    Null and empty texts get the score of the constant alone. A column of docs
    named score or predicted is replaced.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    shared = common.small_batches(docs).sparkSession.sparkContext.broadcast(weights)  # size fixed by the bits
    bits = (len(weights) - 1).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, cache = shared.value, common.HashCache()
        for batch in batches:
            scores = []
            for (texts,) in common.rows(iter([batch.select(["text"])]), "text"):
                for t in texts:
                    index, value = features(t, cache, bits)
                    scores.append(float(1 / (1 + np.exp(-np.clip(w[index] @ value, -35, 35)))))
            columns = [*batch.columns, pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]
            yield pa.record_batch(columns, names=[*batch.schema.names, "score", "predicted"])

    schema = docs.select(*kept).schema.add("score", "double").add("predicted", "integer")
    return docs.select(*kept).mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(doc_id, held_out, score, predicted) for every row of docs.

    Learns from labels (doc_id, quality, ...) outside the held-out fold; only the
    text makes a score. Rows with a null doc_id are scored and not held out; nulls
    and other values of quality teach nothing. Of a label given twice the lower
    counts. Without labels every score is 0.5.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs, labels, s))
    return rows.select("doc_id", held_out().alias("held_out"), "score", "predicted")
