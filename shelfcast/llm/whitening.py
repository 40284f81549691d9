"""Embedding whitening from exact integer cross-products over packed bit planes.

Entries become integers. A block of rows shifts each dimension to start at zero and
packs every bit plane of it, across the rows, into 64-bit words. The cross-product of
two dimensions is then the sum of the counts of ANDed planes, weighted by powers of
two. Sums stay integers over all blocks and are centred as integers, so the
covariance is exact until ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import stage

SCALE = 256
COMPONENTS = 4
# Rows that share a block of words; the planes of a block meet each other word by word.
BLOCK = 1 << 13
# Entries below this keep all sums inside 38 decimal digits for 2^45 rows; the covariance has that many dimensions at most.
MOST, WIDEST = 1 << 40, 1024
SUMS = "j int, k int, value decimal(38,0)"
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x): rows whose vector is not null and holds finite entries alone; x is floor(256 * entry)."""
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return rows.where(F.col(vector).isNotNull() & finite).select("vec_id", x.alias("x"))


def _filled(x: str, width: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size(x)))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension, bit) of the planes of non-negative integers: a row of words for each plane that has bits."""
    bits = [int(m).bit_length() for m in y.max(axis=0, initial=0)]
    dimension = np.repeat(np.arange(y.shape[1]), bits)
    bit = np.concatenate([np.arange(b) for b in bits]) if dimension.size else np.zeros(0, np.int64)
    rows = -(-len(y) // 64) * 64
    words = np.zeros((len(dimension), rows // 8), np.uint8)
    for i, (j, b) in enumerate(zip(dimension, bit, strict=True)):
        packed = np.packbits((y[:, j] >> np.int64(b)) & 1 == 1)
        words[i, : len(packed)] = packed
    return words.view(np.uint64), dimension, bit


def cross_products(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of y_j and of y_j * y_k over the rows of a block, as integers of any length."""
    words, dimension, bit = planes(y)
    # products below 2^46 sum to less than 2^63 over a block; longer ones are Python integers
    kind = np.int64 if bit.max(initial=0) < 23 else object
    bit = bit.astype(kind)
    sums, products = np.zeros(y.shape[1], kind), np.zeros((y.shape[1], y.shape[1]), kind)
    np.add.at(sums, dimension, np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(kind) << bit)
    for i in range(len(words)):
        both = np.bitwise_count(words[i:] & words[i]).sum(axis=1, dtype=np.int64).astype(kind) << (bit[i:] + bit[i])
        # two planes of one dimension stand for both of their orders
        both[1:] <<= (dimension[i + 1 :] == dimension[i]).astype(kind)
        np.add.at(products[dimension[i]], dimension[i:], both)
    upper = np.triu(products, 1)
    return sums.astype(object), (products + upper.T).astype(object)


def _scatter(batches: Iterator[pa.RecordBatch], width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products of all batches."""
    n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
    for x in _blocks(batches, width):
        least = x.min(axis=0)
        s, c = cross_products(x - least)
        m = least.astype(object)
        products += c + np.outer(s, m) + np.outer(m, s) + len(x) * np.outer(m, m)
        sums += s + len(x) * m
        n += len(x)
    return n, sums, products


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    held, rows = [], 0
    for batch in batches:
        held.append(_matrix(batch, width))
        rows += batch.num_rows
        if rows >= BLOCK:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n vectors, sums by dimension, and the first components.

    A component without variance has scale 0. trace and values are of the covariance;
    explained is null where it has no trace.
    """

    n: int
    sums: np.ndarray
    basis: np.ndarray
    values: np.ndarray
    trace: float
    error: float | None = None

    @property
    def scale(self) -> np.ndarray:
        known = self.values > len(self.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        return np.where(known, 1 / np.sqrt(np.where(known, self.values, 1.0)), 0.0)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs where they hold it."""
        most = max((abs(int(v)) for v in self.sums), default=0)
        if self.n * int(np.abs(x).max(initial=0)) + most < 1 << 62:
            return self.n * x - self.sums.astype(np.int64)
        return self.n * x.astype(object) - self.sums

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return (centred / self.n).astype(float) @ self.basis * self.scale


def fit(vectors: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The model of distinct vectors ``x`` of that width; None without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = _scatter(batches, width)
        if n:
            j, k = np.triu_indices(width)
            yield _triples([-1, *[-1] * width, *j], [-1, *range(width), *k], [n, *sums, *products[j, k]], pa.decimal128(38, 0))

    found = vectors.select("x").mapInArrow(run, SUMS).groupBy("j", "k").agg(F.sum("value").alias("value"))
    total = {(r["j"], r["k"]): int(r["value"]) for r in found.collect()}  # half of width squared
    if not total:
        return None
    n, sums = total[-1, -1], [total[-1, k] for k in range(width)]
    covariance = np.zeros((width, width))
    for j in range(width):
        for k in range(j, width):
            # integers until this division, which rounds once
            covariance[j, k] = covariance[k, j] = (n * total[j, k] - sums[j] * sums[k]) / (n * n)
    values, basis = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:components]
    model = Whitening(n, np.array(sums, object), basis[:, order], np.maximum(values[order], 0.0), float(np.trace(covariance)))
    return replace(model, error=_identity_error(vectors, model))


def _triples(j: list, k: list, values: list, kind: pa.DataType) -> pa.RecordBatch:
    if pa.types.is_decimal(kind):
        values = [Decimal(int(v)) for v in values]
    columns = [pa.array(np.array(j, np.int32)), pa.array(np.array(k, np.int32)), pa.array(values, kind)]
    return pa.record_batch(columns, names=["j", "k", "value"])


def _identity_error(vectors: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on the list itself."""
    used = np.flatnonzero(model.scale)
    if not len(used):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(used) + 1, len(used) + 1))
        for x in _blocks(batches, len(model.sums)):
            z = np.column_stack([model.whitened(model.centred(x))[:, used], np.ones(len(x))])
            total += z.T @ z
        j, k = np.indices(total.shape)
        yield _triples(j.ravel(), k.ravel(), total.ravel(), pa.float64())

    found = vectors.select("x").mapInArrow(run, "j int, k int, value double").groupBy("j", "k").agg(F.sum("value").alias("value"))
    second = np.zeros((len(used) + 1, len(used) + 1))
    for r in found.collect():
        second[r["j"], r["k"]] = r["value"] / model.n
    mean = second[-1, :-1]
    return float(np.abs(second[:-1, :-1] - np.outer(mean, mean) - np.eye(len(used))).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    Rows with a null vector, or null or non-finite entries, are dropped; a null vec_id
    stays. The model is fitted to each distinct integer vector once, so repeated rows
    weigh nothing more; each of them has its own result rows. Shorter vectors are
    filled with zeros; there are as many components as dimensions at most. A component
    without variance has a null ``whitened``; without any variance ``explained`` and
    ``identity_error`` are null. ``deviation`` is null where a long does not hold it.
    An empty table gives no rows. Entries of 2^32 and more in size, and vectors of more
    than 1,024 entries, raise ValueError. Other columns are not read.
    """
    spark = rows.sparkSession
    known = integers(rows)
    sizes = known.agg(F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    width, most = sizes[0] or 0, sizes[1] or 0
    if width > WIDEST or most >= MOST:
        raise ValueError(f"vectors of {width} entries up to {most / SCALE} in size")
    known = known.select(F.col("vec_id").cast("long").alias("vec_id"), _filled("x", width).alias("x"))
    model = fit(stage(known.select("x").distinct(), "fit-list"), width, components) if width else None
    if model is None:
        return spark.createDataFrame([], RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, count = model.scale > 0, len(model.values)
        for batch in batches:
            centred = model.centred(_matrix(batch, width))
            z = model.whitened(centred)
            wide = len(centred) and width * int(np.abs(centred).max()) ** 2 >= 1 << 63
            squares = (centred.astype(object) if wide else centred) ** 2
            deviation = [int(v) if v < 1 << 63 else None for v in squares.sum(axis=1)]
            rows = np.repeat(np.arange(len(z)), count)
            explained = model.values / model.trace if model.trace > 0 else np.zeros(count)
            yield pa.record_batch(
                [
                    batch.column("vec_id").take(pa.array(rows)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(z))),
                    pa.array(np.full(len(rows), model.n)),
                    pa.array(deviation, pa.int64()).take(pa.array(rows)),
                    pa.array(z.ravel(), mask=np.tile(~used, len(z))),
                    pa.array(np.tile(explained, len(z)), mask=np.full(len(rows), not model.trace > 0)),
                    pa.array([model.error] * len(rows), pa.float64()),
                ],
                names=[c.split()[0] for c in RESULT.split(", ")],
            )

    return known.mapInArrow(run, RESULT)
