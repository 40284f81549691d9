"""Hard-negative mining: rows of another label that score nearly as high as a positive.

Each positive of an anchor is the upper limit of a window of scores. The distinct
limits cut the scores into disjoint slots. Every task keeps the best rows of each
slot, a ranking keeps the best of all tasks, and since slots do not overlap, the best
below a limit are the first entries of a suffix of the anchor's slots, taken from the
highest down: one pass answers all windows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stage

TOP = 5
QUERY_EVERY = 100
# Components of the rows and of the anchors of one task, and vectors of one product.
ROWS, ANCHORS, BLOCK = 1 << 22, 1 << 19, 1 << 11
# Labels are dealt into so many parts: an anchor looks for positives in one of them.
LABEL_PARTS = 16
# Products of doubles are exact below this bound.
EXACT = 2.0**53


def vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, x): the rows that take part, once each; x is floor(256 * component).

    Rows with a null vec_id, label, vector or component, or a component that is not
    finite, take no part. Labels of ids divisible by 7 move on by one, modulo 10.
    """
    finite = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("double"))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).distinct()


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    """The vectors as rows, filled with zeros to the width."""
    column = table["x"].combine_chunks()
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = flat
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of two sets of integral doubles."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    exact = [np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (a, b)]
    return (exact[0] @ exact[1].T).astype(np.int64)


def _best(groups: tuple, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Positions of the first ``top`` entries of each group: higher scores first, then smaller ids."""
    order = np.lexsort((ids, -score, *groups[::-1]))
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for g in groups:
        fresh[1:] |= g[order][1:] != g[order][:-1]
    starts = np.flatnonzero(fresh)
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return order[place < top]


def _scored(find: Callable, top: int) -> Callable:
    """Task: the best ``top`` rows of each (anchor, slot); ``find`` says which products are entries, and of what slot."""

    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        width = max(pc.max(pc.list_value_length(t["x"])).as_py() or 0 for t in (anchors, rows))
        a, anchor_ids = _matrix(anchors, width), anchors["vec_id"].to_numpy()
        held = [np.zeros(0, np.int64) for _ in range(4)]
        for at in range(0, rows.num_rows, BLOCK):
            part = rows.slice(at, BLOCK)
            b, ids = _matrix(part, width), part["vec_id"].to_numpy()
            for first in range(0, len(a), BLOCK):
                score = _product(a[first : first + BLOCK], b)
                i, j, slot = find(anchors.slice(first, BLOCK), part, score)
                new = (anchor_ids[first + i], slot, score[i, j], ids[j])
                held = [np.concatenate(pair) for pair in zip(held, new, strict=True)]
            keep = _best((held[0], held[1]), held[2], held[3], top)
            held = [h[keep] for h in held]
        return pa.table(dict(zip(("anchor_id", "slot", "score", "vec_id"), held, strict=True)))

    return run


ENTRIES = "anchor_id long, slot long, score long, vec_id long"


def _grid(anchors: DataFrame, rows: DataFrame, sets: tuple[int, int], find: Callable, top: int, part: Column) -> DataFrame:
    """Best entries of anchors against rows, over a grid of sets of both.

    Rows are repeated for each set of anchors and anchors for each set of rows; a
    cell of the grid is one group of a task. Only equal parts meet.
    """
    wide, long = sets
    cell = ["part", "anchor_set", "row_set"]
    own = F.pmod(F.xxhash64("vec_id"), F.lit(wide)).cast("int"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(long)).cast("int")
    every = [F.explode(F.sequence(F.lit(0), F.lit(n - 1))) for n in (long, wide)]
    left = anchors.select("*", part.alias("part"), own[0].alias("anchor_set"), every[0].alias("row_set"))
    right = rows.select("*", part.alias("part"), own[1].alias("row_set"), every[1].alias("anchor_set"))
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_scored(find, top), ENTRIES)
    rank = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= top)


def _same_label(top: int) -> Callable:
    def find(anchors: pa.Table, rows: pa.Table, score: np.ndarray) -> tuple:
        labels = anchors["label"].to_numpy()[:, None] == rows["label"].to_numpy()
        other = anchors["vec_id"].to_numpy()[:, None] != rows["vec_id"].to_numpy()
        i, j = np.nonzero(labels & other & (score >= _floor(score, labels & other, top)))
        return i, j, np.zeros(len(i), np.int64)

    return find


def _floor(score: np.ndarray, mask: np.ndarray, top: int) -> np.ndarray:
    """A score that at least ``top`` entries of each row of the block reach; lower ones are no use."""
    if score.shape[1] <= 4 * top:
        return np.full((len(score), 1), np.iinfo(np.int64).min)
    known = np.where(mask, score, np.iinfo(np.int64).min)
    return np.partition(known, -4 * top, axis=1)[:, [-4 * top]]


def _below_limits(low: int, high: int) -> Callable:
    def find(anchors: pa.Table, rows: pa.Table, score: np.ndarray) -> tuple:
        limits = anchors["limits"].combine_chunks()  # distinct, rising
        lengths = limits.value_lengths().to_numpy(zero_copy_only=False)
        flat, starts = limits.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
        least, most = flat[starts], flat[starts + lengths - 1]
        differs = anchors["label"].to_numpy()[:, None] != rows["label"].to_numpy()
        i, j = np.nonzero(differs & (score <= most[:, None]) & (score >= -(-least * low // high)[:, None]))
        s = score[i, j]
        # the slot is the least limit that is not below the score
        step = np.zeros(len(i), np.int64)
        for k in range(int(lengths.max(initial=1)) - 1):
            inside = k < lengths[i] - 1
            step += inside & (flat[starts[i] + np.where(inside, k, 0)] < s)
        slot = flat[starts[i] + step]
        keep = high * s >= low * slot
        return i[keep], j[keep], slot[keep]

    return find


def hard_negatives(
    rows: DataFrame, every: int = QUERY_EVERY, positives: int = TOP, negatives: int = TOP, low: int = 80, high: int = 100
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose vec_id is divisible by ``every``; their positives the first
    other rows of their label. Negatives have another label and a score s with
    low * positive_score <= high * s <= high * positive_score. Higher scores come
    first, then smaller ids. ``vectors`` says which rows take part. Repeated rows
    count once; different rows of one vec_id count each, but as an anchor the least
    (label, x) stands for them, and no row is a positive of its own id. Shorter
    vectors are filled with zeros. A positive below zero has no negatives. Scores
    times ``high`` must fit a long. Other columns are not read; an empty table, or
    one without anchors, gives no rows.
    """
    known = stage(vectors(rows), "vectors")
    least = F.min(F.struct("label", "x")).alias("least")
    anchors = known.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(least).select("vec_id", "least.label", "least.x")
    anchors = stage(anchors, "anchors")
    count, width = known.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(1))).first()
    wide = -(-anchors.count() * width // ANCHORS) or 1
    sets = wide, max(-(-count * width // ROWS), -(-2 * rows.sparkSession.sparkContext.defaultParallelism // wide))
    part = F.pmod("label", F.lit(LABEL_PARTS)).cast("int")
    found = _grid(anchors, known, sets, _same_label(positives), positives, part)
    best = stage(
        found.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives"
    )
    windows = best.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id"))
    limits = windows.agg(F.array_sort(F.collect_set("positive_score")).alias("limits"))
    found = _grid(anchors.join(limits, "vec_id"), known, sets, _below_limits(low, high), negatives, F.lit(0))
    # all slots of an anchor, from the highest down: a suffix of them answers each window
    entry = F.struct(F.col("score"), (-F.col("vec_id")).alias("order"), F.col("vec_id"))
    slots = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("slots"))
    first = F.slice(F.filter("slots", lambda e: e["score"] <= F.col("positive_score")), 1, negatives)
    inside = F.filter(first, lambda e: e["score"] * high >= F.col("positive_score") * low)
    out = best.where("positive_score >= 0").join(slots, "anchor_id")
    out = out.select("anchor_id", "positive_id", "positive_score", F.posexplode(inside).alias("place", "found"))
    return out.select(
        "anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("found.vec_id").alias("negative_id"),
        "positive_score", F.col("found.score").alias("negative_score"),
    )
