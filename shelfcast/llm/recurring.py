"""Which hashes occur in several places, found by two packed exchanges.

Entries (hash, document, position) go to ranges of the hash; equal ones count once,
and those whose hash occurs once end there. The others go to their documents, where the caller's rule
drops documents that cannot matter. Further rounds count again among what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import concat

ENTRIES = "bucket int, h binary, d binary, p binary"
SHARED = "bucket int, h binary, d binary, p binary, f binary"
BY_DOCUMENT = "doc_id long, n long, h binary, p binary, f binary"
Rule = Callable[[np.ndarray, np.ndarray], np.ndarray]
# Entries that a task gathers before it deals them out: a row for each range costs the same however few it holds.
HELD = 1 << 20


def pack_entries(h: np.ndarray, d: np.ndarray, p: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per range of the hash."""
    order = np.argsort(h)
    h, d, p = h[order], d[order], p[order].astype(np.uint32)
    edges = np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)
    cuts = [0, *np.searchsorted(h, edges).tolist(), len(h)]
    spans = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
    return pa.record_batch(
        {
            "bucket": pa.array([i for i, _, _ in spans], pa.int32()),
            "h": pa.array([common.pack_sorted(h[a:b]) for _, a, b in spans], pa.binary()),
            "d": pa.array([common.pack_ids(d[a:b]) for _, a, b in spans], pa.binary()),
            "p": pa.array([common.planes(p[a:b]) for _, a, b in spans], pa.binary()),
        }
    )


def pack_all(parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of the entries (hashes, documents, positions) of a task, ``HELD`` or so at a time."""
    kinds, held, n = (np.uint64, np.int64, np.uint32), [], 0

    def row() -> pa.RecordBatch:
        columns = [concat((x[i].astype(t, copy=False) for x in held), t) for i, t in enumerate(kinds)]
        held.clear()
        return pack_entries(*columns, buckets)

    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= HELD:
            yield row()
            n = 0
    if n:
        yield row()


def _shared(buckets: int) -> Callable[[pa.Table], pa.Table]:
    def shared(table: pa.Table) -> pa.Table:
        h = concat(map(common.unpack_sorted, table["h"].to_pylist()), np.uint64)
        d = concat(map(common.unpack_ids, table["d"].to_pylist()), np.int64)
        p = concat((common.from_planes(x, np.uint32) for x in table["p"].to_pylist()), np.uint32)
        order = np.argsort(h, kind="stable")
        h = h[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(first, len(h)))
        f = np.repeat(count, count)
        keep = f > 1
        h, d, p, f = h[keep], d[order][keep], p[order][keep], f[keep].astype(np.uint32)
        home = d % buckets
        order = np.lexsort((d, home))
        h, d, p, f, home = h[order], d[order], p[order], f[order], home[order]
        if ((h[1:] == h[:-1]) & (d[1:] == d[:-1])).any():
            # equal entries come from repeated rows: a place counts once
            order = np.lexsort((p, h, d, home))
            h, d, p, home = h[order], d[order], p[order], home[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (p[1:] != p[:-1])
            h, d, p, home = h[new], d[new], p[new], home[new]
            _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
            f = count[inverse]
            keep = f > 1
            h, d, p, f, home = h[keep], d[keep], p[keep], f[keep].astype(np.uint32), home[keep]
        cuts = [0, *(np.flatnonzero(home[1:] != home[:-1]) + 1).tolist(), len(h)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        return pa.table(
            {
                "bucket": pa.array([home[a] for a, _ in spans], pa.int32()),
                "h": pa.array([common.planes(h[a:b]) for a, b in spans], pa.binary()),
                "d": pa.array([common.pack_ids(d[a:b]) for a, b in spans], pa.binary()),
                "p": pa.array([common.planes(p[a:b]) for a, b in spans], pa.binary()),
                "f": pa.array([common.planes(f[a:b]) for a, b in spans], pa.binary()),
            }
        )

    return shared


def _documents(rule: Rule) -> Callable[[pa.Table, pa.Table], Iterator[tuple]]:
    """(doc_id, n, hashes, positions, counts) of the documents that the rule keeps."""

    def documents(info: pa.Table, table: pa.Table) -> Iterator[tuple]:
        known = info["doc_id"].to_numpy()
        order = np.argsort(known)
        known, size = known[order], info["n"].to_numpy()[order]
        d = concat(map(common.unpack_ids, table["d"].to_pylist()), np.int64)
        if not len(known) or not len(d):
            return
        order = np.argsort(d, kind="stable")
        d = d[order]
        h, p, f = (
            concat((common.from_planes(x, t) for x in table[c].to_pylist()), t)[order]
            for c, t in (("h", np.uint64), ("p", np.uint32), ("f", np.uint32))
        )
        cuts = [0, *(np.flatnonzero(d[1:] != d[:-1]) + 1).tolist(), len(d)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = min(int(np.searchsorted(known, d[a])), len(known) - 1)
            if known[at] == d[a] and rule(b - a, int(size[at])):
                yield int(d[a]), int(size[at]), h[a:b], p[a:b], f[a:b]

    return documents


def recurring(entries: DataFrame, info: DataFrame, rule: Rule, rounds: int, buckets: int | None = None) -> DataFrame:
    """Rows of ``BY_DOCUMENT`` with the hashes of each document that occur elsewhere too.

    info: (doc_id, n), one row per document that may stay. rule(shared, n) says
    whether a document stays; ``f`` counts occurrences as of the last round. ``buckets``:
    as the entries were packed, by the session's partitions if not given. A bucket of
    hashes sends at most one row to each bucket of documents, and never more than it
    has entries.
    """
    buckets = buckets or common.width(entries.sparkSession)
    info = info.select(F.expr(f"cast(pmod(doc_id, {buckets}) as int)").alias("bucket"), "doc_id", "n")
    shared, documents = _shared(buckets), _documents(rule)

    def again(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(documents(left, right))
        h = concat((x[2] for x in found), np.uint64)
        p = concat((x[3] for x in found), np.uint32)
        d = np.repeat(np.array([x[0] for x in found], np.int64), [len(x[2]) for x in found])
        return pa.Table.from_batches([pack_entries(h, d, p, buckets)])

    def final(left: pa.Table, right: pa.Table) -> pa.Table:
        found = list(documents(left, right))
        return pa.table(
            {
                "doc_id": pa.array([x[0] for x in found], pa.int64()),
                "n": pa.array([x[1] for x in found], pa.int64()),
                **{
                    c: pa.array([common.planes(x[i]) for x in found], pa.binary())
                    for i, c in ((2, "h"), (3, "p"), (4, "f"))
                },
            }
        )

    for left in range(rounds - 1, -1, -1):
        columns = entries.groupBy("bucket").applyInArrow(shared, SHARED)
        pair = info.groupBy("bucket").cogroup(columns.groupBy("bucket"))
        entries = pair.applyInArrow(again if left else final, ENTRIES if left else BY_DOCUMENT)
    return entries
