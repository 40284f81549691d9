"""Passages that start earlier in the corpus: what substring operators share.

Every window of ``window`` tokens has an anchor: the gram of ``gram`` tokens with
the least hash in it. Equal windows have equal anchors at equal distances, so only
windows whose anchor gram occurs again can be repeated. Texts that equal an earlier
text as a whole are settled by a digest and take no part in that search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import concat, stage
from shelfcast.llm.recurring import ENTRIES, pack_all, recurring

PIECE = 1 << 18
SPANS = "doc_id long, spans binary"


@dataclass(frozen=True)
class Alphabet:
    """Bytes, or words ended by ASCII white space."""

    words: bool
    window: int
    gram: int

    def tokens(self, text: str | None):
        data = (text or "").encode()
        return data.split() if self.words else data

    def hashed(self, texts: pa.Array) -> list:
        """What ``pieces`` takes of each text: the hashes of its words, or its bytes."""
        if not self.words:
            return [self.tokens(t) for t in texts.to_pylist()]
        flat, counts = common.word_hashes(texts)
        return np.split(flat, np.cumsum(counts)[:-1])

    def values(self, part) -> np.ndarray:
        return part if self.words else common.BYTE[np.frombuffer(part, np.uint8)]

    def joined(self, tokens) -> bytes:
        return b" ".join(tokens) if self.words else tokens


@dataclass
class Piece:
    """Windows of one stretch of a document: their starts and anchors, from its beginning."""

    row: int
    starts: np.ndarray
    anchors: np.ndarray
    hashes: np.ndarray


def pieces(lists: list, alphabet: Alphabet) -> Iterator[Piece]:
    """The windows of each text of ``Alphabet.hashed``. Long lists come in pieces; no window is in two."""
    window, held, total = alphabet.window, [], 0
    for row, tokens in enumerate(lists):
        for at in range(0, max(len(tokens) - window + 1, 0), PIECE):
            part = tokens[at : at + PIECE + window - 1]
            held.append((row, at, part))
            total += len(part)
            if total >= PIECE:
                yield from _windows(held, alphabet)
                held, total = [], 0
    yield from _windows(held, alphabet)


def _windows(held: list[tuple], alphabet: Alphabet) -> Iterator[Piece]:
    if not held:
        return
    window, gram = alphabet.window, alphabet.gram
    value = np.concatenate([alphabet.values(part) for _, _, part in held])
    g = np.zeros(len(value), np.uint64)
    power, inverse = common.powers(1 << max(PIECE, len(value)).bit_length())
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * power[: len(value)], dtype=np.uint64)))
    g[: len(value) - gram + 1] = (total[gram:] - total[:-gram]) * inverse[: len(value) - gram + 1]
    g = common.mix(g)
    wide = window - gram + 1
    low = np.uint64((1 << 24) - 1)
    key = np.full(-(-len(g) // wide) * wide + wide, np.iinfo(np.uint64).max, np.uint64)
    key[: len(g)] = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    block = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: len(g)], ahead[wide - 1 : wide - 1 + len(g)])
    anchor = (least & low).astype(np.int64)
    base = 0
    for row, at, part in held:
        starts = np.arange(base, base + len(part) - window + 1)
        x = anchor[starts]
        yield Piece(row, starts - base + at, x - base + at, g[x])
        base += len(part)


def digests(docs: DataFrame, alphabet: Alphabet) -> DataFrame:
    """(doc_id, n, sig): tokens of each document and a 128-bit digest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in common.rows(batches, "doc_id", "text"):
            lists = [alphabet.tokens(t) for t in texts]
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n": pa.array([len(x) for x in lists], pa.int64()),
                    "sig": pa.array([xxhash.xxh3_128_digest(alphabet.joined(x)) for x in lists], pa.binary()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, sig binary")


def _entries(docs: DataFrame, alphabet: Alphabet, buckets: int) -> DataFrame:
    def entries(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, h, d, p = part.column("doc_id").to_pylist(), [], [], []
        for piece in pieces(alphabet.hashed(part.column("text")), alphabet):
            first = np.flatnonzero(np.concatenate(([True], piece.anchors[1:] != piece.anchors[:-1])))
            h.append(piece.hashes[first])
            p.append(piece.anchors[first])
            d.append(np.full(len(first), ids[piece.row], np.int64))
        # the least of several hashes are small ones: scrambled again, they fill all ranges alike
        return common.mix(concat(h, np.uint64) * common.MULTIPLIER), concat(d, np.int64), concat(p, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from pack_all(map(entries, common.slices(batches)), buckets)

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, ENTRIES)


@dataclass(frozen=True)
class Stretch:
    """Neighbouring windows with one anchor that recurs: starts first..last of a document."""

    doc_id: int
    first: int
    last: int
    anchor: int
    gram: int


def stretches(alphabet: Alphabet, ids: list, lists: list, places: list) -> Iterator[tuple[int, Stretch]]:
    """(row, stretch) for the recurring anchors of a batch of candidates."""
    wanted = [np.sort(common.from_planes(p, np.uint32)).astype(np.int64) for p in places]
    for piece in pieces(lists, alphabet):
        want = wanted[piece.row]
        at = np.minimum(np.searchsorted(want, piece.anchors), len(want) - 1)
        hit = want[at] == piece.anchors
        edge = np.flatnonzero(np.concatenate(([True], piece.anchors[1:] != piece.anchors[:-1])))
        ends = np.append(edge[1:], len(hit)) - 1
        for a, b in zip(edge[hit[edge]].tolist(), ends[hit[edge]].tolist(), strict=True):
            yield (
                piece.row,
                Stretch(
                    ids[piece.row],
                    int(piece.starts[a]),
                    int(piece.starts[b]),
                    int(piece.anchors[a]),
                    int(piece.hashes[a].astype(np.int64)),
                ),
            )


class Repeats:
    """What is known of the documents before an operator compares their passages."""

    def __init__(self, docs: DataFrame, alphabet: Alphabet):
        self.alphabet = alphabet
        self.docs = docs.select("doc_id", "text")
        self.sets = stage(digests(docs, alphabet), "digests")
        known = self.sets.where("doc_id is not null")
        twice = known.groupBy("doc_id").agg(F.countDistinct("sig").alias("m")).where("m > 1")
        if twice.limit(1).count():
            raise ValueError("a doc_id has several texts")
        first = known.groupBy("sig").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"))
        self.firsts = first.select(F.col("first").alias("doc_id"), "n")
        self.copies = known.join(first.select("sig", "first"), "sig").where("doc_id > first").select("doc_id").distinct()

    def candidates(self) -> DataFrame:
        """(doc_id, text, p): first copies that hold anchors that recur, with the anchors' places."""
        # buckets follow the anchors that random hashes have
        tokens = self.firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        buckets = common.width_of(self.docs.sparkSession, 2 * tokens // (self.alphabet.window - self.alphabet.gram + 2))
        entries = _entries(self.docs, self.alphabet, buckets)
        found = recurring(entries, self.firsts, lambda shared, n: True, 2, buckets)
        found = stage(found.select("doc_id", "p"), "anchors")
        return self.docs.join(found, "doc_id")

    def with_spans(self, docs: DataFrame, spans: DataFrame, extra: str, apply: Callable) -> DataFrame:
        """docs with the columns that ``apply(text, tokens, removed spans)`` gives; copies are removed whole."""
        window, alphabet = self.alphabet.window, self.alphabet
        by_doc = spans.groupBy("doc_id").agg(F.collect_list("spans").alias("__spans"))
        by_doc = self.copies.withColumn("__copy", F.lit(True)).join(by_doc, "doc_id", "full")
        names = [x.split()[0] for x in extra.split(", ")]
        own = [c for c in docs.columns if c not in names]
        schema = docs.select(own).schema
        for x in extra.split(", "):
            schema = schema.add(x.split()[0], x.split()[1])
        kinds = [pa.int64() if x.endswith(" long") else pa.string() for x in extra.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for texts, found, copy in common.rows(iter([batch.select(["text", "__spans", "__copy"])]), "text", "__spans", "__copy"):
                    for text, blobs, whole in zip(texts, found, copy, strict=True):
                        tokens = alphabet.tokens(text)
                        if whole:
                            removed = [(0, len(tokens))] if len(tokens) >= window else []
                        else:
                            ends = [x for b in blobs or [] for x in np.frombuffer(b, np.int64).reshape(-1, 2).tolist()]
                            removed = union(ends)
                        out.append(apply(text, tokens, removed))
                columns = list(zip(*out, strict=True)) or [[]] * len(names)
                made = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.record_batch([*(batch.column(c) for c in own), *made], names=[*own, *names])

        joined = docs.join(by_doc, "doc_id", "left").select(*own, "__spans", "__copy")
        return joined.mapInArrow(run, schema)


def union(spans: list) -> list[tuple[int, int]]:
    """Disjoint maximal spans that cover the same tokens."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def spans_table(spans: dict[int, list[tuple[int, int]]]) -> pa.RecordBatch:
    return pa.record_batch(
        {
            "doc_id": pa.array(spans, pa.int64()),
            "spans": pa.array([np.array(union(x), np.int64).tobytes() for x in spans.values()], pa.binary()),
        }
    )
