"""Suffix-array dedup: a distributed merge sort that knows common prefixes.

Suffixes start at the anchors of windows that may be repeated (``repeats``) and
carry the bytes before them. Each task sorts its suffixes into runs, front-coded:
of each suffix only what differs from the one before is kept. Runs are exchanged by
ranges of the first bytes; each range merges its runs with a loser tree that keeps
the common prefix with the last suffix put out and never compares within it.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfcast.llm import common
from shelfcast.llm.common import stage
from shelfcast.llm.repeats import SPANS, Alphabet, Repeats, spans_table, stretches

WINDOW = 100
GRAM = 40
# Documents and places in each from which the ranges of the first bytes are set.
RANGE_DOCUMENTS = 2000
RANGE_PLACES = 32
RUN_BYTES = 8 << 20
RUNS = "shard int, lcp binary, tail_n binary, tails binary, left_n binary, lefts binary, d binary, x binary, spans binary"


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (differ.bit_length() + 7) // 8


def common_suffix(a: bytes, b: bytes) -> int:
    return common_prefix(a[::-1], b[::-1])


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Common prefix with the string before, and the rest, of sorted strings."""
    lcp = [0, *map(common_prefix, strings, strings[1:])] if strings else []
    return lcp, [s[n:] for s, n in zip(strings, lcp, strict=True)]


def merge_runs(runs: list[tuple[list[int], list[bytes]]]) -> Iterator[tuple[int, int, int]]:
    """(run, index, common prefix with the string before) in the order of the strings.

    runs: common prefixes and whole strings, each run sorted. In the tree a loser
    keeps its common prefix with the last winner. The longer of two prefixes wins
    unseen; equal ones are compared from there on.
    """
    leaves = 1
    while leaves < len(runs):
        leaves *= 2
    at = [0] * leaves
    text = [strings[0] if strings else None for _, strings in runs] + [None] * (leaves - len(runs))
    prefix = [0 if t is not None else -1 for t in text]
    loser = [0] * leaves

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; sets the loser's common prefix with the winner."""
        if prefix[a] != prefix[b]:
            return (a, b) if prefix[a] > prefix[b] else (b, a)
        known = prefix[a]
        if known < 0:
            return a, b
        s, t = text[a], text[b]
        both = known + common_prefix(s[known:], t[known:])
        if s[both:] <= t[both:]:
            prefix[b] = both
            return a, b
        prefix[a] = both
        return b, a

    def build(node: int) -> int:
        if node >= leaves:
            return node - leaves
        won, loser[node] = play(build(2 * node), build(2 * node + 1))
        return won

    top = build(1)
    while prefix[top] >= 0:
        yield top, at[top], prefix[top]
        at[top] += 1
        lcps, strings = runs[top]
        if at[top] < len(strings):
            text[top], prefix[top] = strings[at[top]], lcps[at[top]]
        else:
            text[top], prefix[top] = None, -1
        node = (top + leaves) // 2
        while node:
            other = loser[node]
            mine, its = prefix[top], prefix[other]
            if its > mine:
                loser[node], top = top, other
            elif its == mine and mine >= 0:
                top, loser[node] = play(top, other)
            node //= 2


def _ranges(docs: DataFrame, shards: int) -> list[bytes]:
    """First bytes at which ranges start, from a bounded sample of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in common.rows(batches, "text"):
            keys = []
            for text in texts:
                data = text.encode()
                step = max(1, len(data) // RANGE_PLACES)
                keys += [data[i : i + 8] for i in range(0, len(data), step)]
            yield pa.record_batch({"key": pa.array(keys, pa.binary())})

    sample = docs.where("text is not null").select("text").limit(RANGE_DOCUMENTS)
    keys = sorted(bytes(r.key) for r in sample.mapInArrow(run, "key binary").collect())
    return sorted({keys[len(keys) * i // shards] for i in range(1, shards)}) if keys else []


class _Run:
    """Suffixes of a task: equal ones once, at their least place; the rest are removed."""

    def __init__(self, ranges: list[bytes]):
        self.ranges, self.least, self.spans, self.size = ranges, {}, {}, 0

    def add(self, left: bytes, right: bytes, doc_id: int, anchor: int) -> None:
        place, had = (doc_id, anchor), self.least.setdefault((right, left), (doc_id, anchor))
        if had == place:
            self.size += len(left) + len(right)
            return
        if place < had:
            self.least[right, left] = place
            place = had
        start = place[1] - len(left)
        self.spans.setdefault((right, place[0]), []).append((start, place[1] + len(right)))

    def batch(self) -> pa.RecordBatch:
        out, shard = [], {}
        for key in sorted(self.least):
            shard.setdefault(bisect_right(self.ranges, key[0]), []).append(key)
        removed = {}
        for (right, doc_id), found in self.spans.items():
            mine = removed.setdefault(bisect_right(self.ranges, right), [])
            mine += [(doc_id, a, b) for a, b in found]
        for k, keys in shard.items():
            lcp, tails = front_code([right for right, _ in keys])
            places = np.array([self.least[key] for key in keys], np.int64)
            out.append(
                (
                    k,
                    np.array(lcp, np.uint8).tobytes(),
                    np.array([len(t) for t in tails], np.uint8).tobytes(),
                    common.squeeze(b"".join(tails)),
                    np.array([len(left) for _, left in keys], np.uint8).tobytes(),
                    common.squeeze(b"".join(left for _, left in keys)),
                    common.pack_ids(places[:, 0]),
                    common.planes(places[:, 1].astype(np.uint64)),
                    np.array(removed.get(k, []), np.int64).tobytes(),
                )
            )
        columns = list(zip(*out, strict=True)) or [[]] * 9
        names = [x.split()[0] for x in RUNS.split(", ")]
        kinds = [pa.int32()] + [pa.binary()] * 8
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _cut(lengths: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(lengths, np.uint8), dtype=np.int64).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _decode(row: dict) -> tuple:
    lcp = list(row["lcp"])
    strings, last = [], b""
    for n, tail in zip(lcp, _cut(row["tail_n"], common.unsqueeze(row["tails"])), strict=True):
        last = last[:n] + tail
        strings.append(last)
    lefts = _cut(row["left_n"], common.unsqueeze(row["lefts"]))
    d = common.unpack_ids(row["d"]).tolist()
    x = common.from_planes(row["x"], np.uint64).tolist()
    return lcp, strings, lefts, d, x


def _resolve(group: list[tuple], lcp: int, window: int, removed: dict) -> None:
    """Windows of suffixes with one anchor gram that start earlier in another of them.

    group: (doc_id, anchor, left, right). At distance o before the anchor a window
    is the last o bytes of left and the first window - o of right.
    """
    if len(group) == 1:
        return
    group = sorted(set(group))  # a repeated row brings the same place again
    if len(group) == 2:
        (_, _, l0, r0), (d, x, l1, r1) = group
        near = max(window - lcp, window - len(r0), window - len(r1), 0)
        far = min(common_suffix(l0, l1), len(l0), len(l1))
        if near <= far:
            removed.setdefault(d, []).append((x - far, x - near + window))
        return
    seen = set()
    for d, x, left, right in group:
        for o in range(window - len(right), len(left) + 1):
            key = left[len(left) - o :] + right[: window - o]
            if key in seen:
                removed.setdefault(d, []).append((x - o, x - o + window))
            else:
                seen.add(key)


def _merge(window: int, gram: int):
    def merge(table: pa.Table) -> pa.Table:
        rows, removed = table.to_pylist(), {}
        runs = [_decode(row) for row in rows]
        for row in rows:
            for d, a, b in np.frombuffer(row["spans"], np.int64).reshape(-1, 3).tolist():
                removed.setdefault(d, []).append((a, b))
        group, least = [], window
        for r, i, prefix in merge_runs([(lcp, strings) for lcp, strings, *_ in runs]):
            if prefix < gram:
                _resolve(group, least, window, removed)
                group, least = [], window
            else:
                least = min(least, prefix)
            _, strings, lefts, d, x = runs[r]
            group.append((d[i], x[i], lefts[i], strings[i]))
        _resolve(group, least, window, removed)
        return pa.Table.from_batches([spans_table(removed)])

    return merge


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> tuple[Repeats, DataFrame]:
    """What is known of docs, and staged (doc_id, spans): byte spans that start earlier elsewhere."""
    alphabet = Alphabet(words=False, window=window, gram=gram)
    repeats = Repeats(docs, alphabet)
    shards = common.width(docs.sparkSession)
    ranges = _ranges(docs, shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Run(ranges)
        for ids, texts, places in common.rows(batches, "doc_id", "text", "p", bound=1 << 20):
            lists = [(t or "").encode() for t in texts]
            for row, s in stretches(alphabet, ids, lists, places):
                data = lists[row]
                held.add(data[s.first : s.anchor], data[s.anchor : s.last + window], s.doc_id, s.anchor)
            if held.size >= RUN_BYTES:
                yield held.batch()
                held = _Run(ranges)
        yield held.batch()

    runs = repeats.candidates().select("doc_id", "text", "p").mapInArrow(run, RUNS)
    return repeats, stage(runs.groupBy("shard").applyInArrow(_merge(window, gram), SPANS), "byte-spans")


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte of a text (UTF-8) goes if a string of ``window`` bytes over it also
    starts earlier: in a smaller doc_id, or before in the same text. Null texts
    are empty; texts shorter than the window stay whole. Rows with a null doc_id
    stay whole; repeated rows get the same answer each; one doc_id with several
    texts raises ValueError. Other columns of docs are not read.
    """
    repeats, spans = repeated_bytes(docs, window, gram)

    def apply(text: str | None, data: bytes, removed: list) -> tuple:
        n = sum(b - a for a, b in removed)
        return len(data), n, len(removed), hashlib.sha256(kept_bytes(data, removed)).hexdigest()

    return repeats.with_spans(repeats.docs, spans, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", apply).drop("text")
