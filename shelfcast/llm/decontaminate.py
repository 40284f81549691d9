"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The items are held by the tasks in slices of a bounded size. Every n-gram of an item
that a document holds is a seed, however common it is: an edited copy may share only
those that verbatim copies made common. What a seed opens is aligned with the item word
by word, unless the words near it are too few for the wanted score. So a document's rows
depend on it and the items alone, never on other documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import concat, stage

N = 3
# Words by which a copy may be shifted beside its edits.
SHIFT = 16
SCORE = 0.5
GAP = 1
# Words of items that a task holds at once: more take further passes over the documents.
WORDS = 1 << 21
# Bits of the table that sifts the n-grams of documents.
SIEVE_BITS = 22
SIEVE_SHIFT = np.uint64(64 - SIEVE_BITS)
# Seeds of a text that are placed at once.
HITS = 1 << 20
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(values: np.ndarray, n: int = N) -> np.ndarray:
    if len(values) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(values) - n + 1, np.uint64)
    for i in range(n):
        out = out * common.MULTIPLIER + values[i : len(values) - n + 1 + i]
    return common.mix(out)


class Items:
    """Test items as word hashes, with the places of their n-grams in order of the n-grams."""

    def __init__(self, ids: list[int], texts: list[str], n: int = N):
        cache = common.HashCache()
        self.ids, self.words = ids, [common.hashes(words(t), cache) for t in texts]
        found = [grams(w, n) for w in self.words]
        gram = concat(found, np.uint64)
        order = np.argsort(gram, kind="stable")
        self.gram = gram[order]
        self.item = np.repeat(np.arange(len(ids)), [len(g) for g in found])[order]
        self.at = concat((np.arange(len(g)) for g in found), np.int64)[order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[(gram >> SIEVE_SHIFT).astype(np.int64)] = True

    def seeds(self, texts: list[np.ndarray], n: int = N) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number of each text that holds n-grams of items, with their places in it and the n-grams."""
        ends = np.cumsum([len(t) for t in texts])
        gram = grams(concat(texts, np.uint64), n)
        at = np.flatnonzero(self.sieve[(gram >> SIEVE_SHIFT).astype(np.int64)])
        at = at[np.isin(gram[at], self.gram)]
        row = np.searchsorted(ends, at, side="right")
        inside = at + n <= ends[row]
        at, row = at[inside], row[inside]
        cuts = np.flatnonzero(np.diff(row)) + 1
        for places in np.split(at, cuts) if len(at) else ():
            r = int(np.searchsorted(ends, places[0], side="right"))
            yield r, places - (ends[r] - len(texts[r])), gram[places]

    def near(self, pos: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Item, start and end of each stretch of a text around its seeds; stretches of an item may touch."""
        low, high = np.searchsorted(self.gram, gram), np.searchsorted(self.gram, gram, side="right")
        for part in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(np.cumsum(high - low) // HITS)) + 1):
            times = high[part] - low[part]
            entry = np.repeat(low[part] - np.cumsum(times) + times, times) + np.arange(times.sum())
            item, shift = self.item[entry], np.repeat(pos[part], times) - self.at[entry]
            order = np.lexsort((shift, item))
            item, shift = item[order], shift[order]
            slack = self.sizes[item] // 2 + SHIFT
            apart = np.flatnonzero((np.diff(item) != 0) | (np.diff(shift) > (self.sizes[item] + 2 * slack)[1:])) + 1
            first, last = np.r_[0, apart], np.r_[apart, len(item)] - 1
            if len(item):
                start = np.maximum(0, shift[first] - slack[first])
                end = shift[last] + self.sizes[item[last]] + slack[last]
                yield from zip(item[first].tolist(), start.tolist(), end.tolist(), strict=True)

    def leaks(self, texts: list[np.ndarray], score: float) -> Iterator[tuple[int, int, float, int, int]]:
        """Number of the text, item, score, first word and number of words of each item that a text holds."""
        for row, pos, gram in self.seeds(texts):
            text, spans = texts[row], {}
            for i, a, b in self.near(pos, gram):
                if enough(self.words[i], text[a:b], score):
                    spans.setdefault(i, []).append((a, b))
            for i, found in spans.items():
                best = (0, 0, 0)
                for a, b in _merged(found):
                    s, x, y = aligned(self.words[i], text[a:b])
                    if s > best[0]:
                        best = (s, a + x, a + y)
                if best[0] >= score * self.sizes[i]:
                    yield row, self.ids[i], best[0] / int(self.sizes[i]), best[1], best[2] - best[1]


def enough(item: np.ndarray, text: np.ndarray, score: float) -> bool:
    """Whether some stretch as long as an alignment of that score can be holds words enough for it.

    The score takes ``score`` of the item's words as matches, and each word of the text
    beside them takes one off, so no such alignment covers more words than twice the item
    has less that share.
    """
    held = np.isin(text, item)
    total = np.concatenate([[0], np.cumsum(held)])
    width = len(item) + int((1 - score) * len(item)) + 1
    return int((total[min(width, len(text)) :] - total[: max(1, len(total) - width)]).max()) >= score * len(item)


def slices(items: DataFrame, bound: int) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of the items, about ``bound`` words at a time; of several texts of an id the least."""
    items = items.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    total = items.agg(F.sum(F.size(F.split("text", r"\W+", -1)).cast("long"))).first()[0] or 0
    parts = -(-total // bound)
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        yield [r.item_id for r in part], [r.text for r in part]


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score and where it ends in item and text.

    A match adds one, a mismatch or a gap takes one.
    """
    ramp = np.arange(len(text) + 1) * GAP
    row, best = np.zeros(len(text) + 1, np.int64), (0, 0, 0)
    for i, word in enumerate(item):
        new = np.zeros_like(row)
        new[1:] = np.maximum(row[:-1] + np.where(text == word, 1, -1), row[1:] - GAP)
        new = np.maximum.accumulate(np.maximum(new, 0) + ramp) - ramp
        j = int(new.argmax())
        if new[j] > best[0]:
            best = (int(new[j]), i + 1, j)
        row = new
    return best


def aligned(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best score and the span of text it covers."""
    score, i, j = align(item, text)
    _, _, back = align(item[:i][::-1], text[:j][::-1])
    return score, j - back, j


def contaminated(docs: DataFrame, items: DataFrame, score: float = SCORE, bound: int = WORDS) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words): passages of docs that hold a test item.

    docs (doc_id, text, ...), items (item_id, text, ...). Words are runs of letters,
    digits and underscores, in lower case. score is the alignment score over the
    words of the item, kept from ``score`` on; the span counts words of the document.
    Null ids and texts match nothing, nor do items of fewer than three words. Repeated
    documents or items give one row per pair of ids. No items: no rows. Items of more
    than ``bound`` words take a pass over the documents for each so many.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, score double, first_word long, n_words long"

    def search(ids: list[int], texts: list[str]) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))  # a slice

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, cache = Items(*shared.value), common.HashCache()
            for numbers, found in common.rows(batches, "doc_id", "text"):
                out = [(numbers[row], *leak) for row, *leak in held.leaks([common.hashes(words(t), cache) for t in found], score)]
                columns = list(zip(*out, strict=True)) or [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                names = ["doc_id", "item_id", "score", "first_word", "n_words"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        return docs.mapInArrow(run, schema)

    # each slice's rows are written before the next slice is read
    rows = [stage(search(*part), "leaks") for part in slices(items, bound)]
    rows = reduce(DataFrame.unionByName, rows) if rows else docs.sparkSession.createDataFrame([], schema)
    best = rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "first_word", "n_words")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
