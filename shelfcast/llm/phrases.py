"""Substring dedup by repeated-phrase automata.

Windows of words whose anchor recurs (``repeats``) go with their neighbours to the
shard of the anchor. There windows seen in two places are confirmed as recurring
phrases, compiled into Aho-Corasick automata of a bounded number of phrases, and
every passage of the shard is streamed through them to find all occurrences.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common
from shelfcast.llm.common import stage
from shelfcast.llm.repeats import SPANS, Alphabet, Repeats, spans_table, stretches

WINDOW = 20
GRAM = 8
# Phrases of one automaton.
PHRASES = 4000
PASSAGES = "shard int, gram long, doc_id long, first long, passage string, copies array<struct<doc_id:long,first:long>>"
HELD = 8 << 20


def _locate(members: list[tuple], phrases: dict[tuple, tuple], window: int, removed: dict) -> None:
    """Streams passages through the automaton of the phrases; all but the first occurrence go."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for phrase, first in phrases.items():
        automaton.add_word(phrase, first)
    automaton.make_automaton()
    for d, start, words in members:
        for end, first in automaton.iter(words):
            at = start + end + 1 - window
            if (d, at) != first:
                removed.setdefault(d, []).append((at, at + window))


def _shard(window: int, most: int):
    def shard(table: pa.Table) -> pa.Table:
        removed: dict[int, list] = {}
        by_gram: dict[int, list] = {}
        columns = (table[c].to_pylist() for c in ("gram", "doc_id", "first", "passage"))
        for gram, d, start, passage in zip(*columns, strict=True):
            by_gram.setdefault(gram, []).append((d, start, passage))
        several = table.filter(pc.greater(pc.list_value_length(table["copies"]), 0))
        for passage, found in zip(several["passage"].to_pylist(), several["copies"].to_pylist(), strict=True):
            for c in found:
                removed.setdefault(c["doc_id"], []).append((c["first"], c["first"] + passage.count(" ") + 1))
        # the automata read words by numbers of this shard
        number: dict[str, int] = defaultdict(count().__next__)
        members: list[tuple] = []
        phrases: dict[tuple, tuple] = {}
        for group in by_gram.values():
            if len(group) == 1:
                continue
            first: dict[tuple, tuple] = {}
            again: set[tuple] = set()
            group = [(d, start, tuple(map(number.__getitem__, p.split(" ")))) for d, start, p in sorted(group)]
            for d, start, words in group:
                for i in range(len(words) - window + 1):
                    phrase = words[i : i + window]
                    if first.setdefault(phrase, (d, start + i)) != (d, start + i):
                        again.add(phrase)
            if again:
                members += group
                phrases.update((p, first[p]) for p in again)
            if len(phrases) >= most:
                _locate(members, phrases, window, removed)
                members, phrases = [], {}
        if phrases:
            _locate(members, phrases, window, removed)
        return pa.Table.from_batches([spans_table(removed)])

    return shard


def repeated_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, phrases: int = PHRASES) -> tuple[Repeats, DataFrame]:
    """What is known of docs, and staged (doc_id, spans): word spans that start earlier elsewhere."""
    alphabet = Alphabet(words=True, window=window, gram=gram)
    repeats = Repeats(docs, alphabet)
    shards = common.width(docs.sparkSession)

    def batch(held: dict) -> pa.RecordBatch:
        keys = list(held)
        places = [sorted(set(x)) for x in held.values()]  # a repeated row brings the same place again
        return pa.record_batch(
            {
                "shard": pa.array([g % shards for g, _ in keys], pa.int32()),
                "gram": pa.array([g for g, _ in keys], pa.int64()),
                "doc_id": pa.array([x[0][0] for x in places], pa.int64()),
                "first": pa.array([x[0][1] for x in places], pa.int64()),
                "passage": pa.array([p for _, p in keys], pa.string()),
                "copies": pa.array(
                    [[{"doc_id": d, "first": f} for d, f in x[1:]] for x in places],
                    pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64())])),
                ),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for part in common.slices(batches):
            ids, texts, places = (part.column(c).to_pylist() for c in ("doc_id", "text", "p"))
            lists = [alphabet.tokens(t) for t in texts]
            for row, s in stretches(alphabet, ids, alphabet.hashed(part.column("text")), places):
                passage = b" ".join(lists[row][s.first : s.last + window]).decode()
                held.setdefault((s.gram, passage), []).append((s.doc_id, s.first))
                size += len(passage)
            if size >= HELD:
                yield batch(held)
                held, size = {}, 0
        yield batch(held)

    passages = repeats.candidates().select("doc_id", "text", "p").mapInArrow(run, PASSAGES)
    found = passages.groupBy("shard").applyInArrow(_shard(window, phrases), SPANS)
    return repeats, stage(found, "word-spans")


def kept_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    out, at = [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    return out + words[at:]


def phrase_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    Words end at ASCII white space. A word goes if ``window`` consecutive words
    over it also start earlier: in a smaller doc_id, or before in the same text.
    Null texts have no words; shorter texts stay whole. Rows with a null doc_id
    stay whole; repeated rows get the same answer each; one doc_id with several
    texts raises ValueError. Other columns of docs are not read.
    """
    repeats, spans = repeated_words(docs, window, gram)

    def apply(text: str | None, words: list[bytes], removed: list) -> tuple:
        kept = b" ".join(kept_words(words, removed))
        return len(words), sum(b - a for a, b in removed), hashlib.sha256(kept).hexdigest()

    return repeats.with_spans(repeats.docs, spans, "n_words long, n_removed long, kept_sha256 string", apply).drop("text")


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, all its columns, with repeated words gone from the texts.

    Untouched texts keep their white space, others are joined by single blanks. A
    text whose words all go becomes empty; null texts stay null. The column n_chars,
    if there, is set anew.
    """
    repeats, spans = repeated_words(docs, window, gram)

    def apply(text: str | None, words: list[bytes], removed: list) -> tuple:
        return (b" ".join(kept_words(words, removed)).decode() if removed else text,)

    kept = repeats.with_spans(docs, spans, "__kept string", apply)
    values = {"text": F.col("__kept"), "n_chars": F.length("__kept").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*[values.get(c, F.col(c)).alias(c) for c in docs.columns])
