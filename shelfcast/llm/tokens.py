"""Token counts with a whole-token shortcut.

Before any text is read, the vocabulary is proved offline: no piece goes on over a
blank that follows another character, so texts split before such blanks and the
parts are tokenized apart; and the pieces that the tokenizer itself encodes as one
token are listed. Parts on that list count one; only the rest are merged, by the
tokenizer's library, once per distinct part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm import common

BLANK = "▁"
LIMIT = 4096
REMEMBERED = 200_000
_PARTS = re.compile(r" *[^ ]+| +$")


class PartCounts(dict):
    """Tokens of each part, given without the blank it starts with."""

    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size)]
        special = (self.library.is_control, self.library.is_unknown, self.library.is_byte, self.library.is_unused)
        plain = [p for i, p in enumerate(pieces) if not any(f(i) for f in special)]
        self.splits = all(BLANK not in p.lstrip(BLANK) for p in plain)
        keys = [p[1:].replace(BLANK, " ") for p in plain if p.startswith(BLANK) and len(p) > 1]
        self.whole = {k: 1 for k, ids in zip(keys, self.library.encode(keys), strict=True) if len(ids) == 1}
        self.update(self.whole)

    def __missing__(self, part: str) -> int:
        n = len(self.library.encode(part))
        if part == "":
            # the library drops the blank of an empty text; within a text it is a token
            n = len(self.library.encode("a ")) - len(self.library.encode("a"))
        if len(part) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
                self.update(self.whole)
            self[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.splits:
            return len(self.library.encode(text))
        text = text.replace(BLANK, " ")
        parts = text.split(" ")
        if "" in parts:
            parts = [p[1:] for p in _PARTS.findall(" " + text)]
        return sum(map(self.__getitem__, parts))


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    model: path of a sentencepiece model, read on the driver and sent to the tasks.
    Counts equal the library's own, without begin or end tokens. Null texts are
    empty and have no tokens; repeated rows and null doc_ids are rows like others.
    Other columns of docs are not read.
    """
    data = Path(model).read_bytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = PartCounts(data)
        for ids, sizes, texts in common.rows(batches, "doc_id", "n_bytes", "text"):
            counts = [parts.count(t or "") for t in texts]
            yield pa.record_batch(
                {
                    "doc_id": pa.array(ids, pa.int64()),
                    "n_bytes": pa.array(sizes, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "over_limit": pa.array([c > limit for c in counts], pa.bool_()),
                }
            )

    common.small_batches(docs)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    return docs.select("doc_id", size, "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )
