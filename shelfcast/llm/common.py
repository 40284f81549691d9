"""Helpers of the operators: staged tables, word hashes, packed integer columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from shelfcast.session import run_folder

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


# Rows of a batch that goes to Python: texts are long, and both sides hold a batch whole.
BATCH_ROWS = 500


def small_batches(df: DataFrame) -> DataFrame:
    """Has the session hand rows to Python in batches of a few megabytes of text."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key, "10000")) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors.

    With ``by`` the values of that column have a folder each.
    """
    spark = small_batches(df).sparkSession
    path = run_folder(spark, "llm", f"{name}-{uuid.uuid4().hex}")
    write = df.write.partitionBy(by) if by else df.write
    write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(df.columns)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a folder of ``run_folder`` that no later table reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def width(spark: SparkSession) -> int:
    """Buckets of an exchange: two for each partition the session shuffles into, made odd."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions")) | 1


def width_of(spark: SparkSession, entries: int) -> int:
    """Buckets of an exchange of so many entries: two million or so in each, two for each core at least, made odd."""
    return max(2 * spark.sparkContext.defaultParallelism, entries >> 21) | 1


class HashCache(dict):
    """64-bit hash of each key, remembered up to a bound on the entries."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        self.bound = bound

    def __missing__(self, key):
        value = xxhash.xxh3_64_intdigest(key)
        if len(key) <= 64:
            if len(self) >= self.bound:
                self.clear()
            self[key] = value
        return value


def hashes(words: list, cache: HashCache) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values, in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: A value for each byte.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
# Bytes of words that are hashed at once; longer words than LONG go to xxhash, a sum of many bytes mixes less.
BYTES, LONG = 1 << 17, 64


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the multiplier from the first on, and their inverses."""
    inverse = pow(int(MULTIPLIER), -1, 1 << 64)
    return tuple(np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (MULTIPLIER, np.uint64(inverse)))


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and how many words each has.

    Words end at ASCII white space; null texts have none. With ``lower`` A-Z count as a-z.
    """
    texts = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    size, blank = pc.list_value_length(lists).to_numpy().astype(np.int64), pc.binary_length(texts).to_numpy() == 0
    size[blank] = 0  # they are split into one empty word
    found = lists.flatten()
    found = found.filter(pc.greater(pc.binary_length(found), 0)) if blank.any() else found
    if not len(found):
        return np.zeros(0, np.uint64), size
    ends = np.frombuffer(found.buffers()[1], np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    data, out, at = np.frombuffer(found.buffers()[2], np.uint8), np.empty(len(found), np.uint64), 0
    while at < len(found):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + BYTES, side="right")) - 1)
        a, b = ends[at:to] - ends[at], ends[at + 1 : to + 1] - ends[at]
        power, inverse = powers(1 << max(BYTES, int(b[-1])).bit_length())
        total = np.zeros(int(b[-1]) + 1, np.uint64)
        np.cumsum(BYTE[data[ends[at] : ends[to]]] * power[: int(b[-1])], out=total[1:])
        out[at:to] = (total[b] - total[a]) * inverse[a]
        for i in np.flatnonzero(b - a > LONG).tolist():
            out[at + i] = xxhash.xxh3_64_intdigest(data[ends[at + i] : ends[at + i + 1]].tobytes())
        at = to
    return mix(out), size


def squeeze(data: bytes) -> bytes:
    """Compressed here, so that Spark holds and moves the small form."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    size = int.from_bytes(data[:8], "little")
    return pa.Codec("zstd").decompress(data[8:], decompressed_size=size, asbytes=True)


def planes(a: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, so that small integers compress."""
    return squeeze(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    size, data = np.dtype(dtype).itemsize, unsqueeze(data)
    flat = np.frombuffer(data, np.uint8).reshape(size, len(data) // size)
    return np.ascontiguousarray(flat.T).view(dtype).ravel()


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as differences."""
    return planes(np.diff(a, prepend=np.uint64(0)).astype(np.uint64))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def pack_ids(a: np.ndarray) -> bytes:
    """Signed 64-bit values as distances from the least."""
    if not len(a):
        return b""
    least = a.min()
    return least.astype(np.int64).tobytes() + planes((a - least).astype(np.uint64))


def unpack_ids(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    least = np.frombuffer(data[:8], np.int64)[0]
    return from_planes(data[8:], np.uint64).astype(np.int64) + least


def concat(parts: Iterable[np.ndarray], dtype: type) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def slices(batches: Iterator[pa.RecordBatch], bound: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches holding about ``bound`` bytes."""
    for batch in batches:
        size = max(1, batch.num_rows * bound // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)


def rows(batches: Iterator[pa.RecordBatch], *names: str, bound: int = 4 << 20) -> Iterator[tuple]:
    """Slices of the batches holding about ``bound`` bytes, as Python lists by column."""
    for part in slices(batches, bound):
        yield tuple(part.column(name).to_pylist() for name in names)
