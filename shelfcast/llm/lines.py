"""Line dedup: levelled sorted runs of line hashes, in Spark expressions only.

Documents come in batches. A run holds (h0, h1, docs): the 128-bit hash of a line's
key and the documents of its batches that have it. A level is one table bucketed and
sorted by the hash, with one sorted file per bucket and run; merging a level and
joining with it need no shuffle of what was written before. A new batch first drops,
by a merge anti-join with every level, the keys that a run already knows to be
frequent; what is left becomes a run. A full level is merged into one run of the next.
"""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import discard, stage
from shelfcast.session import ROWS_PER_BUCKET, run_folder

LEAST = 10
BATCHES = 4
FANOUT = 2
# A key that alone makes a 65,536th of a table's line entries is joined by broadcast: there are no more such rows.
HEAVY = 1 << 16
SPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY = ["h0", "h1"]


def line_keys(text: Column) -> Column:
    """The key of each line: without white space at its ends, A-Z lower-cased."""
    # lower() is that very thing for a text of ASCII alone, and faster
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.transform(F.split(folded, "\n", -1), lambda line: F.btrim(line, F.lit(SPACE)))


def _hash(*columns: str) -> list[Column]:
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def line_counts(docs: DataFrame, *by: str) -> DataFrame:
    """(by, h0, h1, docs): documents that have a line with the key. Null doc_ids do not count.

    Rows of one doc_id are one document. A frequent line is one row per document
    until the second sum, which every task starts on its own rows.
    """
    keys = docs.where("doc_id is not null").select(*by, "doc_id", F.explode(F.array_distinct(line_keys(F.col("text")))).alias("key"))
    h0, h1 = _hash("key")
    once = keys.where("key <> ''").select(*by, "doc_id", h0.alias("h0"), h1.alias("h1")).distinct()
    return once.groupBy(*by, *KEY).agg(F.count(F.lit(1)).alias("docs"))


class LineRuns:
    """Keys of the lines of all batches added, with their numbers of documents below ``least``."""

    def __init__(self, spark: SparkSession, buckets: int, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.buckets, self.least, self.fanout = spark, buckets, least, fanout
        self.levels: list[list] = []  # of each level: its table or None, and the runs in it
        self._made = 0

    def add(self, batch: DataFrame) -> None:
        """batch: (h0, h1, docs), a key once. Its documents are in no other batch."""
        fresh = batch.select(*KEY, "docs").repartition(self.buckets, *KEY)
        for table, _ in self.levels:
            if table:
                known = self.spark.table(table).where(F.col("docs") >= self.least).select(KEY)
                fresh = fresh.join(known.hint("merge"), KEY, "left_anti")
        self._append(0, fresh)

    def frequent(self) -> DataFrame:
        """(h0, h1) of the keys that ``least`` documents have: all levels merged into one run."""
        for level in range(len(self.levels)):
            if sum(runs for _, runs in self.levels[level:]) > 1:
                self._merge(level)
        last = next((table for table, _ in reversed(self.levels) if table), None)
        if last is None:
            return self.spark.createDataFrame([], "h0 long, h1 long")
        return self.spark.table(last).where(F.col("docs") >= self.least).select(KEY)

    def _append(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([None, 0])
        entry = self.levels[level]
        if entry[0] is None:
            self._made += 1
            entry[0] = f"line_runs_{uuid.uuid4().hex}_{self._made}"
        write = run.write.mode("append").bucketBy(self.buckets, *KEY).sortBy(*KEY)
        write.option("path", self._path(entry[0])).saveAsTable(entry[0])
        entry[1] += 1
        if entry[1] == self.fanout:
            self._merge(level)

    def _merge(self, level: int) -> None:
        """Sums a level by key, inside its buckets, into one run of the next level."""
        table, runs = self.levels[level]
        if not runs:
            return
        self.levels[level] = [None, 0]
        self._append(level + 1, self.spark.table(table).groupBy(*KEY).agg(F.sum("docs").alias("docs")))
        self.spark.sql(f"DROP TABLE {table}")
        discard(self.spark, self._path(table))

    def _path(self, table: str) -> str:
        return run_folder(self.spark, "llm", table)


def frequent_lines(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """Keys (h0, h1) that at least ``least`` documents have, and those of them to broadcast.

    The table is added in batches by the hash of doc_id. The second table holds keys
    that make a large part of a batch, ``HEAVY`` at most.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("batch")
    counts = stage(line_counts(docs.select("doc_id", "text", batch), "batch"), "line-counts", by="batch")
    entries, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    runs = LineRuns(spark, max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries // ROWS_PER_BUCKET + 1), least, fanout)
    for i in range(batches):
        runs.add(counts.where(F.col("batch") == i))
    frequent = stage(runs.frequent(), "frequent-lines")
    many = counts.where(F.col("docs") * HEAVY >= total).select(KEY).distinct()
    return frequent, stage(frequent.join(F.broadcast(many), KEY, "left_semi"), "heavy-lines")


def line_dedup(docs: DataFrame, least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped): every row of docs without the lines that many documents have.

    Texts are cut at line feeds; a null or empty text is one empty line. Lines whose
    key is empty stay, and so do empty texts. Rows of one doc_id are one document,
    whether they repeat or differ; rows with a null doc_id count for no line but lose
    theirs like any other. n_lines counts before dropping. A text that loses all its
    lines is empty. Other columns of docs are not read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    frequent, heavy = frequent_lines(docs, least, batches, fanout)
    s0, s1 = _hash("doc_id", "text")
    rows = docs.select("doc_id", "text", s0.alias("s0"), s1.alias("s1"))
    h0, h1 = _hash("key")
    lines = rows.select("s0", "s1", F.posexplode(line_keys(F.col("text"))).alias("place", "key")).where("key <> ''")
    lines = lines.select("s0", "s1", "place", h0.alias("h0"), h1.alias("h1"))
    lines = lines.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), KEY, "left")
    # what the broadcast has settled is dealt out by its place and meets no other key
    lines = lines.select(
        "s0", "s1", "place", "heavy",
        F.when(F.col("heavy"), F.xxhash64("s0", "place")).otherwise(F.col("h0")).alias("h0"),
        F.when(F.col("heavy").isNull(), F.col("h1")).alias("h1"),
    )
    rest = frequent.join(F.broadcast(heavy), KEY, "left_anti").withColumn("rare", F.lit(True))
    hits = lines.join(rest, KEY, "left").where("heavy or rare")
    hits = hits.groupBy("s0", "s1").agg(F.array_sort(F.collect_set("place")).alias("dropped"))
    found = rows.join(hits, ["s0", "s1"], "left").select(
        "doc_id", "text", F.split("text", "\n", -1).alias("lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )
    return found.select(
        "doc_id", F.when(F.size("dropped") == 0, F.col("text")).otherwise(_kept()).alias("text"),
        F.size("lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"),
    )


def _kept() -> Column:
    """The stretches of lines between dropped places, joined again."""
    starts, stops = F.concat(F.array(F.lit(-1)), "dropped"), F.concat("dropped", F.array(F.size("lines")))
    between = F.transform(
        F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda x: F.slice("lines", x["a"] + 2, x["b"] - x["a"] - 1)
    )
    return F.array_join(F.flatten(between), "\n")
