"""Document fingerprints: SimHash over weighted word pairs, in Spark expressions only.

Each pair of neighbouring words votes with its weight on 126 bits, by two hashes.
Three counters of 21 bits share a long: ``shiftright(hash, j) & MASK`` picks bits j,
j + 21 and j + 42, so 21 sums of longs hold 63 counters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stage

LANE = 21
MASK = 1 | 1 << LANE | 1 << 2 * LANE
HALF = 63
BITS = 2 * HALF
# Pairs of one sum: with weights up to 2 a counter stays below 2^21.
CHUNK = 1 << 19
# Words this long are telling; a pair of them votes twice.
LONG_WORD = 4
RADIUS = 3
BLOCK = 4096
QUERY_EVERY = 50


def fingerprints(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, high, low: two halves of 63 bits of the fingerprint of each row of (keys, text).

    keys identify a row. Words end at white space. Texts without words, and null
    texts, have no votes: both halves are 0. Ties vote 0.
    """
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0B\f\r"))
    words = texts.select(*keys, F.split(trimmed, r"[ \t\n\x0B\f\r]+", -1).alias("a"))
    words = words.select(*keys, "a", F.slice("a", F.lit(2), F.size("a")).alias("b"))
    rows = words.select(*keys, F.posexplode(F.arrays_zip("a", "b")).alias("pos", "pair"))
    a, b = F.col("pair.a"), F.col("pair.b")
    telling = (F.length(a) >= LONG_WORD) & (F.length(b) >= LONG_WORD)
    weight = F.when(a == "", 0).when(telling, 2).otherwise(1).cast("long")
    rows = rows.select(
        *keys, F.floor(F.col("pos") / CHUNK).alias("chunk"), weight.alias("w"),
        F.xxhash64(a, b).alias("h0"), F.xxhash64(b, F.lit(1), a).alias("h1"),
    )
    lanes = [
        F.sum(F.shiftright(f"h{half}", j).bitwiseAND(F.lit(MASK)) * F.col("w")).alias(f"s{half}_{j}")
        for half in (0, 1)
        for j in range(LANE)
    ]
    sums = rows.groupBy(*keys, "chunk").agg(F.sum("w").alias("total"), *lanes)
    counts = [
        F.sum(F.shiftright(f"s{half}_{j}", LANE * part).bitwiseAND(F.lit((1 << LANE) - 1))).alias(f"c{half}_{j + LANE * part}")
        for half in (0, 1)
        for part in (0, 1, 2)
        for j in range(LANE)
    ]
    votes = sums.groupBy(*keys).agg(F.sum("total").alias("total"), *counts)

    def half(which: int) -> Column:
        bits = [F.when(F.col(f"c{which}_{i}") * 2 > F.col("total"), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(HALF)]
        return reduce(Column.bitwiseOR, bits)

    return votes.select(*keys, half(0).alias("high"), half(1).alias("low"))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of bits on which two fingerprints agree."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return sum(F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True))


def shown(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def with_next(docs: DataFrame) -> DataFrame:
    """(block, doc_id, nth, text, next_id, next_text): each document and the one after it.

    The order is by falling doc_id, null last, around from the last to the first;
    nth tells rows of one doc_id apart. Documents are ordered in blocks of ids; the
    first of each block is what the block before leads to. Rows stay distributed by
    block, so what is grouped by block and more needs no further shuffle.
    """
    block = F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-(1 << 62))).alias("block")
    rows = docs.select("doc_id", "text", block)
    by_id = F.desc_nulls_last("doc_id")
    inside = Window.partitionBy("block").orderBy(by_id, F.asc_nulls_last("text"))
    after = F.lead(F.struct("doc_id", "text")).over(inside)
    rows = rows.select("*", after.alias("after"), F.row_number().over(inside).alias("place"))
    # the rank of an id holds in the same sort
    rank = F.rank().over(Window.partitionBy("block").orderBy(by_id))
    rows = rows.withColumn("nth", F.col("place") - rank + 1)
    firsts = rows.where("place = 1").select("block", F.struct("doc_id", "text").alias("first"))
    # one row per block of ids
    blocks = docs.select(block).distinct()
    every = Window.orderBy(F.desc("block"))
    top = blocks.agg(F.max("block")).scalar()
    following = blocks.select("block", F.lead("block").over(every).alias("following"))
    following = following.select("block", F.coalesce("following", top).alias("following"))
    leads = following.join(firsts.withColumnRenamed("block", "following"), "following").select("block", "first")
    after = F.coalesce("after", "first").alias("after")
    rows = rows.join(leads, "block", "left").select("block", "doc_id", "nth", "text", after)
    return rows.select("block", "doc_id", "nth", "text", F.col("after.doc_id").alias("next_id"), F.col("after.text").alias("next_text"))


def near_counts(prints: DataFrame, keys: list[str], radius: int = RADIUS, every: int = QUERY_EVERY) -> DataFrame:
    """(keys, near_docs) for ids divisible by ``every``: other rows within the Hamming radius.

    prints: (keys, high, low); keys, with doc_id among them, identify a row. Fingerprints are cut into radius + 1 blocks; within
    the radius one block is equal, so a table by each block finds every pair. A pair
    counts in the first table that has it. Equal fingerprints are held as one.
    """
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]

    def block(i: int) -> Column:
        parts = []
        for half, name in ((0, "high"), (1, "low")):
            a, b = max(cuts[i], half * HALF) - half * HALF, min(cuts[i + 1], (half + 1) * HALF) - half * HALF
            if b > a:
                parts.append(F.shiftright(name, a).bitwiseAND(F.lit((1 << (b - a)) - 1)))
        return F.xxhash64(*parts) if len(parts) > 1 else parts[0]

    distinct = prints.groupBy("high", "low").agg(F.count(F.lit(1)).alias("docs"))
    asked = prints.where(F.col("doc_id") % every == 0).select("high", "low").distinct()
    blocks = F.array(*[block(i) for i in range(radius + 1)])

    def table(df: DataFrame, tag: str) -> DataFrame:
        df = df.withColumn("blocks", blocks)
        df = df.select("*", F.posexplode("blocks").alias("table", "key"))
        return df.select("table", "key", *[F.col(c).alias(f"{tag}_{c}") for c in df.columns if c not in ("table", "key")])

    pairs = table(asked, "a").join(table(distinct, "b"), ["table", "key"])
    near = distance((F.col("a_high"), F.col("a_low")), (F.col("b_high"), F.col("b_low"))) <= radius
    earlier = F.exists(
        F.slice(F.zip_with("a_blocks", "b_blocks", lambda x, y: x == y), 1, F.col("table")), lambda same: same
    )
    pairs = pairs.where(near & ~F.coalesce(earlier, F.lit(False)))
    found = pairs.groupBy(F.col("a_high").alias("high"), F.col("a_low").alias("low")).agg(F.sum("b_docs").alias("found"))
    asked_rows = prints.where(F.col("doc_id") % every == 0).select(*keys, "high", "low")
    return asked_rows.join(found, ["high", "low"]).select(*keys, (F.col("found") - 1).alias("near_docs"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """One row for every row of docs (doc_id, text, ...).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next, and near_docs: for ids divisible by 50 the number of other rows whose
    fingerprint lies within three bits. The edited text ends, for a third of its
    code points, as the next document begins (``with_next``). Null texts are empty.
    A repeated row comes before its copy; a table of one row is its own next. Of
    several texts with one doc_id the least stands for it where it is the next.
    """
    third = F.floor(F.col("n_chars") / 3).cast("int")
    rows = with_next(docs).withColumns({"text": F.coalesce("text", F.lit("")), "next_text": F.coalesce("next_text", F.lit(""))})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - third),
        F.substring(F.col("next_text"), F.lit(1), third),
    )
    keys = ["block", "doc_id", "nth", "next_id", "n_chars", "edited_sha256", "kind"]
    rows = rows.select("block", "doc_id", "nth", "next_id", "n_chars", "text", edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    rows = rows.select(*keys[:-1], F.posexplode(F.array("text", "edited")).alias("kind", "text"))
    prints = fingerprints(rows, keys)
    prints = stage(
        prints.groupBy(*keys[:-1]).agg(
            *[
                F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{name}{c}")
                for kind, name in ((0, ""), (1, "edited_"))
                for c in ("high", "low")
            ]
        ),
        "prints",
    )
    following = prints.where("nth = 1").select(
        F.col("doc_id").alias("next_id"), F.col("high").alias("next_high"), F.col("low").alias("next_low")
    )
    own, other = (F.col("high"), F.col("low")), (F.col("edited_high"), F.col("edited_low"))
    out = prints.join(following, prints["next_id"].eqNullSafe(following["next_id"])).drop(following["next_id"])
    row = ["block", "doc_id", "nth"]
    out = out.join(near_counts(prints.select(*row, "high", "low"), row), row, "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", shown(*own).alias("fingerprint"), shown(*other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, (F.col("next_high"), F.col("next_low"))).alias("near_next"),
        "near_docs",
    )
