"""The queries of the training-data operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm import decontaminate, jaccard, language, licenses, lines, negatives, phrases, quality, segment, simhash, suffixes, tokens, whitening

MODEL = "piece_bpe_32k.model"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), model_path())


def op2_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document; the ids as their number and a hash."""
    rows = segment.sampled_segmentations(read(spark, sf_dir, "documents"), model_path())
    ids = (F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))
    return rows.select("doc_id", "sample", *ids, "log_p", "score", "inclusion", "decoded")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(read(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source / sixty-fours / eights / file.

    The first document of eight stands in for the licence file of its folder, the
    first of sixty-four for that of the folder above.
    """
    i = F.col("doc_id")
    top, low = F.floor(i / 64), F.floor(i / 8)
    path = (
        F.when(i % 64 == 0, F.concat_ws("/", "source", top.cast("string"), F.lit("LICENSE")))
        .when(i % 8 == 0, F.concat_ws("/", "source", top.cast("string"), low.cast("string"), F.lit("LICENSE")))
        .otherwise(F.concat_ws("/", "source", top.cast("string"), low.cast("string"), i.cast("string")))
    )
    files = read(spark, sf_dir, "documents").select("doc_id", "text", path.alias("path"))
    found = licenses.scan(files.select("path", "text"))
    return files.select("doc_id", "path").join(found, "path")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents"))


def op10_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_dedup(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(read(spark, sf_dir, "embeddings"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them have; the kept text as its hash."""
    found = lines.line_dedup(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_segmentations,
        op3_decontamination,
        op4_jaccard_join,
        op5_suffix_dedup,
        op6_license_scan,
        op7_quality,
        op8_fingerprints,
        op9_language_id,
        op10_phrase_dedup,
        op11_whitening,
        op12_hard_negatives,
        op13_line_dedup,
    )
}
SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LINE_DEDUP = f"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM cut),
keyed AS (
  SELECT *, translate(trim(line, {SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
frequent AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent f ON keyed.key = f.key GROUP BY doc_id"""

HARD_NEGATIVES = """
WITH kept AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS alike, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM kept a JOIN kept r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT alike
  AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5"""

ORACLES: dict[str, str] = {"op12_hard_negatives": HARD_NEGATIVES, "op13_line_dedup": LINE_DEDUP}
