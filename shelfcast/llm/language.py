"""Language ID of web pages by Bayesian fusion of evidence.

Likelihoods of the text (character trigrams), of the language that the markup
declares and of the address suffix meet a prior of the host, which is smoothed by
its domain, its suffix and all pages. The tables behind declarations, suffixes and
hosts are grouped sums of what the texts alone say, less the page's own share.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import MULTIPLIER, mix, rows, stage

HASH_BITS = 15
# Bounds: labelled documents of each language learned from, trigrams of a text that count in full,
# languages (their likelihoods are broadcast, 256 kB each).
SAMPLE = 1000
FULL = 300
SMOOTHING = 5.0
LANGUAGES = 64
_HIDDEN = re.compile(r"(?is)<(script|style|nav|footer|head)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def visible(html: str | None) -> str:
    """Text of a page without markup, scripts, navigation and footers."""
    return entities.unescape(_HIDDEN.sub(" ", html or ""))


def trigrams(text: str) -> np.ndarray:
    """Hashed character trigrams of the words of a text, in lower case."""
    codes = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-32-le"), np.uint32)
    codes = codes.astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.int64)
    gram = (codes[:-2] * MULTIPLIER + codes[1:-1]) * MULTIPLIER + codes[2:]
    return (mix(gram) >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages, and log-likelihoods by language and trigram, from labelled documents.

    At most ``sample`` documents (doc_id, text, lang) of each language, least hash
    first, so a rare language is learned as a frequent one is. More than ``languages``
    languages raise an error. Sums of fixed size come to the driver.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(languages + 1).collect()}
    names = sorted(sizes)
    if len(names) > languages:
        raise ValueError(f"more than {languages} languages: the bound is a parameter")
    if not names:
        return [], np.zeros((0, 1 << HASH_BITS))
    # a share of each language that holds some four times its sample goes on to be ordered
    below = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 40, (sample << 42) // n + 1))])
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < below[F.col("lang")])
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = known.withColumn("place", F.row_number().over(first)).where(F.col("place") <= sample)
    known = F.broadcast(known.select("doc_id", "lang").distinct())  # bounded by both parameters
    picked = docs.where("text is not null").join(known, ["doc_id", "lang"], "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for langs, texts in rows(batches, "lang", "text"):
            for lang, text in zip(langs, texts, strict=True):
                total.setdefault(lang, np.zeros(1 << HASH_BITS, np.int64))
                total[lang] += np.bincount(trigrams(text), minlength=1 << HASH_BITS)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "gram", "n"])

    summed = picked.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = np.full((len(names), 1 << HASH_BITS), 0.5)
    place = {lang: i for i, lang in enumerate(names)}
    found = summed.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("all")).toLocalIterator()
    for lang, table in found:  # a row of at most 2^15 entries for each language
        counts[place[lang], [x.gram for x in table]] += [x.n for x in table]
    return names, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_evidence(pages: DataFrame, languages: list[str], table: np.ndarray) -> DataFrame:
    """page_id, declared, host, domain, suffix, and for each language t_<n>: its posterior by the text alone."""
    shared = pages.sparkSession.sparkContext.broadcast(table)  # size fixed by the hash and the languages
    names = [f"t_{i}" for i in range(len(languages))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, htmls, declared, hosts in rows(batches, "page_id", "html", "declared", "host"):
            out = np.zeros((len(ids), len(names)))
            for i, page in enumerate(htmls):
                found = trigrams(visible(page))
                log_p = shared.value[:, found].sum(axis=1) * min(1.0, FULL / max(1, len(found)))
                p = np.exp(log_p - log_p.max())
                out[i] = p / p.sum()
            columns = [pa.array(ids, pa.int64()), pa.array(declared, pa.string()), pa.array(hosts, pa.string())]
            yield pa.record_batch([*columns, *(pa.array(c) for c in out.T)], names=["page_id", "declared", "host", *names])

    markup = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\slang\s*=\s*[\"']?([a-z]{2})", 1))
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    given = pages.select("page_id", "html", F.coalesce(markup, F.lit("")).alias("declared"), F.coalesce(host, F.lit("")).alias("host"))
    schema = "page_id long, declared string, host string, " + ", ".join(f"{n} double" for n in names)
    scored = given.mapInArrow(run, schema)
    labels = F.split("host", r"\.")
    domain = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host"))
    return scored.select("*", domain.alias("domain"), F.element_at(labels, -1).alias("suffix"))


def identify(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared, host) for every row of pages.

    pages (page_id, url, html, ...), docs (doc_id, text, lang, ...). Missing markup,
    addresses or texts are evidence of nothing: null and empty pages go by their host
    and declaration. Ties go to the first language by name. Repeated rows count each;
    all rows of a labelled document in the sample teach. Without labelled documents lang is null.
    """
    languages, table = train(docs, sample, languages)
    if not languages:
        none = F.lit(None).cast("string")
        return pages.select("page_id", none.alias("lang"), F.lit(None).cast("double").alias("probability"),
                            none.alias("text_lang"), none.alias("declared"), none.alias("host"))
    n = len(languages)
    seen = stage(text_evidence(pages, languages, table), "page-text")
    t = [F.col(f"t_{i}") for i in range(n)]

    def sums(by: list[str], tag: str) -> DataFrame:
        return seen.groupBy(*by).agg(*[F.sum(t[i]).alias(f"{tag}_{i}") for i in range(n)])

    joined = seen
    for by, tag in ((["host", "domain", "suffix"], "h"), (["domain", "suffix"], "d"), (["suffix"], "s"), (["declared"], "m")):
        joined = joined.join(sums(by, tag), by)
    # one row for all pages
    joined = joined.join(F.broadcast(seen.agg(*[F.sum(t[i]).alias(f"a_{i}") for i in range(n)])))

    def less(tag: str, i: int) -> Column:
        """Sum over the other pages."""
        return F.greatest(F.col(f"{tag}_{i}") - t[i], F.lit(0.0))

    joined = joined.withColumns({f"{tag}_all": sum((less(tag, i) for i in range(n)), F.lit(0.0)) for tag in "asdh"})

    def total(tag: str) -> Column:
        return F.col(f"{tag}_all")

    prior = [(less("a", i) + 1.0) / (total("a") + n) for i in range(n)]
    for tag in ("s", "d", "h"):
        prior = [(less(tag, i) + SMOOTHING * p) / (total(tag) + SMOOTHING) for i, p in enumerate(prior)]
    # the suffix is the first level of the prior, the declaration a likelihood of its own
    declared = [(less("m", i) + 1.0) / (less("a", i) + n) for i in range(n)]
    weight = [
        t_ * p * F.when(F.col("declared") == "", F.lit(1.0)).otherwise(d) for t_, p, d in zip(t, prior, declared, strict=True)
    ]
    joined = joined.select("page_id", "declared", "host", *[w.alias(f"w_{i}") for i, w in enumerate(weight)], *t)

    def best(tag: str) -> Column:
        options = [F.struct(F.col(f"{tag}_{i}").alias("w"), F.lit(-i).alias("i"), F.lit(x).alias("lang")) for i, x in enumerate(languages)]
        return F.array_max(F.array(*options))

    everything = sum((F.col(f"w_{i}") for i in range(n)), F.lit(0.0))
    empty = F.lit("")
    return joined.select(
        "page_id", best("w")["lang"].alias("lang"), (best("w")["w"] / everything).alias("probability"),
        best("t")["lang"].alias("text_lang"), F.nullif("declared", empty).alias("declared"), F.nullif("host", empty).alias("host"),
    )
