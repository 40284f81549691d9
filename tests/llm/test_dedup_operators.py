"""Operators on pairs and passages against brute force, and the pipeline end to end."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from shelfcast.llm import common, graph, jaccard, phrases, recurring, repeats, suffixes


def made(seed: int) -> list:
    """Documents with copies, edited copies, shared passages and repeats inside one text."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    base, passage = text(120), text(45)
    lists = [text(60) for _ in range(8)] + [base] * 3
    lists += [[w if rng.random() > 0.02 else "edit" for w in base] for _ in range(12)]
    lists += [text(rng.randint(0, 30)) + passage + text(rng.randint(0, 30)) for _ in range(12)]
    lists += [passage + text(5) + passage, ["a"] * 70, ["a"] * 65, text(3), ["A", "b"], ["a", "B"], text(2500), base[:100] + text(4)]
    out = [" ".join(x) for x in lists]
    out += [None, "", " \n\t ", out[0].replace(" ", "\n"), out[1].upper(), "x" * 700, "x" * 650]
    order = list(range(len(out)))
    rng.shuffle(order)
    return [out[i] for i in order]


@pytest.fixture(scope="module")
def texts():
    return made(4)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "a", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [rows[5], (None, "no id " * 50, "a", 1, 2, 3)]  # a repeated row, and a row without id
    return spark.createDataFrame(rows, "doc_id long, text string, h string, n int, bucket int, spans int").repartition(5)


def test_jaccard_classes(docs, texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i * 3] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    least = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = min(least[a], least[b])
    rows = jaccard.jaccard_classes(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), least[r.doc_id])
    assert len(set(least.values())) < len(sets) - 10
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_jaccard_blocks_agree(docs, monkeypatch):
    want = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()}
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_classes(docs).collect()} == want


def test_jaccard_classes_of_a_table_united_with_itself(spark):
    rng, rows, sets = random.Random(11), [], {}
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for share in (30, 40, 50, 60, 70, 80, 95):  # words of 104 that a pair has in common
        common = text(share)
        for own in range(2):
            words = common + text(104 - share)
            sets[len(rows)] = {tuple(words[k : k + 5]) for k in range(100)}
            rows.append((len(rows), " ".join(words)))
    want = {i: i for i in sets}
    for a in range(0, len(rows), 2):
        if 100 * len(sets[a] & sets[a + 1]) >= 75 * len(sets[a] | sets[a + 1]):
            want[a + 1] = a
    assert sum(a != b for a, b in want.items()) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (docs, docs.unionByName(docs), docs.unionByName(docs).unionByName(docs)):
        found = jaccard.jaccard_classes(df).collect()
        assert len(found) == df.count() and all(r.component_id == want[r.doc_id] for r in found)


def removed(tokens: dict, window: int) -> dict:
    seen, out = set(), {}
    for i in sorted(tokens):
        t, mark = tokens[i], bytearray(len(tokens[i]))
        for q in range(len(t) - window + 1):
            key = t[q : q + window]
            if key in seen:
                mark[q : q + window] = b"\1" * window
            seen.add(key)
        out[i] = bytes(mark)
    return out


def test_suffix_dedup(docs, texts):
    data = {i * 3: (t or "").encode() for i, t in enumerate(texts)}
    marks = removed(data, 100)
    for r in suffixes.suffix_dedup(docs).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        kept = bytes(c for c, m in zip(data[r.doc_id], marks[r.doc_id], strict=True) if not m)
        spans = len(re.findall(b"\1+", marks[r.doc_id]))
        want = (len(data[r.doc_id]), sum(marks[r.doc_id]), spans, hashlib.sha256(kept).hexdigest())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, r.doc_id
    assert suffixes.suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 4000])
def test_phrase_dedup(docs, texts, monkeypatch, most):
    monkeypatch.setattr(phrases, "PHRASES", most)
    words = {i * 3: tuple((t or "").encode().split()) for i, t in enumerate(texts)}
    marks = removed(words, 20)
    rows = phrases.phrase_dedup(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is None:
            continue
        kept = b" ".join(c for c, m in zip(words[r.doc_id], marks[r.doc_id], strict=True) if not m)
        want = (len(words[r.doc_id]), sum(marks[r.doc_id]), hashlib.sha256(kept).hexdigest())
        assert (r.n_words, r.n_removed, r.kept_sha256) == want, r.doc_id
    kept = phrases.without_repeats(docs)
    assert kept.columns == docs.columns
    for r in kept.where("doc_id is not null").collect():
        words_left = b" ".join(c for c, m in zip(words[r.doc_id], marks[r.doc_id], strict=True) if not m)
        assert (r.text or "").encode() == words_left or not any(marks[r.doc_id])


def test_texts_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "c d")], "doc_id long, text string")
    for operator in (jaccard.jaccard_classes, suffixes.suffix_dedup, phrases.phrase_dedup):
        with pytest.raises(ValueError, match="several texts"):
            operator(docs)


def test_merge_of_runs_keeps_common_prefixes():
    rng = random.Random(0)
    for k in range(1, 9):
        runs = []
        for _ in range(k):
            strings = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 25)))
            lcp, tails = suffixes.front_code(strings)
            assert all(s[n:] == t for s, n, t in zip(strings, lcp, tails, strict=True))
            runs.append((lcp, strings))
        merged = [(runs[r][1][i], n) for r, i, n in suffixes.merge_runs(runs)]
        assert [s for s, _ in merged] == sorted(s for _, strings in runs for s in strings)
        for (a, _), (b, n) in zip(merged, merged[1:], strict=False):
            assert n == suffixes.common_prefix(a, b)


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(40)]
    least = {x: x for e in edges for x in e}
    for _ in range(60):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: m for x, m in least.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark, small):
    import sentencepiece

    import corpus_pipeline
    from shelfcast.llm import decontaminate, quality, queries
    from shelfcast.llm.common import stage

    docs, before = queries.read(spark, small, "documents"), None
    for i, (name, function) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(function(spark, docs, small), f"t{i}")
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if i == 0:
            weights = quality.train(before, queries.read(spark, small, "labels"))
            scores = {r.doc_id: r.score for r in quality.scored(before, weights).collect()}
            assert {r.doc_id for r in docs.collect()} == {d for d, s in scores.items() if s >= quality.THRESHOLD}
        if i == 1:
            sets = {r.doc_id: set(zip(*[r.text.lower().split()[k:] for k in range(5)], strict=False)) for r in docs.collect()}
            assert not [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
            assert 0 < docs.count() < before.count()
        if i == 2:
            words = {r.doc_id: tuple(r.text.encode().split()) for r in before.collect()}
            marks = removed(words, 20)
            for r in docs.collect():
                left = b" ".join(w for w, m in zip(words[r.doc_id], marks[r.doc_id], strict=True) if not m)
                assert b" ".join(r.text.encode().split()) == left and r.n_chars == len(r.text) or not any(marks[r.doc_id])
        if i == 3:
            items = [decontaminate.words(r.text) for r in queries.read(spark, small, "benchmark").collect()]
            leaked = set()
            for r in before.collect():
                own = " ".join(decontaminate.words(r.text))
                leaked |= {r.doc_id for item in items if " ".join(item) in own}
            kept = {r.doc_id for r in docs.collect()}
            assert leaked and not leaked & kept and len(kept) >= before.count() - 2 * len(leaked)
    library = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    text = {r.doc_id: r.text for r in before.collect()}
    rows = docs.collect()
    assert {r.doc_id for r in rows} == set(text)
    assert all(library.decode(r.ids) == text[r.doc_id].replace("▁", " ") for r in rows)


def test_pipeline_stages_of_odd_rows(spark, small):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars int, n int, p string, bucket int, spans string"
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    texts = [(1, long), (1, long), (2, long), (3, None), (4, ""), (None, other), (None, other), (5, other + " " + long), (6, "x" * 300_000)]
    rows = [(i, t, "en", "s", len(t or ""), 7, "p", 8, "s") for i, t in texts]
    docs = spark.createDataFrame(rows, schema)
    want = {
        # the copy 2 goes, 1 stays twice, and what has no id or no words stays
        "n-gram Jaccard join": [x for x in texts if x[0] != 2],
        # the words that start earlier go from 2 and 5, not from rows without id
        "substring dedup": [(2, "") if i == 2 else (5, other) if i == 5 else (i, t) for i, t in texts],
        "benchmark decontamination": texts,
    }
    for name, function in corpus_pipeline.STAGES[1:4]:
        got = function(spark, docs, small)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        found = got.collect()
        assert sorted(map(repr, ((r.doc_id, r.text) for r in found))) == sorted(map(repr, want[name])), name
        assert all((r.lang, r.source, r.n, r.p, r.bucket, r.spans) == ("en", "s", 7, "p", 8, "s") for r in found)
        assert function(spark, docs.limit(0), small).count() == 0, name
    samples = corpus_pipeline.encoded(spark, docs, small).collect()
    assert {r.doc_id for r in samples} == {i for i, _ in texts} and all(r.decoded for r in samples)
    assert corpus_pipeline.encoded(spark, docs.limit(0), small).count() == 0


def test_word_hashes():
    """Equal hashes for equal words alone, over texts of odd white space, long words and many blocks."""
    rng = random.Random(9)
    texts = ["", None, " \t ", "a\x0bB  c ", "x" * 300_000, "y" * 65 + " " + "y" * 64, "é Ü \x1c\x85 q", "\n", "A a"]
    texts += [" ".join("".join(rng.choice("abA\u00e9") for _ in range(rng.randint(1, 90))) for _ in range(4000)) for _ in range(3)]
    for lower in (False, True):
        found, counts = common.word_hashes(pa.array(texts), lower)
        split = [((t or "").encode().lower() if lower else (t or "").encode()).split() for t in texts]
        assert counts.tolist() == [len(x) for x in split]
        words = [w for x in split for w in x]
        assert len(set(zip(words, found.tolist(), strict=True))) == len(set(words)) == len(set(found.tolist()))
        part, few = common.word_hashes(pa.array(texts).slice(3, 2), lower)
        assert few.tolist() == counts[3:5].tolist() and part.tolist() == found[: len(part)].tolist()
    assert len(common.word_hashes(pa.array([None, ""], pa.string()))[0]) == 0


def test_entries_are_dealt_out_by_task(spark):
    """The rows of an exchange follow the tasks and the ranges, not the slices of the input."""
    rng = random.Random(10)
    text = " ".join(str(rng.random()) for _ in range(20_000))
    docs = spark.createDataFrame([(i, f"{i} {text}") for i in range(30)], "doc_id long, text string").coalesce(1)
    rows = jaccard._entries(docs, 5, 7).collect()  # 12 MB of text, 600,000 entries
    assert sorted(r.bucket for r in rows) == list(range(7))
    h = np.concatenate([common.unpack_sorted(r.h) for r in rows])
    assert len(h) == 30 * (20_001 - 4)
    assert len(np.unique(h)) == 20_000 - 4 + 30
    parts = [(h[i::3], np.arange(len(h[i::3])), np.zeros(len(h[i::3]))) for i in range(3)]
    assert [b.num_rows for b in recurring.pack_all(parts * 8, 7)] == [7] * 4  # 1.2 million entries in each
    assert list(recurring.pack_all([], 7)) == []


def test_anchors_are_dealt_out_by_task(spark):
    """As above for the anchors of words and of bytes, all of them in the rows of one task."""
    rng = random.Random(11)
    texts = [" ".join(rng.choice("ab") + str(rng.randint(0, 10**9)) for _ in range(60_000)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for alphabet in (repeats.Alphabet(words=True, window=20, gram=8), repeats.Alphabet(words=False, window=100, gram=40)):
        rows = repeats._entries(docs, alphabet, 5).collect()  # 8 MB of text
        assert sorted(r.bucket for r in rows) == list(range(5))
        lists = alphabet.hashed(pa.array(texts))
        places = {(p.row, int(a)): int(h) for p in repeats.pieces(lists, alphabet) for a, h in zip(p.anchors, p.hashes, strict=True)}
        found = {}
        for r in rows:
            d, p, h = common.unpack_ids(r.d), common.from_planes(r.p, np.uint32), common.unpack_sorted(r.h)
            found.update(zip(zip(d.tolist(), p.tolist(), strict=True), h.tolist(), strict=True))
            assert 0.8 < 5 * len(h) / len(places) < 1.2  # no range holds much more than another
        assert found.keys() == places.keys()
        assert len({(found[x], places[x]) for x in places}) == len(set(found.values())) == len(set(places.values()))


def test_shards_read_words():
    """Phrases of words are found at words alone, also where a word ends like another."""
    words = [f"w{i}" for i in range(24)]
    passages = [words, ["x", *words[:22]], ["x" + words[0], *words[1:]], [*words[:19], words[19] + "0", *words[20:]]]
    table = pa.table(
        {
            "gram": [7] * 4, "doc_id": [3, 1, 5, 2], "first": [10, 0, 0, 4], "passage": [" ".join(p) for p in passages],
            "copies": pa.array([[], [{"doc_id": 9, "first": 50}], [], []], pa.list_(pa.struct([("doc_id", pa.int64()), ("first", pa.int64())]))),
        }
    )
    for most in (1, 4000):
        found = phrases._shard(20, most)(table)
        spans = {d: np.frombuffer(s, np.int64).reshape(-1, 2).tolist() for d, s in zip(found["doc_id"].to_pylist(), found["spans"].to_pylist(), strict=True)}
        # doc 1 has windows 0-2 of the words first; of those from the fourth word on, doc 3 is the first and doc 5 the second
        assert spans == {3: [[10, 32]], 5: [[1, 24]], 9: [[50, 73]]}
