"""Operators on single texts and pages, against brute force or the libraries themselves."""

import itertools
import math
import random
import re
import textwrap
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from shelfcast.llm import decontaminate, language, licenses, quality, segment, simhash, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  a  b ", "the cat\n sat", "▁x ▁▁y", "é日本 <s>x</s>\t\0", "word " * 3000, "x" * 5000,
    "the cat\n sat", "Ａ　z   ",
]
DOCS = "doc_id long, text string, n_tokens int, h string, spans string"


def table(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, 1, "h", "s") for i, t in enumerate(texts)] + [(None, "no id", 1, "h", "s")], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS)


def test_token_counts_equal_the_library(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: r for r in tokens.token_counts(docs, MODEL, limit=100).collect()}
    for i, text in [*enumerate(TEXTS), (None, "no id")]:
        n = len(library.encode(text or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 100)
    assert tokens.token_counts(docs.limit(0), MODEL).count() == 0


def test_parts_equal_the_library_on_random_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    with open(MODEL, "rb") as f:
        parts = tokens.PartCounts(f.read())
    rng = random.Random(3)
    letters = [*" aebt the▁\n\t", "é", "  ", "日", "\0", "ing", "<s>"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert parts.count(text) == len(library.encode(text)), text
    assert parts.splits and parts.whole["the"] == 1


def test_segmentations_give_the_text_back(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = segment.sampled_segmentations(docs.unionByName(docs.where("doc_id = 4")), MODEL, k=3).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert all(r.decoded for r in rows)
    for i, text in enumerate(TEXTS):
        for r in by_doc[i]:
            assert library.decode(r.ids) == (text or "").replace("▁", " ")
    assert [len(r.ids) for r in by_doc[0]] == [0] and by_doc[0][0].inclusion == 0
    assert len({tuple(r.ids) for r in by_doc[7]}) == 3
    again = sorted((r.sample, tuple(r.ids)) for r in by_doc[4])
    assert again == sorted(2 * again[::2])  # a repeated row draws the same
    assert [r.score for r in by_doc[7]] == sorted((r.score for r in by_doc[7]), reverse=True)


def test_sampling_is_without_replacement_and_unbiased(monkeypatch):
    monkeypatch.setattr(segment, "LISTED", 2)  # most spellings come from the lattice itself
    with open(MODEL, "rb") as f:
        s = segment.Spellings(f.read())
    entries = segment.Encoder(s).entries("the andle")
    spelled = []
    for e in entries:
        text, edges, onward = s.lattice(s.of[e])

        def walk(a, path, w, text=text, edges=edges, onward=onward):
            if a == len(text):
                yield tuple(path), w - onward[0]
            else:
                for b, x in edges[a]:
                    yield from walk(b, [*path, x], w + s.weight[x])

        spelled.append(list(walk(0, [], 0.0)))
    chance = {
        tuple(i for path, _ in c for i in path): np.exp(sum(w for _, w in c)) for c in itertools.product(*spelled)
    }
    assert abs(sum(chance.values()) - 1) < 1e-9
    first, estimate, runs = {}, 0.0, 6000
    for r in range(runs):
        drawn = segment.sample(entries, s, 3, np.random.default_rng(r))
        keys = [tuple(ids.tolist()) for ids, *_ in drawn]
        assert len(set(keys)) == 3
        assert all(abs(np.log(chance[k]) - log_p) < 1e-6 for k, (_, log_p, _, _) in zip(keys, drawn, strict=True))
        first[keys[0]] = first.get(keys[0], 0) + 1
        estimate += sum(np.exp(log_p - inclusion) for _, log_p, _, inclusion in drawn)
    assert abs(estimate / runs - 1) < 0.02  # inverse inclusion weights count all mass once
    for k, n in first.items():
        assert abs(n / runs - chance[k]) < 0.03


@pytest.mark.parametrize("listed", [2, 6])
def test_spellings_cross_the_merged_pieces_of_a_word(monkeypatch, listed):
    monkeypatch.setattr(segment, "LISTED", listed)
    with open(MODEL, "rb") as f:
        s = segment.Spellings(f.read())
    assert len(s.library.encode("rewh")) > 1

    def spelled(text):
        if not text:
            yield ()
        for n in range(1, len(text) + 1):
            if (i := s.piece.get(text[:n])) is not None:
                yield from ((i, *rest) for rest in spelled(text[n:]))

    weight = {ids: np.exp(sum(s.weight[i] for i in ids)) for ids in spelled("▁rewh")}
    out = segment.sample(segment.Encoder(s).entries("rewh"), s, 50, np.random.default_rng(0))
    assert sorted(tuple(ids.tolist()) for ids, *_ in out) == sorted(weight) and all(i == 0 for *_, i in out)
    for ids, log_p, _, _ in out:
        assert np.exp(log_p) == pytest.approx(weight[tuple(ids.tolist())] / sum(weight.values()))
    # the inclusion score weighs each spelling by its chance in the full lattice
    estimate = [sum(np.exp(p - i) for _, p, _, i in segment.sample(segment.Encoder(s).entries("rewh"), s, 2, np.random.default_rng(r))) for r in range(4000)]
    assert abs(np.mean(estimate) - 1) < 0.03


def test_all_segmentations_when_there_are_few():
    with open(MODEL, "rb") as f:
        s = segment.Spellings(f.read())
    out = segment.sample(segment.Encoder(s).entries("\n"), s, 5, np.random.default_rng(0))
    assert sum(np.exp(log_p) for _, log_p, _, _ in out) == pytest.approx(1) and all(i == 0 for *_, i in out)


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["the", "of"] * 15
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [text(30) for _ in range(6)] + [text(2), text(30)]
    edited = [w if i % 7 else "changed" for i, w in enumerate(items[1])]
    moved = items[2][:10] + ["put", "in"] + items[2][10:20] + items[2][22:]
    lists = [text(80), text(40) + items[0] + text(40), text(9) + edited, moved + text(5), text(50) + items[3][:12] + text(50)]
    lists += [text(5) + items[7]] * 30 + [[]]
    docs = spark.createDataFrame([(i, " ".join(x).upper() + ".", "x") for i, x in enumerate(lists)] + [(99, None, "x")], "doc_id long, text string, gram string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(8, None), (9, "")], "item_id long, text string")
    code = {}
    ids = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    want = {
        (d, i)
        for d, x in enumerate(lists) for i, item in enumerate(items)
        if len(item) >= 3 and x and decontaminate.align(ids(item), ids(x))[0] >= decontaminate.SCORE * len(item)
    }
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == want and {(1, 0), (2, 1), (3, 2), (5, 7), (34, 7)} <= want
    assert (got[1, 0].score, got[1, 0].first_word, got[1, 0].n_words) == (1.0, 40, 30)
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_edited_copies_beside_many_verbatim_ones_are_found(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shapes = [(50, 6), (20, 6), (30, 4), (12, 4), (6, 4)]  # words of an item; every so many are replaced
    items = [text(n) for n, _ in shapes]
    lists = [text(40) + item + text(40) for item in items for _ in range(20)]
    lists += [text(30) + [w if (i + 1) % every else f"new{i}" for i, w in enumerate(item)] + text(30)
              for item, (_, every) in zip(items, shapes, strict=True)]
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lists)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    code = {}
    ids = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    want = {
        (d, i) for d, x in enumerate(lists) for i, item in enumerate(items)
        if decontaminate.align(ids(item), ids(x))[0] >= decontaminate.SCORE * len(item)
    }
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == want and {(100, 0), (101, 1), (102, 2)} <= want


def test_quality_learns_only_from_its_folds(spark):
    rng = random.Random(1)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}!!" for i in range(40)]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad) for _ in range(30))) for i in range(300)]
    docs = spark.createDataFrame([*rows, (300, None), (301, ""), (None, "g1 g2 g3")], "doc_id long, text string")
    docs = docs.selectExpr("*", "5 as score", "'x' as label")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (301, None, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    import zlib

    for i in range(300):
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    assert all(got[i].predicted == int(i % 3 > 0) for i in range(300) if got[i].held_out)
    assert got[300].score == got[301].score and 0 <= got[300].score <= 1 and not got[None].held_out
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    same = {r.doc_id: r.score for r in quality.quality_scores(docs, flipped).collect()}
    assert all(same[i] == got[i].score for i in same)
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs, np.zeros(257, np.float32)).columns == ["doc_id", "text", "label", "score", "predicted"]


def test_fingerprints_against_brute_force(spark):
    import hashlib

    rng = random.Random(2)
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    texts += [texts[3], texts[3] + " tail", None, "", "one", "ß日" * 9]
    ids = [i * 1000 for i in range(len(texts))]
    docs = spark.createDataFrame([(i, t, 7) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, block int")
    got = {r.doc_id: r for r in simhash.document_fingerprints(docs).collect()}
    down = sorted(ids, reverse=True)
    text = {i: t or "" for i, t in zip(ids, texts, strict=True)}
    prints = {i: int(got[i].fingerprint, 16) for i in ids}
    for a, b in zip(down, down[1:] + down[:1], strict=True):
        n = len(text[a])
        edited = text[a][: n - n // 3] + text[b][: n // 3]
        assert got[a].n_chars == n and got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[a].near_next == pytest.approx(1 - (prints[a] ^ prints[b]).bit_count() / simhash.BITS)
        near = sum((prints[a] ^ prints[x]).bit_count() <= simhash.RADIUS for x in ids) - 1
        assert got[a].near_docs == (near if a % 50 == 0 else None)
    assert got[3000].fingerprint == got[40000].fingerprint and prints[42000] == prints[43000] == 0
    assert simhash.document_fingerprints(docs.limit(0)).count() == 0
    alone = simhash.document_fingerprints(docs.where("doc_id = 3000").unionByName(docs.where("doc_id = 3000"))).collect()
    assert len(alone) == 2 and {r.near_next for r in alone} == {1.0}


def test_licenses_are_inherited_from_the_nearest_folder(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/COPYING.txt", "some words\nLicensed under CC BY 4.0."),
        ("a/x.py", "print"), ("a/b/c/y.py", ""), ("a/b/z.py", "# Licensed under the Apache License, Version 2.0."),
        ("q/n.py", None), ("q/m.py", "we talk of permission to enter"), (None, "Released under the MIT License."),
        ("ab/x.py", "x"), ("a/x.py", "print"), ("a/long.py", "word " * 20000),
    ]
    files = spark.createDataFrame([(*r, "mine") for r in rows], "path string, text string, license string")
    got = {r.path: r for r in licenses.scan(files).collect()}
    assert licenses.scan(files).count() == len(rows)
    assert (got["a/x.py"].license, got["a/x.py"].origin, got["a/x.py"].from_path) == ("MIT", "inherited", "a/LICENSE")
    assert (got["a/b/c/y.py"].license, got["a/b/c/y.py"].from_path) == ("CC-BY-4.0", "a/b/COPYING.txt")
    assert (got["a/b/z.py"].license, got["a/b/z.py"].origin) == ("Apache-2.0", "header")
    assert got["a/LICENSE"].origin == "file" and got["a/long.py"].origin == "inherited"
    assert all(got[p].origin == "none" and got[p].license is None for p in ("q/n.py", "q/m.py", "ab/x.py", None))
    assert licenses.scan(files.limit(0)).count() == 0


def test_notices_are_found_wrapped_and_whole(spark):
    wrap = lambda text, width, mark="# ": "\n".join(mark + x for x in textwrap.wrap(text, width))
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    own = "\nimport os\nprint(os.getcwd(), 'some words of the file', 12)\n"
    year = "Copyright (c) 2020, A. N. Other\n\n"
    bsd2, bsd3 = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][2]
    want = {
        "s/gpl2.py": ("GPL-2.0", wrap(gpl.format(2), 72) + own), "s/gpl3.c": ("GPL-3.0", "int a;\n\n" + wrap(gpl.format(3), 66, " * ") + own),
        "s/mpl.js": ("MPL-2.0", wrap(mpl, 70, " * ") + own), "s/mit.py": ("MIT", "# SPDX-License-Identifier: MIT" + own),
        "s/only.py": ("GPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only" + own), "s/later.py": ("LGPL-2.1", "// SPDX-License-Identifier: LGPL-2.1-or-later" + own),
        "t/1/LICENSE": ("GPL-3.0", "          GNU GENERAL PUBLIC LICENSE\n            Version 3, 29 June 2007\n\n" + "words of the long text " * 300),
        "t/2/LICENSE.md": ("MPL-2.0", "Mozilla Public License Version 2.0\n======\n\nDefinitions\n"),
        "t/3/LICENSE": ("BSD-2-Clause", year + wrap(bsd2, 76, "")), "t/4/LICENSE": ("BSD-3-Clause", year + wrap(bsd3, 76, "")),
        "t/5/COPYING": ("ISC", year + wrap(licenses.TEMPLATES["ISC"][2], 76, "")), "t/6/LICENSE": ("MIT", year + wrap(licenses.TEMPLATES["MIT"][4], 76, "")),
        "s/apache.py": ("Apache-2.0", wrap(licenses.TEMPLATES["Apache-2.0"][2], 70) + own),
        "u/a.py": (None, "# SPDX-License-Identifier: Zlib" + own), "u/b.py": (None, "he gave permission for use of the copy, and a warranty"),
        "u/c.py": (None, "copyright 2020 by the author"),
    }
    files = spark.createDataFrame([(p, text) for p, (_, text) in want.items()], "path string, text string")
    got = {r.path: r for r in licenses.scan(files).collect()}
    assert {p: r.license for p, r in got.items()} == {p: x for p, (x, _) in want.items()}
    # the cosine of the best stretch, computed apart
    split = lambda text: [w for w in re.split(r"[^a-z0-9.]+|\.+(?![a-z0-9])", text.lower()) if w]
    notices = [(x, Counter(split(t))) for x, texts in licenses.TEMPLATES.items() for t in texts]
    holds = Counter(w for _, n in notices for w in n)
    idf = lambda w: math.log((1 + len(notices)) / holds.get(w, 1))
    size = lambda v: math.sqrt(sum((n * idf(w)) ** 2 for w, n in v.items()))
    cosine = lambda v, n: sum(v[w] * n[w] * idf(w) ** 2 for w in v) / size(v) / size(n) if v else 0.0
    for path, (_, text) in want.items():
        lines, best = text.split("\n"), (0.0, "")
        stretches = ["\n".join(lines[max(0, i - a) : i - a + n]) for i in range(len(lines)) for a, n in licenses.STRETCHES]
        stretches += [re.split(r"\n[ \t]*\n", text.lstrip(" "), maxsplit=1)[0]] + [text] * path.startswith("t/")
        for stretch in stretches:
            if any(re.search(rf"(?i)\b{c}\b", stretch) for c in licenses.CUES):
                best = max(best, *((round(cosine(Counter(split(stretch)), n), 9), x) for x, n in notices))
        assert got[path].license is None and best[0] < licenses.COSINE or got[path].cosine == pytest.approx(best[0], abs=2e-9)
    assert licenses.scan(files, templates={"X": ("alpha beta license",)}).where("license is not null").count() == 0


def test_ties_of_licenses_go_to_the_last_name(spark):
    files = spark.createDataFrame([("a/LICENSE", "alpha license\nbeta license"), ("a/LICENSE.txt", "alpha license"), ("a/x", "")], "path string, text string")
    got = {r.path: r for r in licenses.scan(files, templates={"B": ("beta license",), "A": ("alpha license",)}).collect()}
    assert got["a/LICENSE"].license == "B" and got["a/LICENSE.txt"].license == "A"
    assert (got["a/x"].license, got["a/x"].from_path) == ("B", "a/LICENSE")


def test_language_evidence_is_fused(spark):
    en, de = "the house and the garden of the old man with his dog ", "der garten und das haus des alten mannes mit dem hund "
    docs = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda lang, text: f"<html lang='{lang}'><script>the the</script><body>{text}</body></html>"
    rows = [(i, "http://www.a.de/x", page("de", de)) for i in range(20)] + [(i, "http://b.com/", page("en", en)) for i in range(20, 40)]
    rows += [(40, "http://www.a.de/y", page("", "")), (41, "http://other.a.de/", "<p></p>"), (42, None, page("en", "")), (43, None, None),
             (44, "http://www.a.de/z", page("de", en)), (44, "http://www.a.de/z", page("de", en))]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    assert language.identify(pages, docs).count() == len(rows)
    assert all(got[i].lang == "de" for i in range(20)) and all(got[i].lang == "en" for i in range(20, 40))
    assert got[40].lang == "de" and got[40].declared is None and got[40].host == "www.a.de"  # its host
    assert got[41].lang == "de" and got[42].lang == "en"  # its domain, its markup
    assert got[44].text_lang == "en" and 0 <= got[43].probability <= 1
    assert language.identify(pages.limit(0), docs).count() == 0
    assert {r.lang for r in language.identify(pages, docs.limit(0)).collect()} == {None}


def test_rare_languages_are_learned(spark):
    names = [f"l{i:02}" for i in range(70)]
    word = lambda i: chr(97 + i % 26) * (3 + i // 26)
    rows = [(j, (word(0) + " ") * 9, "l00") for j in range(300)] + [(1000 + i, (word(i) + " ") * 9, x) for i, x in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, counts = language.train(docs, sample=5, languages=70)
    assert languages == names and counts.shape[0] == 70
    # a language beyond its sample counts only so many documents
    grams = lambda n: np.bincount(language.trigrams((word(0) + " ") * 9), minlength=counts.shape[1]) * n + 0.5
    assert np.allclose(counts[0], np.log(grams(5) / grams(5).sum()))
    few = docs.where("lang < 'l08'")
    pages = spark.createDataFrame([(i, None, f"<p>{(word(i) + ' ') * 9}</p>") for i in range(8)], "page_id long, url string, html string")
    assert {r.page_id: r.text_lang for r in language.identify(pages, few).collect()} == dict(enumerate(names[:8]))
    with pytest.raises(ValueError, match="languages"):
        language.train(docs, languages=69)


def test_posterior_against_a_loop(spark):
    text = ["the house and the garden ", "der garten und das haus ", "la maison et le jardin "]
    docs = spark.createDataFrame([(i, text[i % 3] * 3, "abc"[i % 3]) for i in range(30)], "doc_id long, text string, lang string")
    rng = random.Random(4)
    rows = [(i, f"http://{rng.choice(['x.', 'y.', ''])}{rng.choice('pqr')}.{rng.choice(['de', 'fr'])}/", rng.choice(["", "aa", "bb"]),
             " ".join(rng.choice(" ".join(text).split()) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [rows[0], (60, rows[0][1], "", "the garten " * 400)]
    pages = spark.createDataFrame([(i, u, f'<html lang="{m}"><p>{t}</p></html>') for i, u, m, t in rows], "page_id long, url string, html string")
    languages, table = language.train(docs)
    seen = []
    for i, url, markup, words in rows:
        found = language.trigrams(words)
        log_p = table[:, found].sum(axis=1) * min(1, language.FULL / max(1, len(found)))
        p = np.exp(log_p - log_p.max())
        host = url[7:-1]
        seen.append((i, p / p.sum(), markup, [host.split(".")[-1], ".".join(host.split(".")[-2:]), host]))
    got = {r.page_id: r for r in language.identify(pages, docs).collect()}
    for k, (i, own, markup, levels) in enumerate(seen):
        others = [x for j, x in enumerate(seen) if j != k]
        sums = lambda keep: sum((x[1] for x in others if keep(x)), np.zeros(3))  # noqa: B023, E731
        everything = sums(lambda x: True)
        prior = (everything + 1) / (everything.sum() + 3)
        for level in range(3):
            mine = sums(lambda x: x[3][level] == levels[level])  # noqa: B023
            prior = (mine + language.SMOOTHING * prior) / (mine.sum() + language.SMOOTHING)
        w = own * prior
        if markup:
            w = w * (sums(lambda x: x[2] == markup) + 1) / (everything + 3)  # noqa: B023
        assert got[i].probability == pytest.approx(w.max() / w.sum()) and got[i].lang == languages[int(w.argmax())]


def test_leaks_do_not_depend_on_other_documents(spark):
    rng = random.Random(6)
    items = [[f"i{i}w{rng.randrange(10**6)}" for _ in range(n)] for i, n in enumerate((11, 12, 13, 16, 20, 30))]
    # a word put in after every second word, but for one row of three words that stays
    spread = lambda x: [w for i, word in enumerate(x) for w in ([word, f"n{i}"] if i % 2 and i != 3 else [word])]
    copies = [(i, f"{'pre ' * 9}{' '.join(spread(x))} post") for i, x in enumerate(items)]
    plain = [(100 + i, f"some {' '.join(x)} more") for i, x in enumerate(items)] * 3
    bench = spark.createDataFrame([(i, " ".join(x), 1) for i, x in enumerate(items)], "item_id long, text string, doc_id int")
    schema = "doc_id long, text string"
    pairs = lambda rows, **more: {
        (r.doc_id, r.item_id): (r.score, r.first_word, r.n_words)
        for r in decontaminate.contaminated(spark.createDataFrame(rows, schema), bench, **more).collect()
    }
    code = {}
    ids = lambda ws: np.array([code.setdefault(w, len(code)) for w in ws])
    want = {(i, i) for i, x in enumerate(items) if decontaminate.align(ids(x), ids(spread(x)))[0] >= decontaminate.SCORE * len(x)}
    alone, beside = pairs(copies), pairs(copies + plain)
    assert set(alone) == want and len(want) >= 3
    assert {p: beside[p] for p in alone} == alone and len(beside) == len(alone) + len(items)
    # a null id, repeated rows, a very long text, items in many slices
    long = [(7, "word " * 40000 + " ".join(items[5]) + " word" * 9), (None, " ".join(items[0]))]
    again = pairs([*copies, *copies, *plain, *long], bound=20)
    assert again.pop((7, 5)) == (1.0, 40000, 30) and again == beside


def test_words_enough_for_a_score_are_never_missed():
    rng = np.random.default_rng(3)
    for _ in range(400):
        item = rng.integers(0, 12, rng.integers(3, 14))
        text = np.concatenate([rng.integers(0, 20, rng.integers(0, 30)), np.delete(item, rng.integers(0, len(item))), rng.integers(0, 20, 5)])
        score = rng.choice([0.3, 0.5, 0.8, 1.0])
        if decontaminate.align(item, text)[0] >= score * len(item):
            assert decontaminate.enough(item, text, score)


def test_samples_do_not_depend_on_what_is_remembered(spark, docs, monkeypatch):
    read = lambda: sorted((r.doc_id is None, r.doc_id or 0, r.sample, tuple(r.ids), r.log_p, r.inclusion) for r in segment.sampled_segmentations(docs, MODEL).collect())
    whole = read()
    with open(MODEL, "rb") as f:
        data = f.read()
    monkeypatch.setattr(segment, "ROWS", 40)
    monkeypatch.setattr(segment, "PARTS", 3)
    s = segment.Spellings(data)
    encoder, again = segment.Encoder(s), []
    for r in docs.collect():
        entries = encoder.entries((r.text or "").replace("▁", " "))
        rng = np.random.Generator(np.random.Philox(key=[segment.SEED, (-1 if r.doc_id is None else r.doc_id) & (1 << 64) - 1]))
        for i, (ids, log_p, _, inclusion) in enumerate(segment.sample(entries, s, 2, rng)):
            again.append((r.doc_id is None, r.doc_id or 0, i, tuple(ids.tolist()), log_p, inclusion))
    assert s.gone > 0 and sorted(again) == whole
    assert segment.sampled_segmentations(docs.limit(0), MODEL).count() == 0


def test_lattice_has_every_piece_at_every_place():
    with open(MODEL, "rb") as f:
        s = segment.Spellings(f.read())
    rng = random.Random(1)
    for _ in range(40):
        text = "▁" + "".join(rng.choice("theandringoslmé日") for _ in range(rng.randint(0, 20)))
        if not set(text) <= set(s.piece):
            continue
        _, edges, onward = s.lattice(text)
        want = [[(b, s.piece[text[a:b]]) for b in range(a + 1, len(text) + 1) if text[a:b] in s.piece] for a in range(len(text))]
        assert edges == want
        back = [0.0] * (len(text) + 1)
        for a in range(len(text) - 1, -1, -1):
            back[a] = np.logaddexp.reduce([s.weight[e] + back[b] for b, e in want[a]])
        assert np.allclose(back, onward)


def _spelled(s, texts):
    """Draws of each text by an encoder of these spellings, the entries of all texts made at once."""
    entries = segment.Encoder(s).all_entries(texts)
    drawn = segment.sample_all(entries, s, 2, [np.random.default_rng(i) for i in range(len(texts))])
    return [[(ids.tolist(), *numbers) for ids, *numbers in found] for found in drawn]


def test_equal_ends_of_words_share_their_rows():
    with open(MODEL, "rb") as f:
        s = segment.Spellings(f.read())
    encoder = segment.Encoder(s)
    encoder.all_entries(["the handle", "a candle andle"])
    # the, handle, a, candle and andle with their blanks: the ends of handle hold those of the others
    assert s.up_to.n == len({w[i:] for w in ["▁the", "▁handle", "▁a", "▁candle", "▁andle"] for i in range(len(w))})
    before = s.up_to.n
    encoder.all_entries(["scandle"])
    assert s.up_to.n == before + 2
    texts = ["the handle", "", "a candle andle\nscandle", "  two  blanks ", "the scandle handle"]
    alone = [segment.sample(encoder.entries(text), s, 2, np.random.default_rng(i)) for i, text in enumerate(texts)]
    assert _spelled(s, texts) == [[(ids.tolist(), *numbers) for ids, *numbers in found] for found in alone]


@pytest.mark.parametrize("bits", [0, 2, 5])
def test_ends_of_one_hash_keep_rows_of_their_own(monkeypatch, bits):
    with open(MODEL, "rb") as f:
        data = f.read()
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("theandr") for _ in range(rng.randint(1, 9))) for _ in range(30)) for _ in range(12)]
    want = _spelled(segment.Spellings(data), texts)
    whole = segment.Cut.ends
    monkeypatch.setattr(segment.Cut, "ends", lambda self: whole(self) % np.uint64(1 << bits) + np.uint64(1))
    s = segment.Spellings(data)
    assert _spelled(s, texts) == want
    assert [_spelled(s, [x])[0] for x in texts[:1]] == want[:1]
    for i, text in enumerate(texts):  # one after another, against rows that are there
        found = segment.sample(segment.Encoder(s).entries(text), s, 2, np.random.default_rng(i))
        assert [(ids.tolist(), *numbers) for ids, *numbers in found] == want[i]


def test_fingerprints_keep_rows_of_one_id(spark):
    texts = [(50, "one two three four"), (50, "five six seven"), (50, "one two three four"), (100, "eight nine"), (None, "x")]
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in texts], "doc_id long, text string, nth int, block int")
    got = simhash.document_fingerprints(rows).collect()
    assert len(got) == len(texts)
    prints = {(r.doc_id, r.n_chars): (r.fingerprint, r.near_docs) for r in got}
    assert prints[50, 18][1] == 1 and prints[50, 14][1] == 0 and prints[100, 10][1] == 0
    same = [r for r in got if r.n_chars == 18]
    assert len(same) == 2 and same[0].fingerprint == same[1].fingerprint


def test_pipeline_stage_keeps_columns_called_like_its_own(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", "cast(doc_id as string) as score", "doc_id * 2 as predicted")
    kept = corpus_pipeline.quality_filter(spark, docs, small)
    assert kept.columns == docs.columns and dict(kept.dtypes)["score"] == "string"
    rows = kept.collect()
    assert rows and all(r.score == str(r.doc_id) and r.predicted == 2 * r.doc_id for r in rows)
    assert corpus_pipeline.quality_filter(spark, docs.limit(0), small).count() == 0
