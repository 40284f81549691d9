"""Whitening and hard negatives against numpy, line dedup against plain Python."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from shelfcast.llm import lines, negatives, whitening
from tests.oracle_check import connect, same

VECTORS = "vec_id long, embedding array<float>, label int, x string, score int, n int"


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS)


def odd_rows(rng, n=260, width=6):
    """Ties, repeated rows, nulls everywhere and entries that are not finite."""
    rows = [(i, [rng.choice([-0.5, -0.25, 0.0, 0.004, 0.25, 0.5, 1.0]) for _ in range(width)], rng.randrange(4)) for i in range(n)]
    rows += rows[:40]
    bad = [(900, None, 1), (1000, [None] * width, 2), (1001, [float("nan")] * width, 1), (1002, [float("inf")] * width, 1)]
    return rows + bad + [(None, rows[3][1], 1), (1100, rows[5][1], None), (1400, [0.5, 0.25], 3), (1500, [], 0)]


def floors(vector):
    if vector is None or any(c is None or not np.isfinite(c) for c in vector):
        return None
    return [int(np.floor(256 * float(np.float32(c)))) for c in vector]


def mined(rows):
    """The contract by loops."""
    known = set()
    for i, vector, label in rows:
        if i is not None and label is not None and floors(vector) is not None:
            known.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(floors(vector))))
    out = []
    for i, label, x in known:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j, other) for j, other, y in known if j != i)
        for p, j, other in [s for s in scored if s[2] == label][:5]:
            near = [(s, k) for s, k, other in scored if other != label and 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_equal_loops(spark, monkeypatch, seed):
    rows = odd_rows(random.Random(seed))
    if seed == 2:  # many sets of rows and anchors, several blocks of each
        monkeypatch.setattr(negatives, "ROWS", 400)
        monkeypatch.setattr(negatives, "ANCHORS", 6)
        monkeypatch.setattr(negatives, "BLOCK", 16)
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = negatives.hard_negatives(vector_table(spark, rows)).select(*columns).collect()
    assert sorted(map(tuple, got)) == mined(rows) != []


def test_products_of_any_size_are_exact():
    a = np.array([[2.0**31, 3.0], [1.0, -1.0]])
    b = np.array([[2.0**31, 1.0], [5.0, 7.0]])
    assert negatives._product(a, b).tolist() == [[2**62 + 3, 5 * 2**31 + 21], [2**31 - 1, -2]]


def test_negatives_of_empty_tables_and_hot_labels(spark):
    rows = vector_table(spark, [(i, [0.5, i / 1000], 3) for i in range(0, 301)])
    assert negatives.hard_negatives(rows.limit(0)).count() == 0
    assert negatives.hard_negatives(rows.where("vec_id % 100 > 0")).count() == 0
    assert negatives.hard_negatives(rows.where("vec_id % 7 > 0")).count() == 0  # one label alone


def test_hard_negatives_equal_sql(spark, small):
    got = entry.queries()["op12_hard_negatives"](spark, small).toPandas()
    assert not same(got, connect(small).sql(entry.oracle_sql()["op12_hard_negatives"]).df())


def model_of(xs):
    """n, S, eigenvalues and vectors by exact integers and numpy."""
    fit = np.array(sorted(set(map(tuple, xs))), object)
    n, s = len(fit), fit.sum(axis=0)
    centred = n * fit - s
    v = np.array([[int(c) / n**3 for c in row] for row in centred.T @ centred])
    values, basis = np.linalg.eigh(v)
    return n, s, values[::-1], basis[:, ::-1], np.trace(v)


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(0)
    vectors = np.float32(rng.normal(size=(300, 7)) * [1, 0.5, 3, 0.1, 2, 0.7, 40])
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(vectors)]
    rows += rows[:50] + [(None, rows[0][1], None), (901, None, 1), (902, [1.0, None] + [0.0] * 5, 1), (903, [float("inf")] * 7, 1), (904, [2.0, 1.0], 1)]
    kept = [(i, floors(v) + [0] * (7 - len(v))) for i, v, _ in rows if floors(v)]
    n, s, values, basis, trace = model_of([x for _, x in kept])
    got = whitening.whiten(vector_table(spark, rows)).collect()
    assert len(got) == 4 * len(kept) and {r.n for r in got} == {n} and {r.component for r in got} == {1, 2, 3, 4}
    by_id = defaultdict(lambda: defaultdict(list))
    for r in got:
        by_id[r.vec_id][r.component].append(r)
        assert r.identity_error < 1e-9 and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
    signs = [np.sign(by_id[0][k + 1][0].whitened * ((n * np.array(kept[0][1]) - s) @ basis[:, k])) for k in range(4)]
    for i, x in kept:
        centred = n * np.array(x, object) - s
        for k in range(4):
            for r in by_id[i][k + 1]:
                assert r.deviation == sum(c * c for c in centred)
                z = float(centred.astype(float) @ basis[:, k]) / n / np.sqrt(values[k])
                assert r.whitened * signs[k] == pytest.approx(z, abs=1e-9)
    assert len(by_id[0][1]) == 2  # a repeated row keeps its own results


@pytest.mark.parametrize("most", [1, 9, 300, 1 << 30])
def test_cross_products_are_exact(most):
    y = np.random.default_rng(most).integers(0, most, (777, 5))
    y[:, 2] = 0
    sums, products = whitening.cross_products(y)
    wide = y.astype(object)
    assert sums.tolist() == wide.sum(axis=0).tolist() and products.tolist() == (wide.T @ wide).tolist()


def test_whitening_without_variance(spark):
    same_rows = vector_table(spark, [(i, [0.5, 0.25], 1) for i in range(5)])
    got = whitening.whiten(same_rows).collect()
    assert len(got) == 10 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = whitening.whiten(vector_table(spark, [(i, [i / 4, 0.25], 1) for i in range(5)])).collect()
    assert {r.whitened is None for r in line if r.component == 1} == {False}
    assert {r.whitened for r in line if r.component == 2} == {None} and line[0].identity_error < 1e-9
    assert whitening.whiten(same_rows.limit(0)).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, [], 1), (2, None, 1)])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(vector_table(spark, [(1, [1e12], 1)]))


def test_whitening_of_wide_sums(spark):
    rows = [(i, [float(2**31 - 2**8 * i), 0.5 * i], 1) for i in range(40)]
    got = whitening.whiten(vector_table(spark, rows)).where("component = 1").collect()
    n, s, *_ = model_of([floors(v) for _, v, _ in rows])
    for r in got:
        exact = sum((n * x - t) ** 2 for x, t in zip(floors(rows[r.vec_id][1]), s))
        assert r.deviation == (exact if exact < 1 << 63 else None)


SPACE = " \t\n\x0b\f\r"
DOCS = "doc_id long, text string, lines string, h0 long, dropped int, n_lines int"


def line_table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], DOCS)


def without_lines(rows, least):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if i is not None:
                docs[key(line)].add(i)
    often = {k for k, found in docs.items() if k and len(found) >= least}
    out = []
    for i, text in rows:
        cut = (text or "").split("\n")
        kept = [line for line in cut if key(line) not in often]
        out.append((i, "\n".join(kept), len(cut), len(cut) - len(kept)))
    return sorted(out, key=str)


def line_rows(rng):
    common = ["Share this", " share THIS\t", "É", "é", "x ", "x", "", "  ", "İ", "a\rb", "\x0bq\x0c"]
    rows = [(i, "\n".join(rng.choice([*common, f"own {i}", f"few {i % 9}", f"many {i % 4}"]) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    rows += rows[:15] + [(3, "another text\nshare this"), (None, "Share this\nfew 1"), (None, None), (70, None), (71, ""), (72, "\n"), (73, "Share this")]
    return rows + [(74, "\n".join(["Share this", "own"] * 40_000))]


@pytest.mark.parametrize("batches, fanout, heavy", [(1, 2, 1 << 16), (4, 2, 40), (7, 3, 10)])
def test_line_dedup_equals_loops(spark, monkeypatch, batches, fanout, heavy):
    monkeypatch.setattr(lines, "HEAVY", heavy)  # with few heavy lines the join by hash has work too
    rows = line_rows(random.Random(batches))
    got = lines.line_dedup(line_table(spark, rows), batches=batches, fanout=fanout).collect()
    assert sorted(map(tuple, got), key=str) == without_lines(rows, 10)


def test_line_dedup_of_few_rows(spark):
    assert lines.line_dedup(line_table(spark, []), batches=2).count() == 0
    got = lines.line_dedup(line_table(spark, [(1, "a\nb"), (2, "B ")]), least=2, batches=2).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 2, 1), (2, "", 1, 1)]


def test_runs_are_levelled_and_joined_without_a_shuffle(spark):
    runs = lines.LineRuns(spark, buckets=4, least=3, fanout=2)
    batch = lambda *rows: spark.createDataFrame(list(rows), "h0 long, h1 long, docs long")
    runs.add(batch((1, 1, 2), (2, 2, 1)))
    runs.add(batch((1, 1, 1), (3, 3, 1)))
    assert [n for _, n in runs.levels] == [0, 1]  # two runs became one of the next level
    table = runs.levels[1][0]
    assert sorted(map(tuple, spark.table(table).collect())) == [(1, 1, 3), (2, 2, 1), (3, 3, 1)]
    runs.add(batch((1, 1, 9), (2, 2, 1)))
    # the key known to be frequent was left out of the new run
    assert sorted(map(tuple, spark.table(runs.levels[0][0]).collect())) == [(2, 2, 1)]
    merged = spark.table(table).groupBy("h0", "h1").sum("docs")._jdf.queryExecution().toString()
    assert "Exchange" not in merged.split("Physical Plan")[1]
    runs.add(batch((2, 2, 1)))
    assert sorted(map(tuple, runs.frequent().collect())) == [(1, 1), (2, 2)]


def test_line_dedup_equals_sql(spark, small):
    got = entry.queries()["op13_line_dedup"](spark, small).toPandas()
    assert not same(got, connect(small).sql(entry.oracle_sql()["op13_line_dedup"]).df())
    empty = hashlib.sha256(b"").hexdigest()
    assert empty not in set(got[got.n_lines > got.n_dropped].kept_sha256)
