import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from castplan.llm import code_compression as C
from castplan.llm import queries, whitening
from castplan.llm import vectors as V

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark):
    return [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]


@pytest.fixture(scope="module")
def hard(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(10)], i % 3 if i % 4 else None) for i in range(60)]
    rows += [(7, rows[7][1], 1), (7, rows[8][1], None), (None, rows[9][1], None), (61, rows[9][1], 2), (61, rows[9][1], 2)]
    rows += [(100, None, 1), (101, [], 1), (102, [1.0] * 9, 1), (103, [float("nan")] * 10, 0), (104, [1.0] * 9 + [None], 0), (105, [1.0] * 9 + [float("-inf")], 0)]
    return rows


def lloyd(rows, parts=8, entries=16, rounds=6):
    """(codes, errors, label errors, digest) by plain Lloyd rounds in Python integers."""
    kept = [(i, [int(np.floor(4096 * float(np.float32(v)))) for v in x], lab) for i, x, lab in rows]
    cut = [c.tolist() for c in np.array_split(np.arange(len(kept[0][1])), parts)]
    least = {}
    for i, x, _ in sorted(kept, key=lambda r: ((1 << 63) - 1 if r[0] is None else r[0], r[1])):
        least.setdefault(i, x)
    start = list(least.values())[:entries]
    codes, books = [[] for _ in kept], []
    errors = [0] * len(kept)
    for c in cut:
        own = [[x[j] for j in c] for _, x, _ in kept]
        book = [[x[j] for j in c] for x in start]
        for k in range(rounds + 1):
            found = [min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book)) for v in own]
            if k < rounds:
                for j in range(len(book)):
                    mine = [v for v, (_, a) in zip(own, found, strict=True) if a == j]
                    if mine:
                        book[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
        books += [v for e in book for v in e]
        for r, (d, j) in enumerate(found):
            errors[r] += d
            codes[r].append(f"{j:02x}")
    label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        label[lab] = label.get(lab, 0) + e
    return [(i, "".join(c), e, label[lab]) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True)], hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


def test_op11_against_plain_lloyd(spark):
    got = queries.op11_code_compression(spark, SF).collect()
    want, digest = lloyd(table(spark))
    assert sorted((r.vec_id, r.code, r.error, r.label_error) for r in got) == sorted(want) and {r.codebooks_sha256 for r in got} == {digest}


def test_op11_hard_rows(spark, hard):
    docs = spark.createDataFrame(hard, SCHEMA).withColumn("CODE", F.lit("x")).withColumn("more", F.lit(2))
    rows, books = C.compress(docs)
    out = C.add_group_totals(rows, "label", "error", "label_error")
    assert out.columns == ["vec_id", "label", "more", "code", "error", "label_error"]
    want, digest = lloyd([r for r in hard if r[0] is None or r[0] < 100])
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in out.collect()), key=repr) == sorted(want, key=repr) and books.digest() == digest
    few, small = C.compress(spark.createDataFrame(hard[:3], SCHEMA))
    assert [r.error for r in few.collect()] == [0, 0, 0] and all(len(b) == 3 for b in small.books)
    none, books = C.compress(spark.createDataFrame([], SCHEMA))
    assert none.count() == 0 and C.add_group_totals(none, "label", "error", "label_error").count() == 0
    huge, _ = C.compress(spark.createDataFrame([(i, [float(10 ** (i % 30))] * 10, 0) for i in range(80)], SCHEMA))
    assert huge.count() == 80


def test_op11_bounds_give_exact_assignments_and_save_rescans():
    rng = np.random.default_rng(4)
    x = (rng.normal(size=(4000, 6)) * 500 + rng.integers(0, 9, 4000)[:, None] * 900).astype(np.int64)
    x[:40] = x[0]  # ties
    history, state, rescans = [[x[:16].copy()]], None, []
    for t in range(8):
        drift = None
        if t:
            moved = C.moves(history, 0, t)
            drift = (moved, C.others_most(moved))
        state, n = C.reassign(x, state, history, 0, drift)
        rescans.append(n)
        book = history[t][0]
        exact = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (state["entry"] == exact.argmin(1)).all()
        history.append([np.array([x[state["entry"] == j].sum(0) // max((state["entry"] == j).sum(), 1) if (state["entry"] == j).any() else book[j] for j in range(16)])])
    assert rescans[0] == 4000 and sum(rescans[1:]) < 4000 * 7 * 0.6


def test_op11_net_displacement_is_no_larger_than_the_sum_of_moves():
    rng = np.random.default_rng(5)
    history = [[rng.integers(-100, 100, (16, 4))] for _ in range(5)]
    steps = [np.sqrt(((history[s + 1][0] - history[s][0]) ** 2).sum(1)) for s in range(4)]
    net = C.moves(history, 0, 4)
    assert all((net[s] <= sum(steps[s:]) + 1e-9).all() for s in range(4)) and (net[0] < sum(steps) - 1).any()


def test_op11_group_totals_of_hot_and_rare_groups(spark):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN null ELSE id END AS g", "id AS v")
    got = {(r.id, r.t) for r in C.add_group_totals(rows, "g", "v", "t").collect()}
    hot = {k: sum(range(k, 6000, 3)) for k in (0, 1)}
    assert got == {(i, hot.get(i % 3, i)) for i in range(6000)}


def covariance(rows):
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(float)) + 1_000_000
    y = x - x.mean(0)
    return x.astype(int), y.T @ y / len(x)


def test_op12_against_eigh(spark):
    rows = table(spark)
    x, cov = covariance(rows)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    got = queries.op12_whitening(spark, SF).toPandas().sort_values(["vec_id", "component"])
    assert len(got) == len(rows) * 32 and set(got.component) == set(range(1, 33)) and set(got.n) == {len(rows)}
    ids = np.array([r[0] for r in rows])
    by = np.argsort(ids)
    sums = x.sum(0)
    w = got.whitened.to_numpy().reshape(len(rows), 32)
    want = ((x - sums / len(rows)) @ vectors[:, :32] / np.sqrt(values[:32]))[by]
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-8
    assert got.deviation.to_numpy().reshape(len(rows), 32)[:, 0].tolist() == [sum((len(rows) * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums, strict=True)) for i in by]
    assert np.allclose(got.explained.to_numpy()[:32], values[:32] / np.trace(cov), rtol=1e-10)
    error = np.abs(w.T @ w / len(rows) - np.outer(w.mean(0), w.mean(0)) - np.eye(32)).max()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9 and abs(got.identity_error.iloc[0] - error) < 1e-10


def test_op12_factorisation():
    rng = np.random.default_rng(6)
    for d, rank in ((1, 1), (2, 2), (7, 7), (12, 5), (40, 40)):
        m = rng.normal(size=(rank, d)) * np.logspace(0, -5, rank)[:, None]
        a = m.T @ m
        factor, order = whitening.pivoted_cholesky(a)
        assert factor.shape[1] == rank and np.allclose(factor @ factor.T, a[np.ix_(order, order)], atol=1e-12)
        assert np.allclose(factor, np.tril(factor))
        values, u = whitening.jacobi_columns(factor)
        assert np.abs(u.T @ u - np.eye(rank)).max() < 1e-13 and (np.diff(values) <= 0).all()
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:rank], rtol=1e-5)


def test_op12_hard_rows(spark, hard):
    docs = spark.createDataFrame(hard, SCHEMA).withColumn("WHITENED", F.lit("x")).withColumn("more", F.lit(2))
    got = whitening.report(docs, top=4).collect()
    kept = [r for r in hard if r[0] is None or r[0] < 100]
    assert len(got) == 4 * len(kept) and got[0].n == len(kept) and got[0].more == 2 and 0 < got[0].identity_error < 1e-9
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(5)], SCHEMA)
    assert whitening.report(same).count() == 0 and whitening.report(same.limit(0)).count() == 0
    line = whitening.report(spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0], 0) for i in range(5)], SCHEMA)).collect()
    assert len(line) == 5 and {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    far = whitening.report(spark.createDataFrame([(i, [1e38 * (-1) ** i, float(i)], 0) for i in range(6)], SCHEMA)).collect()
    assert {r.vec_id for r in far} == set(range(6)) and {r.deviation for r in far} == {None}


def test_finite_vectors(spark, hard):
    rows, dim, n = V.fit_rows(spark.createDataFrame(hard, SCHEMA), "embedding")
    assert (dim, n) == (10, 65) and rows.count() == 65
