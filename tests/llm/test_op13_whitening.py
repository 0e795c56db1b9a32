import math

import numpy as np
import pytest

from quillgate.llm.whitening import whiten

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, components=16):
    """By the definition, with whole numbers and an eigen-decomposition in NumPy."""
    good = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    most = max((len(x) for _, x in good), default=0)
    good = [(i, x) for i, x in good if len(x) == most]
    fit = sorted({tuple(x) for _, x in good})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    c = np.array([[x - t / n for x, t in zip(v, s)] for v in fit])
    values, vectors = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-values)[:components]
    e, v = values[order], vectors[:, order]
    deviation = {tuple(x): sum((n * a - t) ** 2 for a, t in zip(x, s)) for _, x in good}
    total = sum(deviation[x] for x in fit) / n**3
    told = {}
    for i, x in good:
        told.setdefault(i, []).append((tuple(x), deviation[tuple(x)], (np.array(x) - np.array(s) / n) @ v / np.sqrt(e)))
    return n, e / total, told


def table(dims=20, n=400, seed=3):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, dims)) * np.linspace(3, 0.2, dims) + r.normal(size=dims)).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0]) for i in range(150)]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] * dims), (2002, [float("nan")] + x[1][1:]), (2003, [float("inf")] + x[1][1:]), (2004, x[2][:-1]), (2005, []), (None, x[3]), (7, x[4])]
    return rows


def test_rows(spark):
    rows = table()
    d = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as x", "2 as n", "3 as component", "4 as `a.b`", "5 as _id")
    got = whiten(d).collect()
    n, explained, told = plain(rows)
    assert len(got) == 16 * sum(map(len, told.values()))
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - explained[r.component - 1]) < 1e-9
    signs = {}
    for i, own in told.items():
        for _, deviation, w in own:
            for k in range(16):
                y = by[i, deviation][k + 1][0]
                assert abs(abs(y) - abs(w[k])) < 1e-6
                if abs(y) > 1e-3:
                    signs.setdefault(k, set()).add(np.sign(y) == np.sign(w[k]))
    assert all(len(s) == 1 for s in signs.values())


def test_whitened_covariance_is_the_identity(spark):
    rows = table(8, 300, 5)
    got = whiten(spark.createDataFrame(rows, SCHEMA)).where("vec_id < 300").collect()
    w = {}
    for r in got:
        w.setdefault((r.vec_id, r.deviation), {})[r.component] = r.whitened
    m = np.array([[v[k] for k in range(1, 9)] for v in w.values()])
    assert m.shape[1] == 8 and np.abs(np.cov(m.T, bias=True) - np.eye(8)).max() < 0.05  # row 7 stands there twice


@pytest.mark.parametrize("rows,components", [
    ([(1, [1.0, 2.0])], 0), ([(1, [1.0, 2.0]), (2, [1.0, 2.0])], 0), ([(1, None)], 0), ([], 0),
    ([(1, [1.0, 2.0, 0.0]), (2, [2.0, 4.0, 0.0])], 1), ([(i, [float(i), 0.0, float(i % 2)]) for i in range(9)], 2),
])
def test_few_directions(spark, rows, components):
    got = whiten(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert {r.component for r in got.collect()} == set(range(1, components + 1)) and got.count() == components * len(rows)
    assert all(r.identity_error < 1e-4 for r in got.collect())


def test_small_components(spark):
    """Directions whose deviations are far apart: all are found, and whitened to the identity."""
    r = np.random.default_rng(9)
    x = np.round(r.normal(size=(500, 4)) * [1e9, 1e5, 30, 0.5]).tolist()
    got = whiten(spark.createDataFrame([(i, [*v, v[0]]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    assert {q.component for q in got} == {1, 2, 3, 4} and got[0].identity_error < 1e-6
    shares = sorted({q.explained for q in got}, reverse=True)
    v = np.floor(64 * np.array([[*y, y[0]] for y in x]))
    e = np.sort(np.linalg.svd(v - v.mean(0), compute_uv=False))[::-1][:4] ** 2
    assert np.abs(np.array(shares) / (e / e.sum()) - 1).max() < 1e-4


def test_large_entries(spark):
    """Deviations beyond 64 bits are null; entries beyond 2^52 are held there."""
    rows = [(0, [1e30, 0.0]), (1, [-1e30, 1.0]), (2, [0.0, 2.0]), (3, [3.0, 5.0])]
    got = whiten(spark.createDataFrame(rows, SCHEMA)).where("component = 1").collect()
    assert len(got) == 4 and got[0].deviation is None and all(math.isfinite(r.whitened) for r in got)
    rows = [(i, [float(1000 * i), float(i % 3)]) for i in range(200)]
    n, _, told = plain(rows, 2)
    assert {(r.vec_id, r.deviation) for r in whiten(spark.createDataFrame(rows, SCHEMA)).collect()} == {(i, d) for i, own in told.items() for _, d, _ in own}
