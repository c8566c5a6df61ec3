import numpy as np
import pytest

from folioflow.llm import feast
from folioflow.llm.whitening import whitened

SCHEMA = "vec_id long, embedding array<float>, n string"


def brute(vectors, most=32):
    """From x itself: covariance, components, deviations."""
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, q = np.linalg.eigh(y.T @ y / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(most, int((e > e[0] * 1e-12).sum())) if e[0] > 0 else 0
    deviation = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    return n, deviation, y @ q[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def check(spark, rows, dim, tolerance=1e-6):
    good = [(i, v) for i, v, _ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    n, deviation, w, explained = brute([v for _, v in good])
    got = whitened(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    k = w.shape[1]
    assert len(got) == len(good) * k and {r["n"] for r in got} <= {n}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, d) for (i, _), d in zip(good, deviation)}
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r["whitened"])
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
    assert sorted(by) == list(range(1, k + 1))
    ids = [i for i, _ in good]
    for c, values in by.items():
        mine = np.array([np.mean(values[i]) for i in ids])
        sign = np.sign(mine @ w[:, c - 1])
        np.testing.assert_allclose(sign * mine, w[:, c - 1], atol=tolerance)


def test_whitened_equals_eigendecomposition(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 40)) * np.linspace(1, 3, 40)
    rows = [(k, [float(np.float32(x)) for x in v], "x") for k, v in enumerate(base)]
    rows += [(500, None, ""), (501, [1.0] * 39 + [None], ""), (502, [float("nan")] * 40, ""), (503, [float("inf")] * 40, ""), (504, [], ""), (505, [1.0, 2.0], "")]
    check(spark, rows, 40)


def test_few_rows_repeated_rows_and_null_ids(spark):
    rng = np.random.default_rng(4)
    few = [(k, [float(np.float32(x)) for x in v], None) for k, v in enumerate(rng.standard_normal((6, 12)))]
    check(spark, few, 12)  # five components at most
    check(spark, [*few, few[2], (None, few[3][1], "q")], 12)
    same = spark.createDataFrame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")], SCHEMA)
    assert whitened(same).collect() == []
    assert whitened(same.limit(0)).collect() == [] and whitened(same.where("vec_id = 1")).collect() == []
    assert whitened(same).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_large_entries_stay_exact(spark):
    rows = [(k, [float(np.float32(x)) for x in v], "") for k, v in enumerate([[1e12, 2.0, 3.0], [-3e12, 1.0, 3.5], [2e11, 0.5, -9.0], [5e12, 7.0, 1.0]])]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    n, deviation, _, _ = brute([v for _, v, _ in rows])
    want = {(k, d if d < 1 << 63 else None) for k, d in enumerate(deviation)}
    assert {(r["vec_id"], r["deviation"]) for r in got} == want
    check(spark, [(k, [x * 1000 for x in v], "") for k, v in enumerate([[1e3, 2.0, 3.0], [-3e3, 1.0, 3.5], [2e2, 0.5, -9.0], [5e3, 7.0, 1.0]])], 3)


def matrix(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = (q * values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize(
    "values",
    [
        np.arange(1.0, 81.0),
        np.concatenate([np.full(20, 5.0), np.full(20, 3.0), np.zeros(10)]),  # many equal values, also where the 32nd lies
        np.concatenate([[1e6, 1e3], np.full(38, 1.0)]),
        np.concatenate([np.linspace(1, 1 + 1e-7, 50), [2.0]]),
        np.array([7.0]),
        np.array([2.0, 2.0]),
    ],
)
def test_contour_integration_finds_all_that_inertia_counts(values):
    v = matrix(values)
    spans = feast.intervals(v, 32)
    found = [(e, q) for low, high, n in spans for e, q in zip(*feast.eigenpairs(v, low, high, n))]
    positive = np.sort(values[values > 0])[::-1]
    assert len(found) >= min(32, len(positive))
    e, q = np.array([x for x, _ in found]), np.array([x for _, x in found])
    np.testing.assert_allclose(e, positive[: len(e)], rtol=1e-10, atol=1e-12 * values.max())
    assert np.abs(q @ q.T - np.eye(len(q))).max() < 1e-5
    assert np.abs(v @ q.T - q.T * e).max() < 1e-11 * values.max()


def test_inertia_counts_eigenvalues_above():
    v = matrix(np.array([-3.0, -1.0, 0.5, 0.5, 2.0, 9.0]))
    diagonal, off = feast.tridiagonal(v)
    assert feast.above(diagonal, off, np.array([-4.0, -2.0, 0.0, 1.0, 5.0, 10.0])).tolist() == [6, 5, 4, 2, 1, 0]


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError):
        feast.eigenpairs(matrix(np.arange(1.0, 30.0)), 20.5, 24.5, 5)
