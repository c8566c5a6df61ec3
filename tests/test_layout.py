import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators.layout import curve, displayed, graph, laid_out, neighbour_count, trustworthiness


def ring(n=240, dim=10, seed=2):
    """A closed curve in ``dim`` dimensions that three principal components don't hold."""
    t = np.arange(n) * 2 * math.pi / n
    flat = np.stack([f(m * t) for m in range(1, dim // 2 + 1) for f in (np.sin, np.cos)], 1)
    return flat + np.random.default_rng(seed).standard_normal(flat.shape) * 0.01


def table(spark, v):
    return spark.createDataFrame([(k, [float(x) for x in r]) for k, r in enumerate(v)], "id long, vector array<double>").repartition(3)


def test_maps_keep_neighbours_better_than_principal_components(spark):
    v = ring()
    got = np.array([(r["x"], r["y"], r["z"]) for r in sorted(laid_out(table(spark, v), rounds=12).collect())])
    centred = v - v.mean(0)
    flat = centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T
    assert np.isfinite(got).all() and trustworthiness(v, got) >= max(0.97, trustworthiness(v, flat))


def test_groups_stay_apart(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.standard_normal((60, 8)) * 0.2 + 8 * np.eye(8)[g] for g in range(4)])
    got = np.array([(r["x"], r["y"], r["z"]) for r in sorted(laid_out(table(spark, v), rounds=8).collect())])
    assert trustworthiness(v, got) >= 0.9
    centre = np.array([got[g * 60 : g * 60 + 60].mean(0) for g in range(4)])
    own = max(np.linalg.norm(got[g * 60 : g * 60 + 60] - centre[g], axis=1).mean() for g in range(4))
    assert min(np.linalg.norm(centre[a] - centre[b]) for a in range(4) for b in range(a)) > 2 * own


def test_the_graph_is_that_of_the_nearest(spark):
    v = ring(60, 6)
    k = neighbour_count(60)
    got = {(r["id"], r["other"]): r["weight"] for r in graph(table(spark, v), k).collect()}
    far = ((v[:, None] - v[None]) ** 2).sum(2) + np.diag(np.full(60, np.inf))
    near = far.argsort(1)[:, :k]
    assert set(got) == {p for a in range(60) for b in near[a] for p in ((a, int(b)), (int(b), a))}
    assert all(abs(got[b, a] - w) < 1e-12 and 0 < w <= 1 for (a, b), w in got.items())
    assert [neighbour_count(n) for n in (1, 2, 3, 9, 16, 99)] == [2, 2, 2, 8, 15, 15]


def test_few_odd_and_equal_vectors(spark):
    rows = spark.createDataFrame([(1, [4.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0])], "id long, vector array<double>")
    assert laid_out(rows.limit(0)).collect() == []
    assert [tuple(r) for r in laid_out(rows.where("id <> 4")).collect()] == [(1, 4.0, 0.0, 0.0)]
    same = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(5)] + [(9, [7.0, 1.0])], "id long, vector array<double>")
    got = laid_out(same, rounds=3).collect()
    assert len(got) == 6 and all(math.isfinite(x) for r in got for x in r[1:])


def test_the_curve_follows_the_wanted_one():
    a, b = curve(0.25)
    d = np.array([0.1, 0.25, 1.0, 2.0])
    np.testing.assert_allclose(1 / (1 + a * d ** (2 * b)), np.where(d < 0.25, 1, np.exp(0.25 - d)), atol=0.12)


def test_display_coordinates(spark):
    rows = [(1, 0.0, 10.0, 5.0), (2, 20.0, 12.0, None), (3, float("nan"), float("inf"), 5.0)]
    got = {r["id"]: tuple(r)[1:] for r in displayed(spark.createDataFrame(rows, "id int, x double, y double, z double")).collect()}
    assert got == {1: (-3.0, pytest.approx(-0.3), 0.0), 2: (3.0, pytest.approx(0.3), 0.0), 3: (0.0, 0.0, 0.0)}
    near = spark.createDataFrame([(1, 0.2, 0.0, 0.0), (2, 0.4, 0.0, 0.0)], "id int, x double, y double, z double")
    assert [r["x"] for r in displayed(near).orderBy("id").collect()] == [pytest.approx(-0.6), pytest.approx(0.6)]
    assert displayed(near.where(F.lit(False))).collect() == []
