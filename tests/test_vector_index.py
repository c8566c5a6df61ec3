import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import pivots, search, vector_index
from folioflow.operators.pivots import PivotIndex, nearest_pruned
from folioflow.operators.vector_index import VectorIndex, linked, recall, walked

ROWS = "id long, folder int, vector array<float>"


def clustered(n=3000, dim=12, groups=20, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 10
    v = centres[rng.integers(0, groups, n)] + rng.standard_normal((n, dim)) * 0.3
    return [(k, int(k % 4), [float(np.float32(x)) for x in r]) for k, r in enumerate(v)]


def odd_rows(dim=12):
    zero, one = [0.0] * dim, [1.0] * dim
    return [(9001, 1, zero), (9002, 2, zero), (9003, 3, [float("nan")] * dim), (9004, 0, None), (9005, 0, []), (9006, 1, [1.0, 2.0]),
            (9007, 1, [-1.0, 2.0]), (None, 2, one), *((9100 + k, 2, one) for k in range(40)), (9008, 1, [1e30] * dim), (9009, 1, [None] * dim)]


def same_rows(a, b):
    plain = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    x, y = plain(a), plain(b)
    assert len(x) == len(y) and [r[:-1] for r in x] == [r[:-1] for r in y]
    np.testing.assert_allclose([r[-1] for r in x], [r[-1] for r in y], rtol=1e-12)


@pytest.mark.parametrize("score", ["cosine", "distance"])
@pytest.mark.parametrize("k", [1, 200])
def test_pruned_join_equals_the_scan(spark, score, k):
    rows = spark.createDataFrame(clustered(900) + odd_rows(), ROWS).repartition(3)
    queries = rows.where("id % 45 = 0 or id > 9000").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    same_rows(nearest_pruned(rows, queries, k, score), search.nearest_each(rows, queries, k, score))


def test_pruned_join_scores_fewer_pairs(spark):
    rows = spark.createDataFrame(clustered(4000), ROWS)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    counted = []
    index = PivotIndex(rows, "distance", pack_numbers=12 * 64)
    same_rows(index.nearest(queries, 10, counted), search.nearest_each(rows, queries, 10, "distance"))
    assert counted[0] < 0.25 * rows.count() * queries.count()
    assert index.rings.agg(F.max("n")).first()[0] <= 64


@pytest.mark.parametrize("score", ["cosine", "distance"])
def test_pruned_join_writes_no_pairs(spark, monkeypatch, score):
    """Vectors without groups: nearly each query meets each ring, what is kept stays by the rows."""
    v = np.random.default_rng(4).standard_normal((1500, 8))
    rows = spark.createDataFrame([(k, 1, [float(x) for x in r]) for k, r in enumerate(v)], ROWS)
    queries = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    written, kept = [], pivots.keep
    monkeypatch.setattr(pivots, "keep", lambda df: written.append(kept(df)) or written[-1])
    index, before = PivotIndex(rows, score, pack_numbers=8 * 20), len(written)
    got = index.nearest(queries, 3)
    assert index.rings.count() > 75
    assert all(df.count() <= 3 * 1500 for df in written[before:] if df.inputFiles() and os.path.exists(df.inputFiles()[0].removeprefix("file://")))
    assert not any(c[1].startswith("array") for df in written[before:] for c in df.dtypes if c[0] != "q")
    same_rows(got, search.nearest_each(rows, queries, 3, score))


def test_a_cell_of_equal_vectors_is_cut_into_rings(spark):
    rows = spark.range(1000).select("id", F.lit(1).alias("folder"), F.array(F.lit(1.0), F.when(F.col("id") % 3 == 0, F.col("id") / 7).otherwise(2.0)).alias("vector"))
    index = PivotIndex(rows, "distance", pack_numbers=100)
    assert index.rings.agg(F.max("n")).first()[0] <= 50
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    same_rows(index.nearest(queries, 5), search.nearest_each(rows, queries, 5, "distance"))


def test_pruned_join_of_empty_tables(spark):
    rows = spark.createDataFrame(clustered(50), ROWS)
    queries = rows.where("id < 3").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert nearest_pruned(rows.limit(0), queries, 3).collect() == []
    assert nearest_pruned(rows, queries.limit(0), 3).collect() == []


def test_walks_find_near_rows_and_look_at_a_part():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((6000, 16))
    q = rng.standard_normal((60, 16))
    near, dist, scored = walked(x, linked(x), q, 10, 64)
    exact = ((x[None] - q[:, None]) ** 2).sum(2).argsort(1)[:, :10]
    hits = sum(len(set(a) & set(b)) for a, b in zip(near.tolist(), exact.tolist()))
    assert hits >= 0.95 * exact.size and scored < 0.5 * len(x) * len(q)
    assert (np.diff(dist, axis=1) >= 0).all()


def test_linking_and_walking_hold_a_bounded_part():
    import tracemalloc

    x = np.random.default_rng(7).standard_normal((16384, 64))
    tracemalloc.start()
    links = linked(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    walked(x, links, x[: vector_index.WALKING] + 0.1, 10, 64)
    walking = tracemalloc.get_traced_memory()[1] - links.nbytes
    tracemalloc.stop()
    assert most < 100 << 20 and walking < 50 << 20


def test_copies_are_one_node(spark, tmp_path):
    v = np.concatenate([np.zeros((400, 4)), np.eye(4) * 3, np.arange(40.0).reshape(10, 4)])
    rows = spark.createDataFrame([(k, 1, [float(x) for x in r]) for k, r in enumerate(v)], ROWS)
    queries = spark.createDataFrame([(1, [3.0, 0.0, 0.0, 0.0]), (2, [0.0, 1.0, 2.0, 3.0]), (3, [0.0, 0.0, 0.0, 0.0])], "query_id long, query_vector array<double>")
    index = VectorIndex(spark, str(tmp_path / "copies"))
    index.rebuild(rows)
    got = index.search(queries, [f for f in rows.schema if f.name != "vector"], 5, ef=8)
    same_rows(got, search.nearest_each(rows, queries, 5, "distance"))
    assert (linked(v[:1]) == -1).all()


def test_life_of_an_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "SHARD_NUMBERS", 12 * 300)
    rows = spark.createDataFrame(clustered(900) + odd_rows(), ROWS)
    fields = [f for f in rows.schema if f.name != "vector"]
    index = VectorIndex(spark, str(tmp_path / "index"))
    queries = rows.where("id % 30 = 0 and id < 900").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert not index.ready() and tuple(index.stats().first()) == (0, 0, 0, 0, 0, 0)
    with pytest.raises(RuntimeError):
        index.search(queries, fields, 5)
    assert index.rebuild(rows.where("id < 600 or id >= 9000")) == 1
    # Another size, no numbers, nulls and numbers that are not finite are skipped.
    assert tuple(index.stats().first()) == (1, 12, 1, 3, 600 + 43, 6)
    assert index.add(rows.where("id between 600 and 899")) == 2
    assert tuple(index.stats().first()) == (2, 12, 2, 4, 943, 6) and index.ready()
    exact = search.nearest_each(rows, queries, 10, "distance")
    found = index.search(queries, fields, 10)
    assert found.columns == exact.columns and recall(found, exact) >= 0.98
    inside = index.search(queries, fields, 10, folders=[1], score_from=0.001)
    want = search.nearest_in_each(rows, queries, 10, [1], 0.001)
    assert recall(inside, want) >= 0.95 and {r["folder"] for r in inside.collect()} == {1}
    with pytest.raises(Exception, match="does not match"):
        index.search(queries.select("query_id", F.array(F.lit(1.0)).alias("query_vector")), fields, 3).collect()
    assert index.search(queries.where("query_id = 0"), fields, 5000).count() == 943
    assert index.rebuild(rows.where("id < 50")) == 3
    assert tuple(index.stats().first()) == (3, 12, 1, 1, 50, 0)
    index.clear()
    assert not index.ready() and index.version() == 0
    assert index.rebuild(rows.limit(0)) == 1 and not index.ready()


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/embeddings.parquet"), reason="needs the given tables")
def test_recall_on_the_given_vectors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("folder"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.rebuild(rows)
    found = index.search(queries, [f for f in rows.schema if f.name != "vector"], 10)
    assert recall(found, search.nearest_each(rows, queries, 10, "distance")) >= 0.9
