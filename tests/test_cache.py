import pytest

from folioflow.operators.cache import ResultCache, contents, files

ROWS = "id long, vector array<double>, note string"


def test_results_follow_the_library(spark, tmp_path):
    cache, calls = ResultCache(spark, str(tmp_path / "cache")), []
    rows = spark.createDataFrame([(1, [1.0, None], "a"), (2, None, None), (2, None, None)], ROWS)

    def make(n):
        def run():
            calls.append(n)
            return spark.createDataFrame([(n,)], "n int")

        return run

    ask = lambda rows, n, **asked: cache.get({"query": "q", "folders": [1, 2]} | asked, {"library": rows}, make(n))
    got, hit = ask(rows, 1)
    assert not hit and got.collect()[0].n == 1
    got, hit = ask(rows.repartition(3), 2, query=" Q ", folders=[2, 1], model=None)
    assert hit and got.collect()[0].n == 1 and calls == [1]  # nothing is made again
    for k, (changed, asked) in enumerate([(rows.limit(2), {}), (rows.withColumnRenamed("note", "text"), {}), (rows.withColumn("id", rows["id"].cast("int")), {}), (rows, {"query": "r"}), (rows, {"folders": [1]}), (rows, {"scope": "chunks"})]):
        got, hit = ask(changed, 10 + k, **asked)
        assert not hit and got.collect()[0].n == 10 + k
    assert ask(rows, 99)[1] and 99 not in calls
    cache.clear()
    assert not ask(rows, 100)[1]


def test_a_result_that_fails_is_not_kept(spark, tmp_path):
    cache = ResultCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([(1, None, "a")], ROWS)
    with pytest.raises(Exception, match="boom"):
        cache.get({}, {"l": rows}, lambda: rows.selectExpr("raise_error('boom') AS x"))
    assert not cache.get({}, {"l": rows}, lambda: rows.select("id"))[1]


def test_digests_of_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, [1.0], "a"), (2, [], "b")], ROWS)
    assert contents(rows) == contents(rows.orderBy("note", ascending=False)) == contents(rows.select("note", "id", "vector"))
    others = [rows.unionByName(rows), rows.where("id = 1"), rows.limit(0), rows.replace("a", "c")]
    assert len({contents(x) for x in [rows, *others]}) == 5
    rows.write.parquet(str(tmp_path / "t"))
    first = files(spark.read.parquet(str(tmp_path / "t")))
    assert first == files(spark.read.parquet(str(tmp_path / "t")))
    rows.write.mode("append").parquet(str(tmp_path / "t"))
    assert first != files(spark.read.parquet(str(tmp_path / "t")))
