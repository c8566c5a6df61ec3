import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators.boxes import candidates, grouped

BOX = "page int, i long, x0 double, y0 double, x1 double, y1 double, margin double"


def near(a, b, margin, gap=40.0):
    if None in (*a, *b):
        return False
    wide, high = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    return wide + 2 * margin > 0 and high + 2 * margin > 0 or 0 <= -high < gap and wide > 0.1 * min(a[2] - a[0], b[2] - b[0])


def brute(boxes):
    """Cluster of each (page, i), by following near boxes."""
    out = {}
    for page in {b[0] for b in boxes}:
        own = {b[1]: b[2:6] for b in boxes if b[0] == page}
        margin = next(b[6] for b in boxes if b[0] == page)
        for i in sorted(own):
            if (page, i) not in out:
                todo = [i]
                while todo:
                    j = todo.pop()
                    if (page, j) not in out:
                        out[page, j] = i
                        todo += [k for k in own if (page, k) not in out and near(own[j], own[k], margin)]
    return out


def pages(seed):
    rng, rows = random.Random(seed), []
    for page in range(40):
        size, margin = rng.choice([200, 1000, 4000]), rng.choice([0.0, 3.0, 15.0, 30.0])
        for i in range(rng.choice([1, 2, 5, 30, 60])):
            x, y = rng.randrange(size), rng.randrange(size)
            w, h = rng.choice([0, 1, 20, 120, size]), rng.choice([0, 1, 20, 120])
            rows.append((page, i, float(x), float(y), float(x + w), float(y + h - (rng.random() < 0.03) * 30), margin))
            if rng.random() < 0.1 and i:
                rows[-1] = (page, i, *rows[-2][2:])  # the same box again
            if rng.random() < 0.02:
                rows[-1] = (page, i, None, *rows[-1][3:])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rows = pages(seed)
    got = {(r["page"], r["i"]): r["cluster"] for r in grouped(spark.createDataFrame(rows, BOX).repartition(3), ["page"]).collect()}
    assert got == brute(rows)


def test_long_chains_are_one_group(spark):
    rows = [(1, i, 10.0 * i, 0.0, 10.0 * i + 9, 5.0, 2.0) for i in range(300)]
    assert {r["cluster"] for r in grouped(spark.createDataFrame(rows[::-1], BOX), ["page"]).collect()} == {0}


def test_candidates_grow_with_the_boxes_where_none_meet(spark):
    def counted(n):
        side = int(n**0.5)
        at = lambda c: (c * 100).cast("double")
        x, y = at(F.col("id") % side), at(F.floor(F.col("id") / side))
        boxes = spark.range(side * side).select(F.lit(1).alias("page"), F.col("id").alias("i"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 10).alias("y1"), F.lit(15.0).alias("margin"))
        return candidates(boxes, ["page"]).count() / (side * side)

    assert counted(100_000) <= 9 and counted(100_000) <= 1.5 * counted(10_000)


def test_no_boxes(spark):
    assert grouped(spark.createDataFrame([], BOX), ["page"]).collect() == []


def test_groups_send_no_kept_table_whole(spark):
    """Kept tables are a few bytes a row on disk: size checks of joins must not send them."""
    rows = spark.createDataFrame(pages(3), BOX)
    with_more = grouped(rows.withColumn("name", F.lit("n")), ["page"])
    assert with_more.columns == [*rows.columns, "name", "cluster"]
    plans = [with_more, candidates(rows, ["page"])]
    assert all("Broadcast" not in p._jdf.queryExecution().executedPlan().toString() for p in plans)
    assert {(r["page"], r["i"]): r["cluster"] for r in with_more.collect()} == brute(pages(3))
