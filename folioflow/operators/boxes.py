"""Groups of boxes that stand near one another on a page.

Boxes are put into the cells of a grid over their page; two boxes that are near lie in
the same or in neighbouring cells, so a join by cell finds all such pairs, and few
others. Groups are then the components of these pairs, found for all pages at once by
passing the smallest number on and jumping ahead, round by round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import forget, keep

GAP = 40.0
#: Cells on a side of a page's grid: so many at least, and as many as boxes need.
LEAST_CELLS = 16


def _near(margin: Column, gap: float) -> Column:
    """Whether boxes a and b, grown by the margin, meet, or one is close above the other."""
    side = lambda k: F.least(f"b.{k}1", f"a.{k}1") - F.greatest(f"b.{k}0", f"a.{k}0")
    wide, high = side("x"), side("y")
    meet = (wide + 2 * margin > 0) & (high + 2 * margin > 0)
    stacked = (high <= 0) & (-high < gap) & (wide > 0.1 * F.least(F.col("b.x1") - F.col("b.x0"), F.col("a.x1") - F.col("a.x0")))
    return F.coalesce(meet | stacked, F.lit(False))


def candidates(boxes: DataFrame, by: list[str], gap: float = GAP) -> DataFrame:
    """Pairs (by, a and b as structs with i < i) of boxes (by, i, x0, y0, x1, y1, margin) in
    neighbouring cells; a pair may come several times."""
    page = Window.partitionBy(*by)
    low, high = lambda k: F.least(f"{k}0", f"{k}1"), lambda k: F.greatest(f"{k}0", f"{k}1")
    sides = F.greatest(F.lit(LEAST_CELLS), F.ceil(F.sqrt(F.count(F.lit(1)).over(page))))
    rows = boxes.where("x0 + y0 + x1 + y1 + margin is not null")
    for k in "xy":
        start, end = F.min(low(k)).over(page), F.max(high(k)).over(page)
        cell = F.greatest(2 * F.col("margin"), F.lit(gap), (end - start) / sides)
        rows = rows.withColumns({f"__{k}a": F.floor((low(k) - start) / cell), f"__{k}b": F.floor((high(k) - start) / cell)})
    box = F.struct("i", "x0", "y0", "x1", "y1", "margin")

    def cells(name: str, more: int):
        """The cells of each box, with ``more`` around it."""
        spread = lambda k: F.explode(F.sequence(F.col(f"__{k}a") - more, F.col(f"__{k}b") + more))
        out = rows.select(*by, box.alias(name), spread("x").alias("__x"), "__ya", "__yb")
        return out.select(*by, name, "__x", spread("y").alias("__y"))

    return cells("a", 0).join(cells("b", 1).hint("merge"), [*by, "__x", "__y"]).where("a.i < b.i").drop("__x", "__y")


def grouped(boxes: DataFrame, by: list[str], gap: float = GAP) -> DataFrame:
    """``boxes`` (by, i, x0, y0, x1, y1, margin; i numbers the boxes of a page) with
    cluster, the smallest i of the boxes reached by near ones. Boxes without a
    coordinate stand alone. Equal boxes that are near each other count as one."""
    names, drawn = ("x0", "y0", "x1", "y1", "margin"), Window.partitionBy(*by)
    side = {c: F.col(c).cast("double") for c in names}
    same = Window.partitionBy(*by, *side.values())
    meets = (side["x1"] - side["x0"] + 2 * side["margin"] > 0) & (side["y1"] - side["y0"] + 2 * side["margin"] > 0)
    own = boxes.repartition(*by).withColumn("rep", F.when(meets, F.min("i").over(same)).otherwise(F.col("i")))
    # A page's only box, as most are, takes no part in the rounds.
    own = keep(own.withColumn("__met", F.count(F.when(F.col("i") == F.col("rep"), 1)).over(drawn) > 1))
    single = own.where("i = rep and __met").select(*by, "i", *(c.alias(n) for n, c in side.items()))
    pairs = candidates(single, by, gap).where(_near(F.col("a.margin"), gap))
    pairs = keep(pairs.select(*by, F.col("a.i").alias("i"), F.col("b.i").alias("j")).distinct())
    labels = keep(single.select(*by, "i", F.col("i").alias("cluster")))
    if not pairs.isEmpty():
        both = keep(pairs.unionByName(pairs.select(*by, F.col("j").alias("i"), F.col("i").alias("j"))))
        while True:
            # The least label around each box, then the label of that label. Such tables are
            # a few bytes a row on disk and many in memory: no size check sends them whole.
            around = both.join(labels.select(*by, F.col("i").alias("j"), "cluster").hint("merge"), [*by, "j"]).groupBy(*by, "i").agg(F.min("cluster").alias("least"))
            low = labels.join(around.hint("merge"), [*by, "i"], "left").withColumn("cluster", F.least("cluster", "least")).drop("least")
            ahead = low.select(*by, F.col("i").alias("cluster"), F.col("cluster").alias("ahead"))
            new = keep(low.join(ahead.hint("merge"), [*by, "cluster"]).select(*by, "i", F.least("cluster", "ahead").alias("cluster")))
            moved = new.agg(F.sum("cluster")).first()[0] != labels.agg(F.sum("cluster")).first()[0]
            forget(labels)
            labels = new
            if not moved:
                break
        forget(both)
    found = own.join(labels.withColumnRenamed("i", "rep").hint("merge"), [*by, "rep"], "left")
    return found.select(*boxes.columns, F.coalesce("cluster", "rep").alias("cluster"))
