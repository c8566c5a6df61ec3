"""Maps of vectors in three dimensions: a neighbour graph, laid out in rounds.

Each vector is joined to its nearest ones (min(15, max(2, n - 1)) of them, by
``pivots``), links get weights that fall with distance from the nearest one, and both
directions are united. Rows start at their principal components. In each round a row
moves towards its neighbours, by their weights, and away from a sample of rows, whose
size a constant bounds; steps shrink from round to round. A round is one join of the
links with the positions and one sum by row; positions are written once a round.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import forget, keep
from .pivots import nearest_pruned

MIN_DIST = 0.25
ROUNDS = 20
#: Rows that each row is pushed away from in a round, and how much pushing counts.
PUSHED_BY = 512
PUSH = 5.0
AXES = ("x", "y", "z")


def neighbour_count(n: int) -> int:
    return min(15, max(2, n - 1))


def curve(min_dist: float = MIN_DIST) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b) that come closest to 1 up to ``min_dist`` and to
    exp(min_dist - d) beyond."""
    d = np.linspace(0, 3, 300)[1:]
    want = np.where(d < min_dist, 1.0, np.exp(min_dist - d))
    a, b = 1.0, 1.0
    for _ in range(100):
        p = d ** (2 * b)
        f = 1 / (1 + a * p)
        slope = np.stack([-p * f * f, -2 * a * p * np.log(d) * f * f], 1)
        step = np.linalg.lstsq(slope, want - f, rcond=None)[0]
        a, b = max(1e-3, a + step[0]), max(1e-3, b + step[1])
        if np.abs(step).max() < 1e-10:
            break
    return float(a), float(b)


def graph(rows: DataFrame, k: int) -> DataFrame:
    """(id, other, weight) both ways, of rows (id, vector): exp(-(d - nearest) / scale) of
    a row's k nearest others, w + v - w * v of the weights of both directions."""
    queries = rows.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    near = nearest_pruned(rows.select("id", "vector"), queries, k + 1, "distance").where("query_id <> id")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    d = F.sqrt(-F.log(F.greatest(F.col("score"), F.lit(1e-300))))
    near = near.withColumn("nth", nth).where(F.col("nth") <= k).select("query_id", "id", d.alias("d"))
    own = Window.partitionBy("query_id")
    least, mean = F.min("d").over(own), F.avg("d").over(own)
    weight = F.exp(-(F.col("d") - least) / F.greatest(mean - least, mean * 1e-3, F.lit(1e-12)))
    one = keep(near.select(F.col("query_id").alias("id"), F.col("id").alias("other"), weight.alias("w")))
    both = one.unionByName(one.select(F.col("other").alias("id"), F.col("id").alias("other"), "w"))
    united = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("w"), F.lit(1e-12)))))
    return keep(both.groupBy("id", "other").agg(united.alias("weight")))


def _started(rows: DataFrame) -> DataFrame:
    """Principal components, the widest scaled to ten, as places to start from; fewer
    than three where vectors are shorter."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    dim = rows.select(F.size("vector")).first()[0]
    k = min(3, dim)
    placed = rows.select("id", array_to_vector("vector").alias("v"))
    placed = PCA(k=k, inputCol="v", outputCol="p").fit(placed).transform(placed).select("id", vector_to_array("p").alias("p"))
    placed = keep(placed.select("id", *(F.get("p", F.lit(i)).alias(c) if i < k else F.lit(0.0).alias(c) for i, c in enumerate(AXES))))
    ends = placed.agg(*(F.avg(c) for c in AXES), F.max(F.greatest(*(F.abs(c) for c in AXES)))).first()
    wide = ends[3] or 1.0
    return placed.select("id", *((10 * (F.col(c) - ends[i]) / wide).alias(c) for i, c in enumerate(AXES)))


def _pushed(some: np.ndarray, a: float, b: float, step: float):
    """Moves positions away from ``some`` after the pull towards neighbours."""

    def run(batches):
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in AXES], 1)
            pull = np.stack([batch.column(f"p{c}").to_numpy(zero_copy_only=False) for c in AXES], 1)
            push = np.zeros_like(at)
            for i in range(0, len(at), 4096):
                gap = at[i : i + 4096, None, :] - some[None]
                d = (gap**2).sum(2)
                force = 2 * b / ((1e-3 + d) * (1 + a * d**b))
                push[i : i + 4096] = np.clip(force[:, :, None] * gap, -4, 4).mean(1)
            to = at + step * (np.nan_to_num(pull) + PUSH * push)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(to[:, i]) for i in range(3))], ["id", *AXES])

    return run


def laid_out(rows: DataFrame, rounds: int = ROUNDS, min_dist: float = MIN_DIST) -> DataFrame:
    """(id, x, y, z) of rows (id, vector) such that near vectors are near.

    Ids must be unique and not null. Vectors of another size than most, and ones with
    nulls, infinities or no numbers, take no part; equal vectors may lie apart. One
    vector has its first number as x and lies at zero else; an empty table gives none.
    The same rows give the same map.
    """
    rows = rows.select("id", F.col("vector").cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    rows = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    common = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = keep(rows.where(F.size("vector") == (common["d"] if common else -1)))
    n = rows.count()
    if n < 2:
        return rows.select("id", F.get("vector", F.lit(0)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    links = graph(rows, neighbour_count(n))
    a, b = curve(min_dist)
    places = keep(_started(rows))
    gap = {c: F.col(f"o{c}") - F.col(c) for c in AXES}
    d = sum((g * g for g in gap.values()), F.lit(0.0))
    force = 2 * a * b * F.pow(F.greatest(d, F.lit(1e-9)), F.lit(b - 1)) / (1 + a * F.pow(d, F.lit(b)))
    for nth in range(rounds):
        some = places.orderBy(F.xxhash64("id", F.lit(nth)), "id").limit(PUSHED_BY).select(*AXES).collect()
        other = places.select(F.col("id").alias("other"), *(F.col(c).alias(f"o{c}") for c in AXES))
        pulls = links.join(other, "other").join(places, "id")
        # The pull of all neighbours by their shares of the weight.
        mean = lambda c: (F.sum(F.col("weight") * F.greatest(F.least(force * gap[c], F.lit(4.0)), F.lit(-4.0))) / F.sum("weight")).alias(f"p{c}")
        pulls = pulls.groupBy("id").agg(*(mean(c) for c in AXES))
        moved = places.join(pulls, "id", "left").select("id", *AXES, *(f"p{c}" for c in AXES))
        sample = np.array([list(r) for r in some])
        last, places = places, keep(moved.mapInArrow(_pushed(sample, a, b, 1.0 - 0.95 * nth / rounds), places.schema))
        forget(last)
    return places


def displayed(rows: DataFrame, size: float = 6.0, axes: tuple[str, ...] = AXES) -> DataFrame:
    """``rows`` with their axes centred and scaled alike for display: the widest extent,
    one at least, becomes ``size``. What is not finite, or null, becomes 0 and doesn't
    count for extents."""
    sound = lambda c: F.when(F.isnan(c) | (F.abs(c) == math.inf), None).otherwise(F.col(c).cast("double"))
    ends = rows.agg(*(f(sound(c)).alias(f"__{n}{i}") for i, c in enumerate(axes) for n, f in (("low", F.min), ("high", F.max)))).first()
    low, high = ([ends[f"__{n}{i}"] or 0.0 for i in range(len(axes))] for n in ("low", "high"))
    spread = max([1.0, *(h - l for l, h in zip(low, high))])
    return rows.withColumns({c: F.coalesce((sound(c) - (low[i] + high[i]) / 2) / spread * size, F.lit(0.0)) for i, c in enumerate(axes)})


def trustworthiness(vectors: np.ndarray, places: np.ndarray, k: int = 10) -> float:
    """How far near rows of a map are near in truth (1: wholly), for bounded samples."""
    n = len(vectors)
    far = lambda x: ((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(n, np.inf))
    ranks = far(vectors).argsort(1).argsort(1) + 1
    near = far(places).argsort(1)[:, :k]
    worse = np.maximum(np.take_along_axis(ranks, near, 1) - k, 0).sum()
    return 1 - 2 * worse / (n * k * (2 * n - 3 * k - 1))
