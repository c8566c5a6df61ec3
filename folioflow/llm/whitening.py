"""Whitening of embeddings on the leading components of their covariance.

Entries become integers, so that sums and centred products are exact however rows are
dealt. Three passes: number and sums; products centred at the integer next to each
mean, per task and then by rows of the matrix; the whitened rows' own covariance. What
comes to the driver is the covariance matrix, whose size is that of a vector, squared.
Each pass reads the rows anew, and none is written: they must come from files or another
source that gives the same rows again. Its components come from contour integration (``feast``), one task an interval.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from . import feast

MOST = 32
SCALE, OFFSET = 64, 1_000_000
#: Numbers that a task looks at at once, and tasks whose partial products are added up
#: together before they meet in one task for each row of the matrix.
NUMBERS = 1 << 18
TASKS_EACH = 256
#: Entries beyond it don't fit a long once scaled and shifted.
LARGEST = 2.0**62 / SCALE


def usable(rows: DataFrame, vector: str = "embedding", into: str = "__v") -> DataFrame:
    """Rows with ``into``, their vector in doubles; those go whose vector is null or
    empty, holds a null or a number that is not finite or doesn't fit a long times
    SCALE, or has another length than most vectors (of equally frequent lengths the
    largest)."""
    out = rows.withColumn(into, F.col(vector).cast("array<double>"))
    out = out.where(F.col(into).isNotNull() & ~F.exists(into, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)))
    sizes = out.where(F.size(into) > 0).groupBy(F.size(into).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return out.where(F.size(into) == (sizes["d"] if sizes else -1))


def _integers(column, dim: int) -> np.ndarray:
    """The entries as integers, without the offset, which no result depends on."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.floor(SCALE * flat).astype(np.int64)


def _slices(batches, dim: int):
    for batch in batches:
        step = max(1, NUMBERS // dim)
        for a in range(0, batch.num_rows, step):
            yield batch.slice(a, step)


def _sums(dim: int):
    def run(batches):
        n, total = 0, [0] * dim
        for part in _slices(batches, dim):
            x = _integers(part.column(0), dim)
            # Halves of 31 bits add up without overflow.
            high, low = x >> 31, x & 0x7FFFFFFF
            n, total = n + len(x), [t + (int(h) << 31) + int(l) for t, h, l in zip(total, high.sum(0), low.sum(0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array([str(t) for t in total])], ["d", "n", "s"])

    return run


def _products(dim: int, centre: list[int]):
    """Exact sums of u' u, u the rows less ``centre``: in doubles and longs as far as sums
    fit these, else in integers of any size."""

    def run(batches):
        middle, total, small, bound, any_rows = np.array(centre, np.int64), None, np.zeros((dim, dim), np.int64), 0, False
        for part in _slices(batches, dim):
            u = _integers(part.column(0), dim) - middle
            any_rows = True
            own = int(np.abs(u).max()) ** 2 * len(u)
            if bound + own >= 1 << 63:
                total, small, bound = small.astype(object) + (0 if total is None else total), np.zeros_like(small), 0
            if own < 1 << 53:
                f = u.astype(float)
                small, bound = small + (f.T @ f).astype(np.int64), bound + own
            else:
                big = u.astype(object)
                total = big.T @ big + (0 if total is None else total)
        if any_rows:
            rows = small if total is None else small.astype(object) + total
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([" ".join(map(str, r)) for r in rows.tolist()])], ["d", "row"])

    return run


def _added(key, table):
    total = None
    for row in table.column("row"):
        own = [int(x) for x in row.as_py().split()]
        total = own if total is None else [a + b for a, b in zip(total, own)]
    return pa.table({"d": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([" ".join(map(str, total))])})


def moments(vectors: DataFrame, dim: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the exact sums of each dimension, and the covariance times n * n, exact too.
    ``vectors`` has one column of arrays of ``dim`` doubles."""
    sums = vectors.mapInArrow(_sums(dim), "d int, n long, s string").groupBy("d").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    rows = {r["d"]: r for r in sums.collect()}  # one row a dimension
    n, s = int(rows[0]["n"]), [int(rows[d]["s"]) for d in range(dim)]
    centre = [round(Fraction(x, n)) for x in s]
    parts = vectors.mapInArrow(_products(dim, centre), "d int, row string").withColumn("salt", F.floor(F.spark_partition_id() / TASKS_EACH))
    parts = parts.groupBy("d", "salt").applyInArrow(_added, "d int, row string").groupBy("d").applyInArrow(_added, "d int, row string")
    products = {r["d"]: [int(x) for x in r["row"].split()] for r in parts.collect()}  # the matrix
    # Off the centre by less than one: what is left is exact in integers too.
    off = [x - n * c for x, c in zip(s, centre)]
    return n, s, [[n * products[i][j] - off[i] * off[j] for j in range(dim)] for i in range(dim)]


def leading(spark, covariance: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``most`` largest eigenvalues above rounding and their unit vectors (rows),
    one task for each interval. Inertia counts say how many each interval must yield."""
    spans = feast.intervals(covariance, most)
    if not spans:
        return np.zeros(0), np.zeros((0, len(covariance)))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                values, vectors = feast.eigenpairs(covariance, row["low"], row["high"], row["count"])
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(list(vectors), pa.list_(pa.float64()))], ["value", "vector"])

    tasks = spark.createDataFrame([tuple(s) for s in spans], "low double, high double, count int").repartition(len(spans))
    found = sorted(tasks.mapInArrow(run, "value double, vector array<double>").collect(), key=lambda r: -r["value"])[:most]
    return np.array([r["value"] for r in found]), np.array([r["vector"] for r in found])


def whitened(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = MOST) -> DataFrame:
    """For each usable row of ``rows`` and component: id, component (from 1), n,
    deviation, whitened, explained, identity_error.

    Entries c become x = floor(64 * c) + 1000000. The components are unit eigenvectors
    of the covariance (divisor n) of all usable rows, by falling eigenvalue; those whose
    eigenvalue is zero up to rounding don't appear, so one row, or equal ones, give
    none, as do empty tables. deviation is the sum over dimensions of (n * x - sum)^2, null
    where it doesn't fit a long. What ``usable`` drops has no rows; null and repeated
    ids and equal vectors have theirs. Other columns are not looked at, whatever their
    names.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType
    out = StructType([StructField(id_col, kind), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
                      StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType())])
    vectors = usable(rows.select(F.col(id_col).alias("__id"), F.col(vector).alias("__e")), "__e").select("__id", "__v")
    first = vectors.select(F.size("__v").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], out)
    dim = first["d"]
    n, s, products = moments(vectors.select("__v"), dim)
    v = np.array([[float(Fraction(x, n * n)) for x in row] for row in products])
    values, components = leading(spark, v, most)
    if not len(values):
        return spark.createDataFrame([], out)
    explained = values / float(sum(Fraction(products[d][d], n * n) for d in range(dim)))
    centre = [round(Fraction(x, n)) for x in s]
    rest = np.array([float(Fraction(x - n * c, n)) for x, c in zip(s, centre)])
    off = [x - n * c for x, c in zip(s, centre)]
    turn = (components / np.sqrt(values)[:, None]).T

    def projected(column) -> tuple[np.ndarray, np.ndarray]:
        u = _integers(column, dim) - np.array(centre, np.int64)
        return u, (u - rest) @ turn

    def shares(batches):
        k, total, sums, count = len(values), np.zeros((len(values), len(values))), np.zeros(len(values)), 0
        for part in _slices(batches, dim):
            _, w = projected(part.column(0))
            total, sums, count = total + w.T @ w, sums + w.sum(0), count + len(w)
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(sums), pa.array(list(total), pa.list_(pa.float64()))], ["k", "s", "row"])

    # One row of sums for each component.
    each = [F.sum(F.col("row")[j]).alias(f"r{j}") for j in range(len(values))]
    got = sorted(vectors.select("__v").mapInArrow(shares, "k int, s double, row array<double>").groupBy("k").agg(F.sum("s").alias("s"), *each).collect(), key=lambda r: r["k"])
    mean = np.array([r["s"] for r in got]) / n
    own = np.array([[r[f"r{j}"] for j in range(len(values))] for r in got]) / n - np.outer(mean, mean)
    error = float(np.abs(own - np.eye(len(values))).max())

    def deviations(u: np.ndarray) -> pa.Array:
        widest = n * (int(np.abs(u).max(initial=0)) + 1)
        if widest * widest * dim < 1 << 63:
            return pa.array(((n * u - np.array(off, np.int64)) ** 2).sum(1), pa.int64())
        exact = [sum((n * int(a) - b) ** 2 for a, b in zip(r, off)) for r in u]
        return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())

    def run(batches):
        k = len(values)
        for part in _slices(batches, max(dim, 4 * k)):
            u, w = projected(part.column("__v"))
            at = np.repeat(np.arange(len(u)), k)
            yield pa.RecordBatch.from_arrays(
                [part.column("__id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1), len(u)), pa.int32()), pa.array(np.full(len(at), n), pa.int64()),
                 pc.take(deviations(u), pa.array(at)), pa.array(w.ravel()), pa.array(np.tile(explained, len(u))), pa.array(np.full(len(at), error))],
                out.names,
            )

    return vectors.mapInArrow(run, out)
