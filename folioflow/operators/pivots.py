"""Exact nearest rows that look at a part of the rows: pivots and triangle bounds.

Each row belongs to the cell of its nearest pivot, and its distance from that pivot is
known. Rows of a cell are packed in order of that distance, so a pack is a ring around
a pivot. A query first scores one ring of its own cell; the k-th best distance found is
a radius that all of its k nearest rows lie within. By the triangle inequality, rings
and cells that its ball of this radius can't touch are left out; all others are scored.

Blocks of near queries meet bundles of rings in a product that writes nothing: a task
takes a block, and all bundles of a group one after another, and keeps the k best of
each query, whose radius shrinks on the way. So what is written grows with the rows and
queries, not with the pairs that are scored.

Cosines are distances between unit vectors; a vector of zeros, which has cosine 0 with
all, becomes a unit vector in a dimension of its own, and so does a query of zeros.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..sources.tables import forget, keep
from .search import BLOCK_NUMBERS, MOST_PAIRS, PACK_NUMBERS, _in_order, best_kind, best_of_packs, packed
from .search import SLACK as PRODUCT_SLACK

#: Numbers in all pivots, pivots of vectors of one size, rows for each pivot, and sizes
#: of vectors that have pivots; others have one cell around zero.
PIVOT_NUMBERS = 1 << 20
MOST_PIVOTS = 256
ROWS_PER_PIVOT = 256
MOST_SIZES = 32
#: Rings of a cell among which a query looks for the one to score first.
FIRST_RINGS = 32
#: Numbers of a block of queries at most, blocks where these are smaller, bytes of a
#: bundle of rings, and numbers of the bundles that a task holds at once.
MOST_BLOCK_NUMBERS = 1 << 18
BLOCKS = 64
BUNDLE_BYTES = 4 << 20
GROUP_NUMBERS = 1 << 23
#: Distances are wrong by less than this, relative to the largest numbers in them.
SLACK = 1e-6

_PLACE = [StructField("__dim", IntegerType()), StructField("__cell", IntegerType()), StructField("__dist", DoubleType())]


def _finite(vector: str):
    return ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _placed(v: np.ndarray, score: str, query: bool) -> np.ndarray:
    if score != "cosine":
        return v
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    out = np.zeros((len(v), v.shape[1] + 2))
    np.divide(v, norm[:, None], out=out[:, :-2], where=norm[:, None] > 0)
    out[norm == 0, -1 if query else -2] = 1
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", pivots, pivots)
    return np.sqrt(np.maximum(squares - 2 * (x @ pivots.T), 0))


def _by_size(column, rows: np.ndarray):
    """(indices, matrix) of the vectors of each size."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes[rows]):
        own = rows[sizes[rows] == size]
        yield int(size), own, column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(size))


def _of(pivots: dict, dim: int, score: str) -> np.ndarray:
    return pivots.get(dim, np.zeros((1, dim + 2 if score == "cosine" else dim)))


def _assigned(pivots: dict, score: str):
    """Rows with the size of their vector, their cell and their distance from its pivot."""

    def run(batches):
        for batch in batches:
            column, n = batch.column(batch.schema.get_field_index("vector")), batch.num_rows
            dims, cell, dist = np.zeros(n, np.int32), np.zeros(n, np.int32), np.zeros(n)
            for dim, own, v in _by_size(column, np.arange(n)):
                for a in range(0, len(own), 4096):
                    d = _distances(_placed(v[a : a + 4096], score, False), _of(pivots, dim, score))
                    nearest = d.argmin(1)
                    part = own[a : a + 4096]
                    dims[part], cell[part], dist[part] = dim, nearest, d[np.arange(len(d)), nearest]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(cell), pa.array(dist)], [*batch.schema.names, *(f.name for f in _PLACE)])

    return run


class _Near:
    """Of queries of one size: their distances to the pivots of that size, and to each
    cell the least that its rows can have; ``slack`` covers what these are wrong by."""

    def __init__(self, q: np.ndarray, dim: int, pivots: dict, known: dict, score: str):
        own = _of(pivots, dim, score)
        cells = sorted(known[dim].items())
        self.numbers = np.array([c[0] for c in cells])
        low, high, self.n = (np.array([c[1][j] for c in cells], float) for j in range(3))
        between, all_d = _distances(own, own)[:, self.numbers], _distances(_placed(q, score, True), own)
        self.d, nearest = all_d[:, self.numbers], all_d.argmin(1)
        self.slack = SLACK * (1 + np.abs(all_d).max(1) + np.abs(high).max() + between.max(initial=0))
        least = np.maximum(np.maximum(self.d - high, low - self.d), 0)
        # A row of another cell lies beyond the plane between both pivots.
        apart = between[nearest]
        plane = np.divide(self.d**2 - all_d[np.arange(len(q)), nearest][:, None] ** 2, 2 * apart, out=np.zeros_like(self.d), where=apart > 0)
        least = np.maximum(least, plane) - self.slack[:, None]
        self.least, self.most = np.where(np.isfinite(least), least, -1.0), self.d + high

    def radius(self, k: int) -> np.ndarray:
        """Radii that hold k rows, infinite where there are not so many."""
        by = np.argsort(self.most, axis=1)
        filled = np.cumsum(self.n[by], axis=1) >= k
        at = np.where(filled.any(1), filled.argmax(1), 0)
        radius = np.where(filled.any(1), np.take_along_axis(self.most, by, 1)[np.arange(len(by)), at] + self.slack, np.inf)
        return np.where(np.isfinite(radius), radius, np.inf)


def _bounds(pivots: dict, known: dict, score: str, k: int):
    """For each query: its nearest cell, the distance to its pivot, and a radius that
    holds k rows."""

    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for dim, own, v in _by_size(column, np.arange(batch.num_rows)):
                if not known.get(dim):
                    continue
                for a in range(0, len(own), 1024):
                    near = _Near(v[a : a + 1024], dim, pivots, known, score)
                    part, nearest = pa.array(own[a : a + 1024]), near.d.argmin(1)
                    at = near.d[np.arange(len(nearest)), nearest]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(part), column.take(part), pa.array(np.full(len(part), dim), pa.int32()), pa.array(near.numbers[nearest], pa.int32()), pa.array(at), pa.array(near.radius(k)), pa.array(near.slack)],
                        ["query_id", "q", "__dim", "own", "at", "radius", "slack"],
                    )

    return run


class PivotIndex:
    """Packed rings of ``rows`` (vector, ...) for exact searches; ties by the columns of
    ``order``. Vectors with nulls, infinities or no numbers take no part."""

    def __init__(self, rows: DataFrame, score: str = "cosine", order: tuple[str, ...] = ("id",), pack_numbers: int = PACK_NUMBERS):
        self.score, self.order = score, list(order)
        self.fields = [f for f in rows.schema if f.name != "vector"]
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>")).where("size(vector) > 0").where(_finite("vector"))
        self.pivots = self._chosen(rows)
        placed = keep(rows.mapInArrow(_assigned(self.pivots, score), StructType([*rows.schema, *_PLACE])))
        # Equal distances, of equal vectors say, spread by the order of the rows.
        ranged = placed.repartitionByRange("__dim", "__cell", "__dist", F.xxhash64(*self.order)).sortWithinPartitions("__dim", "__cell", "__dist")
        rings = ranged.mapInArrow(_rings(self.order, pack_numbers), "__pack binary, __dim int, __cell int, low double, high double, n long")
        self.packs = keep(rings.withColumn("ring", F.monotonically_increasing_id()))
        forget(placed)
        self.rings = self.packs.drop("__pack")
        cells = self.rings.groupBy("__dim", "__cell").agg(F.min("low"), F.max("high"), F.sum("n")).collect()  # as many as pivots
        self.cells: dict[int, dict[int, tuple]] = {}
        for dim, cell, low, high, n in cells:
            self.cells.setdefault(dim, {})[cell] = (low, high, n)

    def _chosen(self, rows: DataFrame) -> dict[int, np.ndarray]:
        """Pivots of the commonest sizes of vectors: rows of the least hashes."""
        size = F.size("vector").alias("d")
        sizes = rows.groupBy(size).count().orderBy(F.desc("count"), "d").limit(MOST_SIZES).collect()
        wanted, left = {}, PIVOT_NUMBERS
        for d, n in sizes:
            wanted[d] = min(MOST_PIVOTS, max(1, n // ROWS_PER_PIVOT), left // d)
            left -= wanted[d] * d
        if not wanted:
            return {}
        many = F.element_at(F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv]), F.col("d"))
        first = F.row_number().over(Window.partitionBy("d").orderBy("h", "vector"))
        some = rows.select(size, "vector", F.xxhash64("vector").alias("h")).where(F.col("d").isin(list(wanted))).withColumn("nth", first)
        some = some.where(F.col("nth") <= MOST_PIVOTS).where(F.col("nth") <= many).select("d", "vector").collect()
        found: dict[int, list] = {}
        for d, v in some:
            found.setdefault(d, []).append(v)
        return {d: np.unique(_placed(np.array(v), self.score, False), axis=0) for d, v in found.items()}

    def _asked(self, queries: DataFrame, k: int) -> DataFrame:
        asked = queries.where("query_id is not null and query_vector is not null and size(query_vector) > 0").select("query_id", F.col("query_vector").cast("array<double>").alias("q"))
        kind = StructType([queries.schema["query_id"]] + StructType.fromDDL("q array<double>, __dim int, own int, at double, radius double, slack double").fields)
        return keep(asked.where(_finite("q")).mapInArrow(_bounds(self.pivots, self.cells, self.score, k), kind))

    def _first(self, asked: DataFrame) -> DataFrame:
        """One ring of each query's nearest cell, that of the likest distance."""
        of_cell = Window.partitionBy("__dim", "__cell")
        rank, n = F.row_number().over(of_cell.orderBy("low", "ring")) - 1, F.count(F.lit(1)).over(of_cell)
        spread = self.rings.withColumns({"rank": rank, "rings": n})
        # At most FIRST_RINGS of a cell, evenly.
        slot = lambda r: F.floor(r * FIRST_RINGS / F.col("rings"))
        spread = spread.where((F.col("rank") == 0) | (slot(F.col("rank")) != slot(F.col("rank") - 1)))
        spread = spread.select("__dim", F.col("__cell").alias("own"), "ring", "low", "high")
        near = asked.select("query_id", "__dim", "own", "at", F.size("q").alias("width")).join(spread, ["__dim", "own"])
        gap = F.greatest(F.col("low") - F.col("at"), F.col("at") - F.col("high"), F.lit(0.0))
        return near.groupBy("query_id", "width").agg(F.min_by("ring", F.struct(gap, "ring")).alias("ring"))

    def _scored(self, pairs: DataFrame, asked: DataFrame, k: int, schema: StructType) -> DataFrame:
        """The k best of each of ``pairs`` (query_id, ring), one for each query; a ring meets
        its queries in blocks."""
        blocks = F.ceil(F.sum("width") / BLOCK_NUMBERS)
        salts = pairs.groupBy("ring").agg(blocks.alias("salts"))
        dealt = pairs.join(salts, "ring").withColumn("salt", F.pmod(F.xxhash64("query_id"), "salts"))
        dealt = dealt.join(asked.select("query_id", "q"), "query_id")
        met = dealt.groupBy("ring", "salt").agg(F.collect_list("query_id").alias("__ids"), F.flatten(F.collect_list("q")).alias("__q"))
        return self.packs.join(met, "ring").select("__pack", "__dim", "__ids", "__q").mapInArrow(best_of_packs(k, self.score), schema)

    def _blocks(self, asked: DataFrame, first: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """Blocks of near queries with what is known of them: the ring that was scored
        first, and the k-th best rank in it."""
        kth = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"), F.max("__rank").alias("kth")).where(F.col("have") >= k).select("query_id", "kth")
        both = asked.join(first.select("query_id", "ring"), "query_id", "left").join(kth, "query_id", "left")
        numbers = asked.agg(F.sum(F.size("q").cast("long"))).first()[0] or 0
        most = min(MOST_BLOCK_NUMBERS, max(BLOCK_NUMBERS, numbers // BLOCKS))
        near = both.repartitionByRange(max(1, min(BLOCKS, numbers // most)), "__dim", "own", "at", F.xxhash64("query_id")).sortWithinPartitions("__dim", "own", "at")
        return keep(near.mapInArrow(_query_blocks(most), "block string, __dim int, asked binary"))

    def nearest(self, queries: DataFrame, k: int, counted: list | None = None) -> DataFrame:
        """As ``search.nearest_each``: query_id and the k nearest rows of each of
        ``queries`` (query_id, query_vector). ``counted`` gets the number of pairs of a
        query and a row that are scored."""
        schema, context = best_kind(queries, self.fields), queries.sparkSession.sparkContext
        asked = self._asked(queries, k)
        first = keep(self._first(asked))
        found = keep(self._scored(first, asked, k, schema))
        blocks = self._blocks(asked, first, found, k)
        scored = context.accumulator(0)
        if counted is not None:
            scored += first.join(self.rings, "ring").agg(F.sum("n")).first()[0] or 0
        numbers = self.rings.agg(F.sum(F.col("n") * F.col("__dim"))).first()[0] or 0
        bundles = self.packs.mapInArrow(_bundles, BUNDLE).repartition(max(1, -(-numbers // GROUP_NUMBERS)))
        tasks = max(1, min(blocks.count(), 4 * context.defaultParallelism))
        # No shuffle and no list of pairs: each task reads its blocks and bundles.
        met = blocks.repartition(tasks).hint("shuffle_replicate_nl").join(bundles, "__dim")
        rest = keep(met.select("block", "__dim", "asked", "bundle").mapInArrow(_best_of_blocks(k, self, scored), schema))
        if counted is not None:
            counted.append(scored.value)
        forget(asked, first, blocks)
        w = Window.partitionBy("query_id").orderBy("__rank", *self.order)
        return found.unionByName(rest).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n", "__rank")


def _stream(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _query_blocks(most: int):
    """Runs of queries of one size, as Arrow streams."""

    def run(batches):
        held, width, n = [], 0, 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([width], pa.int32()), pa.array([_stream(pa.Table.from_batches(held))], pa.binary())], ["block", "__dim", "asked"])

        for batch in batches:
            dim = batch.column(batch.schema.get_field_index("__dim")).to_numpy()
            for a, b in zip([0, *(cuts := np.flatnonzero(np.diff(dim)) + 1)], [*cuts, len(dim)]):
                while a < b:
                    if held and (dim[a] != width or n >= most):
                        yield made()
                        held, n = [], 0
                    width = int(dim[a])
                    part = batch.slice(a, min(b - a, max(1, (most - n) // width)))
                    held.append(part)
                    a, n = a + part.num_rows, n + part.num_rows * width
        if held:
            yield made()

    return run


BUNDLE = "__dim int, bundle array<struct<ring: long, cell: int, low: double, high: double, pack: binary>>"


def _bundles(batches):
    """Rings of one size of vectors, in rows of about BUNDLE_BYTES bytes."""
    kind = pa.list_(pa.struct([("ring", pa.int64()), ("cell", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("pack", pa.binary())]))
    held: dict[int, list] = {}
    made = lambda dim: pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([held.pop(dim)], kind)], ["__dim", "bundle"])
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            own = held.setdefault(r["__dim"], [])
            own.append({"ring": r["ring"], "cell": r["__cell"], "low": r["low"], "high": r["high"], "pack": r["__pack"]})
            if sum(len(x["pack"]) for x in own) >= BUNDLE_BYTES:
                yield made(r["__dim"])
            elif len(held) >= MOST_SIZES:
                yield made(next(iter(held)))
    for dim in list(held):
        yield made(dim)


class _Block:
    """Queries of a block and their best rows so far."""

    def __init__(self, asked: pa.Table, dim: int, k: int, index: PivotIndex):
        self.ids = asked.column("query_id").combine_chunks()
        column = asked.column("q").combine_chunks()
        self.q = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
        self.k, self.score, self.order = k, index.score, index.order
        self.near = _Near(self.q, dim, index.pivots, index.cells, index.score)
        self.place = {int(c): j for j, c in enumerate(self.near.numbers)}
        self.first = asked.column("ring").fill_null(-1).to_numpy()
        self.kth = asked.column("kth").fill_null(np.inf).to_numpy().copy()
        self.radius = np.minimum(asked.column("radius").to_numpy(), self._far(self.kth))
        self.own = np.einsum("ij,ij->i", self.q, self.q)
        self.held, self.rows = [], 0

    def _far(self, rank: np.ndarray) -> np.ndarray:
        """The distance between places that a rank means, from above."""
        return np.sqrt(np.maximum(0, 2 + 2 * rank if self.score == "cosine" else rank)) + self.near.slack

    def meet(self, ring: int, cell: int, low: float, high: float, pack) -> int:
        """Scores what the ring's rows can be near to; gives the number of pairs."""
        j, slack = self.place[cell], self.near.slack
        at = self.near.d[:, j]
        # Bounds that are no numbers leave nothing out.
        out = (low - at - slack > self.radius) | (at - high - slack > self.radius) | (self.near.least[:, j] > self.radius) | (self.first == ring)
        asked = np.flatnonzero(~out)
        if not len(asked):
            return 0
        part = pa.ipc.open_stream(pack).read_all().combine_chunks()
        v = pc.list_flatten(part.column("vector")).to_numpy().astype(float).reshape(-1, self.q.shape[1])
        part, squares = part.drop_columns(["vector"]), np.einsum("ij,ij->i", v, v)
        step = max(1, MOST_PAIRS // len(v))
        for a in range(0, len(asked), step):
            self._score(part, v, squares, asked[a : a + step])
        return len(v) * len(asked)

    def _score(self, part: pa.Table, v: np.ndarray, squares: np.ndarray, asked: np.ndarray) -> None:
        q, own, kth = self.q[asked], self.own[asked], self.kth[asked]
        if self.score == "cosine":
            rank, both = -(q @ v.T), np.sqrt(own)[:, None] * np.sqrt(squares)
            rank = np.divide(rank, both, out=np.zeros_like(rank), where=both > 0)
            slack = np.full(len(q), PRODUCT_SLACK)
        else:
            rank = (-2 * q) @ v.T
            rank += squares
            rank += own[:, None]
            slack = PRODUCT_SLACK * (own + squares.max())
        most = kth + slack
        unknown = np.flatnonzero(~np.isfinite(kth))
        if len(unknown):
            last = min(self.k, len(v)) - 1
            most[unknown] = np.partition(rank[unknown], last, axis=1)[:, last] + slack[unknown]
        near, at = np.nonzero(~(rank > most[:, None]))
        for i in range(0, len(near), MOST_PAIRS):
            self._add(part, v, asked[near[i : i + MOST_PAIRS]], at[i : i + MOST_PAIRS])

    def _add(self, part: pa.Table, v: np.ndarray, near: np.ndarray, at: np.ndarray) -> None:
        """Candidates with the score of an exact search: summed in order."""
        a, b = self.q[near], v[at]
        if self.score == "cosine":
            norm = np.sqrt(_in_order(a, a, np.multiply)) * np.sqrt(_in_order(b, b, np.multiply))
            value = np.divide(_in_order(b, a, np.multiply), norm, out=np.zeros(len(near)), where=norm > 0)
            rank = -value
        else:
            rank = _in_order(b, a, lambda x, y: (x - y) * (x - y))
            value = np.exp(-rank)
        good = ~(rank > self.kth[near])
        near, at, rank, value = near[good], at[good], rank[good], value[good]
        self.held.append(part.take(pa.array(at)).append_column("score", pa.array(value)).append_column("__rank", pa.array(rank)).append_column("__near", pa.array(near, pa.int64())))
        self.rows += len(near)
        if self.rows >= max(MOST_PAIRS, 4 * self.k * len(self.q)):
            self.best()

    def best(self) -> pa.Table | None:
        """Leaves the k best of each query, in order."""
        if not self.held:
            return None
        table = pa.concat_tables(self.held)
        keys = [("__near", "ascending"), ("__rank", "ascending"), *((c, "ascending") for c in self.order)]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        near = table.column("__near").to_numpy()
        nth = np.arange(len(near)) - np.searchsorted(near, near)
        full = np.flatnonzero(nth == self.k - 1)
        rank = table.column("__rank").to_numpy()[full]
        self.kth[near[full]] = np.fmin(self.kth[near[full]], rank)
        self.radius = np.fmin(self.radius, self._far(self.kth))
        table = table.filter(pa.array(nth < self.k)).combine_chunks()
        self.held, self.rows = [table], table.num_rows
        return table


def _best_of_blocks(k: int, index: PivotIndex, scored):
    """The k best of each query of a block among the bundles that follow each other."""
    of = _Searched(index)

    def told(block: _Block):
        table = block.best()
        if table is not None and table.num_rows:
            ids = block.ids.take(table.column("__near").combine_chunks())
            table = table.drop_columns(["__near"]).add_column(0, "query_id", ids)
            yield from table.combine_chunks().to_batches(max_chunksize=4096)

    def run(batches):
        block, name, pairs = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("block")[i].as_py() != name:
                    if block is not None:
                        yield from told(block)
                    name, dim = batch.column("block")[i].as_py(), batch.column("__dim")[i].as_py()
                    block = _Block(pa.ipc.open_stream(batch.column("asked")[i].as_buffer()).read_all(), dim, k, of)
                rings = batch.column("bundle")[i].values
                fields = [rings.field(c) for c in ("ring", "cell", "low", "high", "pack")]
                for r in range(len(rings)):
                    pairs += block.meet(*(f[r].as_py() for f in fields[:4]), fields[4][r].as_buffer())
        if block is not None:
            yield from told(block)
        scored.add(pairs)

    return run


class _Searched:
    """What tasks need of an index."""

    def __init__(self, index: PivotIndex):
        self.pivots, self.cells, self.score, self.order = index.pivots, index.cells, index.score, index.order


def _rings(order: list[str], pack_numbers: int):
    """Packs of rows of one cell that follow each other by distance."""

    def run(batches):
        for batch in batches:
            dim, cell, dist = (batch.column(batch.schema.get_field_index(f.name)).to_numpy() for f in _PLACE)
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (cell[1:] != cell[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
                step = max(1, pack_numbers // max(1, int(dim[a])))
                for c in range(a, b, step):
                    part = pa.Table.from_batches([batch.slice(c, min(step, b - c))]).drop_columns([f.name for f in _PLACE])
                    n = part.num_rows
                    values = [pa.array([packed(part, order)], pa.binary()), pa.array([dim[c]], pa.int32()), pa.array([cell[c]], pa.int32()), pa.array([dist[c]]), pa.array([dist[c + n - 1]]), pa.array([n], pa.int64())]
                    yield pa.RecordBatch.from_arrays(values, ["__pack", "__dim", "__cell", "low", "high", "n"])

    return run


def nearest_pruned(rows: DataFrame, queries: DataFrame, k: int, score: str = "cosine", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """``search.nearest_each`` by pivots: the same rows, with fewer pairs scored where
    vectors lie in groups."""
    return PivotIndex(rows, score, order).nearest(queries, k)
