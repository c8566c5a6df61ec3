"""A proximity-graph index of vectors, and its life: build, add, rebuild, clear, stats.

Rows are dealt to shards of bounded size. A task links each row of a shard to near rows
that lie in different directions, and to a few at random; a search starts at some
sampled rows and walks the links towards the query with a beam of ``ef`` rows, for a
block of queries at a time. Each shard is searched and the best of all are merged.

An index is a folder of parts (Parquet tables of shards) and versions. A version lists
its parts and is written last, so readers see whole versions only; ``search`` takes the
newest. Adding rows writes one part and a version; what is there isn't read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import best_kind

#: Numbers in a shard's vectors, links of a row (twice that with links back), near rows
#: looked at for them, random links, rows where walks start, rows expanded at once.
SHARD_NUMBERS = 1 << 20
LINKS = 32
NEAR = 64
RANDOM_LINKS = 4
STARTS = 128
AT_ONCE = 4
#: Pairs of rows whose distances are held at once to link them.
PAIRS = 1 << 21
#: Width of the beam, and the most slots that shards are dealt to for a search. Numbers in
#: the queries that come to a shard at once, as the shard comes anew each time; queries
#: that walk at once, each with some hundred vectors in hand.
EF = 64
SLOTS = 1000
BLOCK_NUMBERS = 1 << 18
WALKING = 64


def _sound(rows: DataFrame, vector: str) -> DataFrame:
    rows = rows.withColumn(vector, F.col(vector).cast("array<double>")).where(F.size(vector) > 0)
    return rows.where(~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))


def linked(x: np.ndarray, links: int = LINKS, near: int = NEAR, seed: int = 0) -> np.ndarray:
    """Links of each row of ``x`` to other rows, -1 where there are fewer."""
    n, x = len(x), x.astype(np.float32)
    near, rng = min(near, n - 1), np.random.default_rng(seed)
    out = np.full((n, 2 * links + RANDOM_LINKS), -1, np.int32)
    if near < 1:
        return out
    squares = np.einsum("ij,ij->i", x, x)
    step = max(1, min(1024, PAIRS // max(n, near * near, near * x.shape[1])))
    for a in range(0, n, step):
        own = np.arange(a, min(n, a + step))
        d = squares - 2 * (x[own] @ x.T)
        d[np.arange(len(own)), own] = np.inf
        some = np.argpartition(d, near - 1, axis=1)[:, :near]
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1), 1)
        dist = np.take_along_axis(d, some, 1) + squares[own][:, None]
        v = x[some]
        between = squares[some][:, :, None] + squares[some][:, None, :] - 2 * np.einsum("bid,bjd->bij", v, v)
        # A row is linked unless a linked one is nearer to it: links go different ways.
        kept = np.zeros(some.shape, bool)
        for j in range(near):
            kept[:, j] = ~(kept & (between[:, j, :] <= dist[:, j, None])).any(1) & (kept.sum(1) < links)
        order = np.argsort(~kept, axis=1, kind="stable")[:, :links]  # then the nearest others
        out[own, : order.shape[1]] = np.take_along_axis(some, order, 1)
    # Links back, the nearest first, as far as there is room.
    source, target = np.repeat(np.arange(n), links), out[:, :links].ravel()
    source, target = source[target >= 0], target[target >= 0]
    gap = np.concatenate([((x[source[a : a + 65536]] - x[target[a : a + 65536]]) ** 2).sum(1) for a in range(0, len(source), 65536)])
    order = np.lexsort((gap, target))
    source, target = source[order], target[order]
    nth = np.arange(len(target)) - np.searchsorted(target, target)
    room = nth < links
    out[target[room], links + nth[room]] = source[room]
    out[:, 2 * links :] = rng.integers(0, n, (n, RANDOM_LINKS))
    return out


def walked(x: np.ndarray, links: np.ndarray, q: np.ndarray, k: int, ef: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows near each of ``q`` (-1: none), their squared distances, and how many
    distances were computed."""
    n, many = len(x), len(q)
    ef = min(max(ef, k), n)
    starts = np.random.default_rng(seed).permutation(n)[: max(STARTS, min(n, ef))]
    squares, own = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", q, q)
    dist = own[:, None] + squares[starts] - 2 * (q @ x[starts].T)
    best = np.argsort(dist, axis=1)[:, :ef]
    ids, dist = starts[best], np.take_along_axis(dist, best, 1)
    if ids.shape[1] < ef:
        pad = ef - ids.shape[1]
        ids, dist = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    done = ids < 0
    seen = np.zeros((many, n), bool)
    seen[:, starts] = True
    scored, active = many * len(starts), np.arange(many)
    while len(active):
        open_ = np.where(done[active], np.inf, dist[active])
        pick = np.argsort(open_, axis=1)[:, :AT_ONCE]
        usable = np.isfinite(np.take_along_axis(open_, pick, 1))
        going = usable[:, 0]
        active, pick, usable = active[going], pick[going], usable[going]
        if not len(active):
            break
        done[active[:, None], pick] = True
        found = np.where(usable[:, :, None], links[ids[active[:, None], pick]], -1).reshape(len(active), -1)
        found.sort(axis=1)
        fresh = found >= 0
        fresh[:, 1:] &= found[:, 1:] != found[:, :-1]
        fresh &= ~seen[active[:, None], np.maximum(found, 0)]
        row, at = np.nonzero(fresh)
        to = found[row, at]
        seen[active[row], to] = True
        scored += len(to)
        d = np.full(found.shape, np.inf)
        d[row, at] = own[active[row]] + squares[to] - 2 * np.einsum("ij,ij->i", x[to], q[active[row]])
        all_d = np.concatenate([dist[active], d], axis=1)
        all_id = np.concatenate([ids[active], np.where(fresh, found, -1)], axis=1)
        all_done = np.concatenate([done[active], ~fresh], axis=1)
        keep = np.argsort(all_d, axis=1, kind="stable")[:, :ef]
        ids[active], dist[active], done[active] = (np.take_along_axis(z, keep, 1) for z in (all_id, all_d, all_done))
    return ids[:, :k], dist[:, :k], scored


def _shards(dim: int, links: int, near: int):
    """A shard for each so many rows of a partition: the rows in order of their nodes,
    where each node's rows end, and the nodes' vectors and links."""
    most = max(1, SHARD_NUMBERS // dim)

    def made(parts):
        table = pa.Table.from_batches(parts).combine_chunks()
        x = table.column("__vector").combine_chunks()
        x = (pa.concat_arrays(x.chunks) if isinstance(x, pa.ChunkedArray) else x).flatten().to_numpy().astype(float).reshape(-1, dim)
        # Equal vectors are one node, so that walks don't end among copies.
        nodes, node = np.unique(x + 0.0, axis=0, return_inverse=True)
        order = np.argsort(node.ravel(), kind="stable")
        rows, out = table.drop_columns(["__vector"]).take(pa.array(order)), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, rows.schema) as stream:
            stream.write_table(rows)
        ends = np.cumsum(np.bincount(node.ravel(), minlength=len(nodes)))
        parts = (out.getvalue().to_pybytes(), ends.astype("<i8").tobytes(), nodes.astype("<f8").tobytes(), linked(nodes, links, near).astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), *(pa.array([v], pa.binary()) for v in parts)], ["n", "rows", "ends", "vectors", "links"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                part = batch.slice(a, most - n)
                held.append(part)
                a, n = a + part.num_rows, n + part.num_rows
                if n == most:
                    yield made(held)
                    held, n = [], 0
        if n:
            yield made(held)

    return run


class VectorIndex:
    """The index in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{self.folder}/{name}" if name else self.folder)
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest whole version; 0 where there is none."""
        if not self._files.exists(self._path("versions")):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(self._path("versions"))]
        return max([0, *(int(n) for n in names if n.isdigit() and self._files.exists(self._path(f"versions/{n}/_SUCCESS")))])

    def _listed(self):
        """The parts of the newest version."""
        n = self.version()
        return self.spark.read.parquet(f"{self.folder}/versions/{n}").collect() if n else []

    def ready(self) -> bool:
        return any(p["rows"] for p in self._listed())

    def stats(self) -> DataFrame:
        """(version, dim, parts, shards, rows, skipped): one row, of zeros where nothing is built."""
        parts = self._listed()
        sums = [sum(p[c] for p in parts) for c in ("shards", "rows", "skipped")]
        row = (self.version(), parts[0]["dim"] if parts else 0, len(parts), *sums)
        return self.spark.createDataFrame([row], "version long, dim int, parts long, shards long, rows long, skipped long")

    def clear(self) -> None:
        """Deletes all versions and parts."""
        if self._files.exists(self._path("")):
            self._files.delete(self._path(""), True)

    def rebuild(self, rows: DataFrame, links: int = LINKS, near: int = NEAR) -> int:
        """Builds a version of ``rows`` (vector, ...) alone; gives its number. Older ones
        stay for readers that have them."""
        return self._written([], rows, links, near)

    def add(self, rows: DataFrame, links: int = LINKS, near: int = NEAR) -> int:
        """A version with ``rows`` besides those of the newest one."""
        return self._written(self._listed(), rows, links, near)

    def _written(self, parts: list, rows: DataFrame, links: int, near: int) -> int:
        """Vectors of another size than the first part's (at first, than most) are skipped
        and counted, and so are ones with nulls, infinities or no numbers."""
        total = rows.count()
        good = _sound(rows, "vector")
        dim = parts[0]["dim"] if parts else None
        if dim is None:
            common = good.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
            dim = common["d"] if common else 0
        good = good.where(F.size("vector") == dim).withColumnRenamed("vector", "__vector")
        n = good.count()
        name, shards = f"parts/{uuid.uuid4().hex}", 0
        if n:
            most = max(1, SHARD_NUMBERS // dim)
            made = good.repartition(-(-n // most)).mapInArrow(_shards(dim, links, near), "n long, rows binary, ends binary, vectors binary, links binary")
            made.withColumn("shard", F.expr("uuid()")).write.parquet(f"{self.folder}/{name}")
            shards = self.spark.read.parquet(f"{self.folder}/{name}").count()
        listed = [tuple(p) for p in parts] + [(name, dim, shards, n, total - n)]
        listed = [p for p in listed if p[2]] or listed[-1:]
        number = self.version() + 1
        self.spark.createDataFrame(listed, "part string, dim int, shards long, rows long, skipped long").coalesce(1).write.parquet(f"{self.folder}/versions/{number}")
        return number

    def shards(self) -> DataFrame:
        paths = [f"{self.folder}/{p['part']}" for p in self._listed() if p["shards"]]
        if not paths:
            raise RuntimeError("the index is empty: rebuild it or add rows first")
        return self.spark.read.parquet(*paths)

    def search(self, queries: DataFrame, fields: list, k: int, ef: int = EF, folders: list | None = None, score_from: float | None = None, over: int = 3, order: tuple[str, ...] = ("id",)) -> DataFrame:
        """query_id, the columns of ``fields`` (their StructFields) and score of about the
        k nearest rows of each of ``queries`` (query_id, query_vector).

        With ``folders``, ``over`` * k are fetched before those of other folders go; scores
        are exp(-squared distance), those under ``score_from`` go. A query vector of
        another size than the index's is an error. k beyond the index's size gives all.
        """
        dim = self._listed()[0]["dim"] if self.ready() else 0
        shards = self.shards()
        wrong = F.concat(F.lit("query vector of size "), F.size("query_vector").cast("string"), F.lit(f" does not match the index's, {dim}"))
        asked = queries.where("query_id is not null and query_vector is not null").withColumn(
            "q", F.when(F.size("query_vector") == dim, F.col("query_vector").cast("array<double>")).otherwise(F.raise_error(wrong).cast("array<double>"))
        )
        fetched = k * over if folders is not None else k
        per_block = max(1, BLOCK_NUMBERS // dim)
        n = max(1, -(-queries.count() // per_block))
        slots = min(SLOTS, sum(p["shards"] for p in self._listed()))
        blocks = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block")).agg(F.collect_list("query_id").alias("ids"), F.flatten(F.collect_list("q")).alias("q"))
        # The stated queries meet every shard, block by block.
        blocks = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
        met = shards.withColumn("slot", F.pmod(F.xxhash64("shard"), F.lit(slots)).cast("int")).join(blocks, "slot")
        found = met.select("rows", "ends", "vectors", "links", "ids", "q").mapInArrow(_found(dim, fetched, ef), best_kind(queries, fields))
        w = Window.partitionBy("query_id").orderBy("__rank", *order)
        best = lambda rows, most: rows.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")
        found = best(found, fetched)
        if folders is not None:
            found = best(found.where(F.col("folder").isin(folders)), k)
        if score_from is not None:
            found = found.where(F.col("score") >= score_from)
        return found.drop("__rank")


def _found(dim: int, k: int, ef: int):
    def of_some(rows, x, links, ends, ids, q):
        near, _, _ = walked(x, links, q, k, ef)
        # All rows of a node, as long as nearer ones are fewer than k.
        copies = np.where(near >= 0, ends[near] - np.where(near > 0, ends[near - 1], 0), 0)
        wanted = (near >= 0) & (np.cumsum(copies, axis=1) - copies < k)
        row, at = np.nonzero(wanted)
        node, n = near[row, at], copies[row, at]
        row, node = np.repeat(row, n), np.repeat(node, n)
        nth = np.arange(len(node)) - np.repeat(np.cumsum(n) - n, n)
        place = ends[node] - np.repeat(n, n) + nth
        # Scores as an exact search has them: summed in order.
        d = np.zeros(len(node))
        for j in range(dim):
            d += (x[node, j] - q[row, j]) ** 2
        out = rows.take(pa.array(place))
        table = pa.table([ids.take(pa.array(row)), *out.columns, pa.array(np.exp(-d)), pa.array(d)], ["query_id", *out.column_names, "score", "__rank"])
        yield from table.combine_chunks().to_batches(max_chunksize=4096)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows = pa.ipc.open_stream(batch.column("rows")[i].as_buffer()).read_all()
                x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<f8").reshape(-1, dim)
                links = np.frombuffer(batch.column("links")[i].as_buffer(), "<i4").reshape(len(x), -1)
                ids = batch.column("ids")[i].values
                q = batch.column("q")[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                ends = np.frombuffer(batch.column("ends")[i].as_buffer(), "<i8")
                for a in range(0, len(q), WALKING):
                    yield from of_some(rows, x, links, ends, ids.slice(a, WALKING), q[a : a + WALKING])

    return run


def recall(found: DataFrame, exact: DataFrame, key: str = "id") -> float:
    """The share of ``exact`` (query_id, key) that is in ``found``."""
    both = exact.select("query_id", key).join(found.select("query_id", key, F.lit(1).alias("hit")), ["query_id", key], "left")
    return both.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 0.0
