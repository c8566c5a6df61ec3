"""Search by vectors: exact top k with scopes, folders, thresholds and caches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.vectors import cosine, distance_score, squared_distance

#: Numbers of a pack of rows and of a block of queries that meet in a task at once.
PACK_NUMBERS = 1 << 18
BLOCK_NUMBERS = 1 << 15
#: Pairs of a row and a query that are scored at once.
MOST_PAIRS = 1 << 16
#: Relative error that a matrix product may have against a sum in order.
SLACK = 1e-9


def nearest(rows: DataFrame, query: DataFrame, k: int, score: str = "cosine") -> DataFrame:
    """The k rows (id, vector, ...) nearest to the one of ``query`` (query_vector):
    one pass, top k in each task, k rows a task merged."""
    both = rows.crossJoin(F.broadcast(query.select("query_vector")))  # one row
    v, q = F.col("vector"), F.col("query_vector")
    value = cosine(v, q) if score == "cosine" else distance_score(squared_distance(v, q))
    both = both.where(F.size(v) == F.size(q)).withColumn("score", value).drop("vector", "query_vector")
    return both.orderBy(F.desc("score"), "id").limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, k: int, score: str = "cosine", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """query_id and the k rows (vector, ...) nearest to each of ``queries`` (query_id,
    query_vector), all rows looked at; ties by the columns of ``order``.

    Packs of rows meet blocks of queries, both of bounded size, in a matrix product
    that finds what may be among a pack's k best; their scores are then summed in
    order, as ``nearest`` does. Vectors of another size than the query's, and ones
    with nulls, infinities or no numbers, take no part, nor do queries without an id.
    Query ids must be unique.
    """
    asked = queries.where("query_id is not null and query_vector is not null and size(query_vector) > 0").select("query_id", F.col("query_vector").cast("array<double>").alias("q"))
    asked = asked.where(~F.exists("q", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    # Numbered by size and hash: blocks are of BLOCK_NUMBERS on the whole.
    numbers = asked.agg(F.sum(F.size("q").cast("long"))).first()[0] or 0
    n = max(1, -(-numbers // BLOCK_NUMBERS))
    block = F.struct(F.size("q").alias("dim"), F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("b"))
    blocks = asked.groupBy(block.alias("__block")).agg(F.collect_list("query_id").alias("__ids"), F.flatten(F.collect_list("q")).alias("__q")).select(F.col("__block.dim").alias("__dim"), "__ids", "__q")
    packs = rows.withColumn("vector", F.col("vector").cast("array<double>")).mapInArrow(_packs(list(order)), "__pack binary")
    kind = best_kind(queries, [f for f in rows.schema if f.name != "vector"])
    found = packs.repartition(F.xxhash64("__pack")).crossJoin(blocks).mapInArrow(best_of_packs(k, score), kind)
    w = Window.partitionBy("query_id").orderBy("__rank", *order)
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n", "__rank")


def best_kind(queries: DataFrame, fields: list[StructField]) -> StructType:
    return StructType([queries.schema["query_id"], *fields, StructField("score", DoubleType()), StructField("__rank", DoubleType())])


def packed(part: pa.Table, order: list[str]) -> bytes:
    """Rows in ``order`` as an Arrow stream."""
    part = part.take(pc.sort_indices(part, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, part.schema) as stream:
        stream.write_table(part)
    return out.getvalue().to_pybytes()


def _packs(order: list[str]):
    """Rows as Arrow streams of bounded size, in ``order``."""

    def run(batches):
        for batch in batches:
            flat = batch.column("vector")
            widest = max(1, pc.max(pc.list_value_length(flat)).as_py() or 1)
            step = max(1, PACK_NUMBERS // widest)
            for a in range(0, batch.num_rows, step):
                part = packed(pa.Table.from_batches([batch.slice(a, step)]), order)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], ["__pack"])

    return run


def _in_order(a: np.ndarray, b: np.ndarray, step) -> np.ndarray:
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += step(a[:, d], b[:, d])
    return total


def best_of_packs(k: int, score: str):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part = pa.ipc.open_stream(batch.column("__pack")[i].as_buffer()).read_all()
                dim, ids = batch.column("__dim")[i].as_py(), batch.column("__ids")[i].values
                queries = batch.column("__q")[i].values.to_numpy(zero_copy_only=False).reshape(-1, dim)
                part = part.filter(pc.fill_null(pc.equal(pc.list_value_length(part.column("vector")), dim), False))
                if not part.num_rows:
                    continue
                v = pc.list_flatten(part.column("vector")).to_numpy().astype(float).reshape(-1, dim)
                sound = np.isfinite(v).all(1)
                part, v = part.filter(pa.array(sound)), v[sound]
                step = max(1, MOST_PAIRS // max(1, len(v)))
                for a in range(0, len(ids) if len(v) else 0, step):
                    yield from _best_of(part.drop_columns(["vector"]), v, ids.slice(a, step), queries[a : a + step], k, score)

    return run


def _best_of(part: pa.Table, v: np.ndarray, ids, queries: np.ndarray, k: int, score: str):
    squares, own = np.einsum("ij,ij->i", v, v), np.einsum("ij,ij->i", queries, queries)
    rank = -(queries @ v.T)
    if score == "cosine":
        both = np.sqrt(own)[:, None] * np.sqrt(squares)
        rank = np.divide(rank, both, out=np.zeros_like(rank), where=both > 0)
        slack = np.full((len(queries), 1), SLACK)
    else:
        rank = 2 * rank + squares + own[:, None]
        slack = SLACK * (own[:, None] + squares.max())
    last = min(k, len(v)) - 1
    near, at = np.nonzero(rank <= np.partition(rank, last, axis=1)[:, last : last + 1] + slack)
    a, b = queries[near], v[at]
    if score == "cosine":
        norm = np.sqrt(_in_order(a, a, np.multiply)) * np.sqrt(_in_order(b, b, np.multiply))
        value = np.divide(_in_order(b, a, np.multiply), norm, out=np.zeros(len(near)), where=norm > 0)
        rank = -value
    else:
        rank = _in_order(b, a, lambda x, y: (x - y) * (x - y))
        value = np.exp(-rank)
    best = np.lexsort((at, rank, near))
    near, at, rank, value = near[best], at[best], rank[best], value[best]
    first = np.arange(len(near)) - np.searchsorted(near, near) < k
    near, at, rank, value = near[first], at[first], rank[first], value[first]
    out = part.take(pa.array(at))
    columns = [ids.take(pa.array(near)), *out.columns, pa.array(value), pa.array(rank)]
    yield from pa.table(columns, ["query_id", *out.column_names, "score", "__rank"]).to_batches(max_chunksize=4096)


def nearest_in(rows: DataFrame, query: DataFrame, k: int, folders: list | None = None, score_from: float | None = None, over: int = 3) -> DataFrame:
    """Nearest rows by distance, then those of some folders and above a threshold:
    ``over`` * k are fetched before the folder filter, as an index would."""
    found = nearest(rows, query, k * over if folders is not None else k, "distance")
    if folders is not None:
        found = found.where(F.col("folder").isin(folders))
    if score_from is not None:
        found = found.where(F.col("score") >= score_from)
    return found.orderBy(F.desc("score"), "id").limit(k)


def nearest_in_each(rows: DataFrame, queries: DataFrame, k: int, folders: list | None = None, score_from: float | None = None, over: int = 3) -> DataFrame:
    """``nearest_in`` for each of ``queries`` (query_id, query_vector)."""
    found = nearest_each(rows, queries, k * over if folders is not None else k, "distance")
    if folders is not None:
        found = found.where(F.col("folder").isin(folders))
    if score_from is not None:
        found = found.where(F.col("score") >= score_from)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k).drop("__n")


def with_vectors(rows: DataFrame, cached: DataFrame, embed) -> DataFrame:
    """rows (id, content, ...) with vector: cached ones (id, vector), else what
    ``embed`` makes of the rest (id, content) in batches. Two branches, so the
    costly function sees missing rows only."""
    hit = rows.join(cached, "id")
    miss = rows.join(cached.select("id"), "id", "left_anti")
    made = miss.join(embed(miss.select("id", "content")), "id")
    return hit.unionByName(made)


def search_library(papers: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, abstracts: DataFrame, links: DataFrame, query: DataFrame,
                   folders: list | None = None, scope: str = "all", top: int = 50, depth: int = 2) -> DataFrame:
    """Chunks of the papers in some folders and abstracts linked to them, best first.

    papers (paper_id, folder), chunks (id, paper_id, content), chunk_vectors (id,
    vector), abstracts (graph_id, abstract, vector), links (graph_id, paper_id,
    depth), query (query_vector; with query_id too, the best of each query). scope:
    chunks, abstracts or all.
    """
    scoped = papers if folders is None else papers.where(F.col("folder").isin(folders))
    parts = []
    if scope in ("chunks", "all"):
        own = chunks.join(scoped, "paper_id").join(chunk_vectors, "id")
        parts.append(own.select(F.lit("chunk").alias("type"), F.col("id"), "paper_id", F.lit(None).cast("array<long>").alias("source_papers"), F.lit(None).cast("int").alias("min_depth"), F.col("content"), "vector"))
    if scope in ("abstracts", "all"):
        near = links.where(F.col("depth") <= depth).join(scoped, "paper_id", "left_semi")
        near = near.groupBy("graph_id").agg(F.array_sort(F.collect_set("paper_id")).alias("source_papers"), F.min("depth").alias("min_depth"))
        known = near.join(abstracts.where(F.length(F.trim("abstract")) > 0), "graph_id")
        parts.append(known.select(F.lit("abstract").alias("type"), F.col("graph_id").alias("id"), F.lit(None).cast("long").alias("paper_id"), "source_papers", "min_depth", F.col("abstract").alias("content"), "vector"))
    found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if "query_id" in query.columns:
        return nearest_each(found, query, top, order=("type", "id"))
    both = found.crossJoin(F.broadcast(query.select("query_vector")))  # one row
    both = both.withColumn("score", cosine(F.col("vector"), F.col("query_vector"))).drop("vector", "query_vector")
    return both.orderBy(F.desc("score"), "type", "id").limit(top)


def search_chunks(papers: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, query: DataFrame, folders: DataFrame | None = None,
                  names: list[str] = (), ids: list = (), top: int = 20) -> DataFrame:
    """The chunks nearest to a query in the folders (id, name) that are named, in any case,
    or given by id; in all folders where neither is given. Abstracts take no part."""
    if folders is None or not (names or ids):
        return search_library(papers, chunks, chunk_vectors, None, None, query, None, "chunks", top)
    known = folders.where(F.lower("name").isin([n.lower() for n in names]) | F.col("id").isin(list(ids))).select(F.col("id").alias("folder"))
    return search_library(papers.join(known, "folder", "left_semi"), chunks, chunk_vectors, None, None, query, None, "chunks", top)


def hashed_vectors(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(id, vector) of texts (id, content): counts of hashed words scaled to length
    1, a stand-in for a model that needs no model."""
    words = rows.select("id", F.explode(F.filter(F.split(F.lower("content"), r"\W+"), lambda w: w != "")).alias("w"))
    counts = words.groupBy("id", F.pmod(F.xxhash64("w"), F.lit(dim)).cast("int").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    full = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("l"))
    at = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("l")).cast("float"))
    return full.select("id", at.alias("vector"))
