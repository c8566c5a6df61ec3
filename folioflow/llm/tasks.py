"""What the operators of this subpackage share: the shared folder, written
intermediate tables and vectorised helpers that run inside tasks."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the six ASCII white space characters, as the contracts spell them.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

#: A key counts as hot from LEAST_HOT rows, and from a MOST_HOT-th of all rows: fewer
#: than MOST_HOT keys are ever broadcast. A hot key's rows go to MOST_SALTS tasks at most.
LEAST_HOT = 500
MOST_HOT = 100_000
MOST_SALTS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Where that is unset, a temporary folder
    is made and set on a local master alone; on a cluster it is an error, as each
    executor would write to a disk of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the file, never
    a second run of what came before.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote, once all that was made of them is written
    too, and let the driver drop the shuffle files of finished jobs."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    free_shuffles(tables[0].sparkSession)


def free_shuffles(spark: SparkSession) -> None:
    """Let the driver drop the shuffle files of jobs whose results are written."""
    gc.collect()
    spark._jvm.System.gc()


def hot_join(rows: DataFrame, groups: DataFrame, on: list[str], count: str) -> DataFrame:
    """``rows`` left-joined with ``groups`` (one row for each key, ``count`` rows of it
    in ``rows``), such that no task gets a key whole which many rows share.

    Keys with more than a MOST_HOT-th of all rows are fewer than MOST_HOT; these are
    broadcast, their rows salted and their groups repeated for each salt.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    limit = max(LEAST_HOT, -(-int(total) // MOST_HOT))
    salts = F.least(F.lit(MOST_SALTS), F.ceil(F.col(count) / limit)).cast("int")
    hot = groups.where(F.col(count) > limit).select(*on, salts.alias("__salts"))
    salted = rows.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.when(F.col("__salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("__salts"))).otherwise(0).cast("int")
    )
    spread = F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1))
    return salted.drop("__salts").join(groups.withColumn("__salt", spread), [*on, "__salt"], "left").drop("__salt")


def _given_back() -> None:
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def tidy(run):
    """``run`` over batches; when a partition is done, its worker gives freed memory back
    to the system. Workers stay between stages, and what they hold counts against the
    executor while others work."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            _given_back()

    return tidied


def tidy_group(run):
    """The same for a function of one group."""

    def tidied(table):
        out = run(table)
        _given_back()
        return out

    return tidied


def unused(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as no column has."""
    while name.lower() in {t.lower() for t in taken}:
        name = f"{name}_"
    return name


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def bucket_count(df: DataFrame, col: str, per_bucket: int) -> int:
    """How many hash buckets keep each near ``per_bucket`` characters of ``col``;
    counted over all rows, so that buckets stay as small when the input grows."""
    total = df.agg(F.sum(F.length(col))).first()[0] or 0
    return max(16, -(-int(total) // per_bucket))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def text_slices(ids, texts, most_bytes: int = 1 << 18):
    """Groups rows of a batch into lists of about ``most_bytes`` bytes (one row
    at least), as (ids, list of bytes): bounds what vectorised steps allocate. Arrow
    columns are turned into Python values row by row."""
    got_ids, got, n = [], [], 0
    for i, t in zip(ids, texts, strict=True):
        i, t = (x.as_py() if hasattr(x, "as_py") else x for x in (i, t))
        raw = (t or "").encode("utf-8", "surrogatepass") if not isinstance(t, bytes) else t
        got_ids.append(i)
        got.append(raw)
        n += len(raw)
        if n >= most_bytes:
            yield got_ids, got
            got_ids, got, n = [], [], 0
    if got:
        yield got_ids, got


def key_runs(batches, keys: list[str]):
    """Yields one pyarrow table for each run of equal ``keys`` in a sorted stream
    of record batches; a run may go over several batches."""
    import pyarrow as pa

    last, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if parts and key != last:
                yield pa.Table.from_batches(parts)
                parts = []
            last = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield pa.Table.from_batches(parts)
