"""Tables of a library: reading, writing, and changes expressed as new tables.

Parquet has no rows to change in place, so each change is a function from tables
to the table that replaces them; ``swap`` writes it beside the old one.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a
    temporary one; on a cluster that is an error, as executors share no disk."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back: cuts the lineage and outlives
    executors."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that ``keep`` wrote, once all that was made of them is written too,
    and lets the driver drop the shuffle files of finished jobs."""
    for table in tables:
        files = table.inputFiles()
        if files:
            jvm, context = table.sparkSession._jvm, table.sparkSession.sparkContext
            path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def swap(df: DataFrame, folder: str, name: str) -> str:
    """Write a new version of a table; readers take the path that is returned. The
    table that ``df`` may read is never overwritten."""
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace the partitions of a table that occur in ``df``, leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def with_new_ids(rows: DataFrame, old: DataFrame, id_col: str, order: list[str]) -> DataFrame:
    """New rows numbered on from the largest id of ``old``, in the given order."""
    start = old.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    return numbered_in_order(rows, id_col, order, start)


def numbered_in_order(rows: DataFrame, id_col: str, order: list[str], start: int = 0) -> DataFrame:
    """``rows`` with ``id_col``, ``start`` + 1 and so on in the given order.

    Ranges are numbered in parallel: each partition of the sorted rows adds the
    counts of those before it.
    """
    # The number of partitions bounds what is collected.
    ranged = keep(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    total = {}
    for part in sorted(counts):
        total[part] = start
        start += counts[part]
    if not total:
        return rows.withColumn(id_col, F.lit(0).cast("long"))
    base = F.create_map(*[x for p, n in total.items() for x in (F.lit(p), F.lit(n))])
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn(id_col, (base[F.col("__part")] + nth).cast("long")).drop("__part")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], newest: str | None = None) -> DataFrame:
    """``old`` with rows of ``new`` in place of those with equal keys; of new rows
    with equal keys the one with the largest ``newest``."""
    if newest:
        w = Window.partitionBy(*keys).orderBy(F.desc(newest))
        new = new.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def inserted_or_ignored(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").dropDuplicates(keys))


def updated(rows: DataFrame, where: Column, **values: Column) -> DataFrame:
    return rows.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def deleted(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys), keys, "left_anti")


def cascade_deleted(tables: dict[str, DataFrame], gone: DataFrame, links: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables after the rows of the first link's parent in ``gone`` are deleted and
    all that refers to them. links: (parent, its key, child, the child's column), in
    order from the top."""
    lost = {links[0][0]: gone}
    out = dict(tables)
    out[links[0][0]] = deleted(tables[links[0][0]], gone, [links[0][1]])
    for parent, key, child, column in links:
        if parent not in lost:
            continue
        keys = lost[parent].select(F.col(key).alias(column)).distinct()
        dead = tables[child].join(keys, column, "left_semi")
        lost[child] = dead if child not in lost else lost[child].unionByName(dead).distinct()
        out[child] = out[child].join(keys, column, "left_anti")
    return out


def page(rows: DataFrame, order: str, offset: int, limit: int, most: int) -> DataFrame:
    """One page in the order of a key, with the total and whether more follows."""
    limit = min(max(1, limit), most)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return (
        rows.orderBy(order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # one row
        .withColumn("has_more", F.col("total") > offset + limit)
    )


def merged_lists(local: DataFrame, server: DataFrame, key: str, is_temporary: Column) -> DataFrame:
    """A local list brought up to date: values of the server win, temporary rows
    stay, others that the server lacks go, new ones come in."""
    values = [c for c in server.columns if c != key]
    mine = local.withColumn("__mine", is_temporary)
    theirs = server.select(key, F.lit(True).alias("__there"), *[F.col(c).alias(f"__{c}") for c in values])
    both = mine.join(theirs, key, "full").where("__there or __mine")
    return both.select(key, *[F.when(F.col("__there"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values])
