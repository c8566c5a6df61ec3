"""Folder trees as sources: page files of documents, and changes of a watched library.
The trees are written from ``pages`` by tasks, into the shared folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sidecar_path
from ..sources import ocr
from ..sources.page_tree import PageTree
from ..sources.tables import shared_folder
from ..sources.watch import WatchSource
from .registry import query


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that tasks and the driver can open."""
    path = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    return f"{path}/{name}-{uuid.uuid4().hex}"


def _written(files: DataFrame, root: str) -> None:
    """Writes the files (path, text) below ``root``; those whose text is null go."""

    def run(batches):
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                at = os.path.join(root, path)
                if text is None:
                    if os.path.exists(at):
                        os.remove(at)
                    continue
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{at}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(part, at)  # a task that runs again writes the same file
        yield from ()

    os.makedirs(root, exist_ok=True)
    files.select("path", "text").mapInArrow(run, "done int").count()


@query("s7_page_tree", """
SELECT (page_id // 10)::VARCHAR AS document, (row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id % 10) - 1)::INT AS page, 'page_' || (page_id % 10) || '.json' AS file,
  page_id % 7 > 0 AS is_json, CASE WHEN page_id % 7 > 0 THEN url END AS url FROM pages""")  # fmt: skip
def _(t):
    """Ten pages a document; a seventh of the files is damaged and keeps its raw text."""
    pages = t("pages").select("page_id", "url")
    spark, root = pages.sparkSession, _folder(pages.sparkSession, "pages")
    said = F.to_json(F.struct("url"))
    name = F.concat(F.expr("string(page_id div 10)"), F.lit("/page_"), (F.col("page_id") % 10).cast("string"), F.lit(".json"))
    _written(pages.select(name.alias("path"), F.when(F.col("page_id") % 7 > 0, said).otherwise(F.concat(F.lit("{"), said)).alias("text")), root)
    spark.dataSource.register(PageTree)
    rows = spark.read.format("page_tree").option("path", root).load()
    return rows.select("document", "page", "file", "is_json", F.when(F.col("is_json"), F.get_json_object("raw", "$.url")).alias("url"))


@query("s5_sidecars", """
SELECT page_id::VARCHAR AS pdf, page_id % 2 = 0 AS has_sidecar, CASE WHEN page_id % 2 = 0 AND page_id % 3 > 0 THEN url END AS source FROM pages""")  # fmt: skip
def _(t):
    """A PDF for each page, half of them with a sidecar, a third of these damaged."""
    pages = t("pages").select("page_id", "url")
    spark, root = pages.sparkSession, _folder(pages.sparkSession, "papers")
    said = F.to_json(F.struct(F.col("url").alias("source"), F.array().alias("pages")))
    name = lambda end: F.concat(F.col("page_id").cast("string"), F.lit(end)).alias("path")
    side = pages.where("page_id % 2 = 0").select(name(".ocr.json"), F.when(F.col("page_id") % 3 > 0, said).otherwise("{broken").alias("text"))
    _written(pages.select(name(".PDF"), F.lit("pdf").alias("text")).unionByName(side), root)
    pdfs = spark.read.format("binaryFile").option("pathGlobFilter", "*.PDF").load(root).select("path")
    sidecars = ocr.read_sidecars(spark, root)
    known = ocr.with_sidecar(pdfs, sidecars).select(F.col("path").alias("__path"), F.lit(True).alias("has_sidecar"))
    both = pdfs.select(F.col("path").alias("__path")).join(known, "__path", "left").withColumn("__side", sidecar_path(F.col("__path")))
    both = both.join(sidecars.select(F.col("path").alias("__side"), "source"), "__side", "left")
    return both.select(F.regexp_extract("__path", r"([0-9]+)\.PDF$", 1).alias("pdf"), F.coalesce("has_sidecar", F.lit(False)).alias("has_sidecar"), "source")


@query("s16_watched_tree", """
SELECT 'sub/' || page_id || '.md' AS path, CASE page_id % 5 WHEN 1 THEN 'change' WHEN 2 THEN 'unlink' WHEN 3 THEN 'add' END AS type, CASE WHEN page_id % 5 <> 2 THEN length('now ' || page_id) END AS size
FROM pages WHERE page_id % 5 IN (1, 2, 3)""")  # fmt: skip
def _(t):
    """A tree of a file for each page, of which some are changed, removed and added
    between two looks of a stream; files of kinds that aren't watched are passed over."""
    pages = t("pages").select("page_id")
    spark = pages.sparkSession
    root, journal, out = (_folder(spark, n) for n in ("library", "journal", "events"))
    n = F.col("page_id") % 5
    at = lambda end: F.concat(F.lit("sub/"), F.col("page_id").cast("string"), F.lit(end)).alias("path")
    _written(pages.where(n != 3).select(at(".md"), F.lit("before, and longer").alias("text")), root)
    spark.dataSource.register(WatchSource)

    def look():
        events = spark.readStream.format("folder_watch").option("path", root).option("journal", journal).load()
        run = events.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        return spark.read.schema(events.schema).parquet(out)

    look()
    now = F.when(n != 2, F.concat(F.lit("now "), F.col("page_id").cast("string"))).alias("text")
    _written(pages.where(n.isin(1, 2, 3)).select(at(".md"), now).unionByName(pages.where(n == 0).select(at(".exe"), F.lit("x").alias("text"))), root)
    return look().select("path", "type", "size")
