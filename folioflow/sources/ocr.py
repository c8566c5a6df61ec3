"""Documents of scanned pages: JSON sidecars and page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import sidecar_path
from .tables import keep

BLOCK = "struct<block_label: string, block_content: string, block_bbox: array<double>, block_id: int, block_order: int>"
PAGE = f"struct<page: int, data: struct<page_index: int, width: double, height: double, parsing_res_list: array<{BLOCK}>>>"
DOCUMENT = f"source string, pages array<{PAGE}>"


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, source, pages) of each *.ocr.json below ``path``; damaged files have
    null pages."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).option("pathGlobFilter", "*.ocr.json").option("recursiveFileLookup", True).json(path)
    return docs.select(F.col("_metadata.file_path").alias("path"), "source", "pages")


def with_sidecar(pdfs: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Rows of ``pdfs`` (path) whose sidecar is there."""
    return pdfs.join(sidecars.select(F.col("path").alias("__side")), sidecar_path(F.col("path")) == F.col("__side"), "left_semi")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """(folder, page, raw, parsed) of page_<n>.json files, numbered from 0 in the
    order of n; a file that is no JSON keeps its raw text and a null parse."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "page_*.json").text(path)
    named = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw"))
    n = F.regexp_extract("path", r"/page_(\d+)\.json$", 1)
    numbered = named.where(n != "").select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), n.cast("int").alias("n"), "raw")
    order = Window.partitionBy("folder").orderBy("n")
    return numbered.select("folder", (F.row_number().over(order) - 1).alias("page"), "raw", F.try_parse_json("raw").alias("parsed"))


# Keys under which a page's list of blocks may be nested.
WRAPPERS = ("res", "result", "parsing_result", "blocks", "children")
_OWN = "parsing_res_list"


def _found(b: Column) -> list[Column]:
    """A block's fields by whichever name they go: the first that is there and not null."""
    get = lambda name, kind: F.try_variant_get(b, f"$.{name}", kind)
    there = lambda name: get(name, "variant").isNotNull() & ~F.is_variant_null(get(name, "variant"))
    said = lambda name: F.when(there(name), F.coalesce(get(name, "string"), F.to_json(get(name, "variant"))))
    box = F.when(there("block_bbox"), get("block_bbox", "array<double>")).otherwise(get("bbox", "array<double>"))
    return [
        F.coalesce(said("block_label"), said("label"), F.lit("")).alias("label"),
        F.coalesce(*map(said, ("block_content", "text", "content", "rec_text")), F.lit("")).alias("content"),
        get("block_order", "bigint").alias("block_order"),
        *(F.when(F.size(box) >= 4, F.get(box, F.lit(i))).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))),
    ]


def blocks_of_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """Blocks as ``blocks`` gives them, from rows (keys, page, width, height, raw) of which
    raw is the JSON text of the page's data, at whatever depth they stand; none for a
    text that is no JSON.

    All pages are walked level by level, as variants. A block's place is the list of
    numbers on the way to it: an object's own list comes first, then what is under
    wrapper keys in their order; elements of lists in theirs.
    """
    spark, own = pages.sparkSession, [*keys, "page", "width", "height"]
    level = pages.select(*own, F.monotonically_increasing_id().alias("__row"), F.array().cast("array<int>").alias("__way"), F.lit(False).alias("__list"), F.try_parse_json("raw").alias("__v"))
    level, found = keep(level.where("__v is not null")), None
    while True:
        each = level.lateralJoin(spark.tvf.variant_explode(F.col("__v").outer()))
        rank = F.when(F.col("key").isNull(), F.col("pos")).when(F.col("key") == _OWN, 0).otherwise(F.nullif(F.array_position(F.array(*map(F.lit, WRAPPERS)), F.col("key")), F.lit(0)))
        each = each.withColumn("__way", F.concat("__way", F.array(rank.cast("int")))).where(F.get("__way", F.size("__way") - 1).isNotNull())
        here = each.where(F.col("__list") & F.col("key").isNull() & F.schema_of_variant("value").startswith("OBJECT"))
        here = here.select(*own, "__row", "__way", *_found(F.col("value")))
        found = here if found is None else found.unionByName(here)
        deeper = each.where("not __list").select(*own, "__row", "__way", (F.col("key") == _OWN).alias("__list"), F.col("value").alias("__v"))
        level = keep(deeper.withColumn("__list", F.coalesce("__list", F.lit(False))))
        if level.isEmpty():
            break
    order = Window.partitionBy("__row").orderBy("__way")
    return found.withColumn("nth", F.row_number().over(order) - 1).select(*own, "nth", "label", "content", "block_order", "x0", "y0", "x1", "y1")


def blocks(documents: DataFrame, *keys: str) -> DataFrame:
    """One row for each block: keys, page, height, width, nth on its page, label,
    content and box. Documents without pages have none."""
    pages = documents.select(*keys, F.posexplode("pages").alias("__p", "p"))
    rows = pages.select(
        *keys,
        F.coalesce("p.data.page_index", "p.page", F.lit(0)).alias("page"),
        F.coalesce("p.data.width", F.lit(1.0)).alias("width"),
        F.coalesce("p.data.height", F.lit(1.0)).alias("height"),
        F.posexplode("p.data.parsing_res_list").alias("nth", "b"),
    )
    box = F.col("b.block_bbox")
    return rows.select(
        *keys, "page", "width", "height", "nth",
        F.col("b.block_label").alias("label"), F.col("b.block_content").alias("content"), F.col("b.block_order").alias("block_order"),
        *(F.get(box, F.lit(i)).alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))),
    )
