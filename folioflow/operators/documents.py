"""From blocks of scanned pages to chunks, sections and Markdown.

Blocks are rows (keys, page, height, width, nth, label, content, x0..y1) as
sources.ocr.blocks makes them. What a scan in order would carry from block to
block is expressed by windows over a document's blocks.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_caption, is_first_caption, is_methods_heading, is_numbered_caption, is_panel, is_references_heading, is_uninformative, trimmed
from ..functions.values import js_round, line_chunks
from . import boxes
from .references import entries

# Block kinds that become chunks.
CHUNK_LABELS = ("paragraph_title", "abstract", "figure_title", "table", "display_formula", "text")


def chunks(blocks: DataFrame, key: str) -> DataFrame:
    """key, block, section_type, chunk_index, content of the informative chunks.

    A heading goes with the next text block, and only with that: of the headings and
    texts before a block the last one tells, and a text tells that there is none.
    """
    rows = blocks.where(F.col("label").isin(*CHUNK_LABELS))
    before = Window.partitionBy(key).orderBy("page", "nth").rowsBetween(Window.unboundedPreceding, -1)
    told = F.when(F.col("label") == "paragraph_title", F.col("content")).when(F.col("label") == "text", F.lit(""))
    rows = rows.withColumn("__heading", F.last(told, ignorenulls=True).over(before)).where("label <> 'paragraph_title'")
    text = F.when((F.col("label") == "text") & (F.coalesce("__heading", F.lit("")) != ""), F.concat("__heading", F.lit("\n"), "content"))
    kind = F.when(F.col("label") == "text", F.lit("paragraph_title")).otherwise(F.col("label"))
    parts = rows.select(key, "page", "nth", kind.alias("section_type"), F.posexplode(line_chunks(F.coalesce(text, "content"))).alias("chunk_index", "content"))
    return parts.where(~is_uninformative(F.col("content")))


def repeated_edges(blocks: DataFrame, key: str, edge: float = 0.12, most: int = 120, pages: int = 3) -> DataFrame:
    """(key, noise): short texts near the top or bottom of at least three pages."""
    text = trimmed(F.col("content"))
    at_edge = (F.col("y0") <= edge * F.col("height")) | (F.col("y1") >= (1 - edge) * F.col("height"))
    rows = blocks.where((F.length(text) > 0) & (F.length(text) <= most) & at_edge)
    return (
        rows.select(key, "page", _noise_key(F.col("content")).alias("noise")).groupBy(key, "noise")
        .agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= pages).select(key, "noise")
    )


def _noise_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(c)), r"\s+", " ")


def area(x0, y0, x1, y1) -> Column:
    return F.greatest(F.lit(0.0), x1 - x0) * F.greatest(F.lit(0.0), y1 - y0)


def _visual(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("label").isin("image", "chart") & F.col("y1").isNotNull())


def _covered(blocks: DataFrame, key: str, share: float) -> Column:
    """Whether a figure on a block's page covers more than ``share`` of it; the few
    figures of a page come to its blocks through a window."""
    visual = F.col("label").isin("image", "chart") & F.col("y1").isNotNull()
    figures = F.collect_list(F.when(visual, F.struct("x0", "y0", "x1", "y1"))).over(Window.partitionBy(key, "page"))
    own = area(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))

    def over(f):
        wide = F.greatest(F.lit(0.0), F.least("x1", f["x1"]) - F.greatest("x0", f["x0"]))
        return wide * F.greatest(F.lit(0.0), F.least("y1", f["y1"]) - F.greatest("y0", f["y0"])) > share * own

    return F.coalesce((own > 0) & F.exists(figures, over), F.lit(False))


def outside_figures(blocks: DataFrame, key: str, share: float = 0.3) -> DataFrame:
    """Blocks of which no figure on the page covers more than ``share``."""
    return blocks.withColumn("__covered", _covered(blocks, key, share)).where("not __covered").drop("__covered")


def rendered(label: Column, content: Column) -> Column:
    """Markdown of a block, null for kinds that are not shown."""
    t = trimmed(content)
    around = lambda a, b="": F.concat(F.lit("\n" + a), t, F.lit(b + "\n"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", None)
        .when(label == "paragraph_title", around("## "))
        .when(label == "doc_title", around("# "))
        .when(label == "abstract", around("*", "*"))
        .when(label == "text", around(""))
        .when((label == "display_formula") & t.startswith("$$"), around(""))
        .when(label == "display_formula", around("$$", "$$"))
        .when(label == "table", F.concat(F.lit('\n<div class="paper-table">\n\n'), t, F.lit("\n\n</div>\n")))
    )


def _joined(rows: DataFrame, key: str, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("page", "nth", "md")))
    return rows.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["md"]), "\n").alias(name))


def _clean(blocks: DataFrame, key: str, edge: float = 0.12, most: int = 120, pages: int = 3) -> DataFrame:
    """Blocks outside figures whose text is no repeated header or footer. Blocks go to
    their document once; figures, noise and what follows are windows over it."""
    text = trimmed(F.col("content"))
    at_edge = (F.col("y0") <= edge * F.col("height")) | (F.col("y1") >= (1 - edge) * F.col("height"))
    shown = F.when((F.length(text) > 0) & (F.length(text) <= most) & at_edge, F.col("page"))
    rows = blocks.repartition(key).withColumn("noise", _noise_key(F.col("content")))
    repeated = F.size(F.collect_set(shown).over(Window.partitionBy(key, "noise"))) >= pages
    rows = rows.withColumn("__covered", _covered(rows, key, 0.3)).withColumn("__repeated", F.col("noise").isNotNull() & repeated)
    return rows.where("not __covered and not __repeated").drop("__covered", "__repeated")


def markdown(blocks: DataFrame, key: str) -> DataFrame:
    """(key, markdown) of all blocks that are shown, in order."""
    rows = _clean(blocks, key).withColumn("md", rendered(F.col("label"), F.col("content")))
    return _joined(rows.where("md is not null"), key, "markdown")


def sections(blocks: DataFrame, key: str) -> DataFrame:
    """(key, main_text, methods, figure_captions) by the last heading before a block.

    A block is in the references if the last heading that is references or methods
    was references; in the methods if the last heading of any kind was methods.
    """
    rows = _clean(blocks, key)
    text = trimmed(F.col("content"))
    is_heading = (F.col("label") == "paragraph_title") & (F.length(text) > 0)
    mark = F.when(is_heading & is_references_heading(text), "R").when(is_heading & is_methods_heading(text), "M").when(is_heading, "O")
    order = Window.partitionBy(key).orderBy("page", "nth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__mark", mark)
    last = lambda c: F.last(c, ignorenulls=True).over(order)
    in_refs = F.coalesce(last(F.when(F.col("__mark") != "O", F.col("__mark"))) == "R", F.lit(False))
    in_methods = F.coalesce(last(F.col("__mark")) == "M", F.lit(False))
    rows = rows.withColumn("__refs", in_refs).withColumn("__methods", in_methods).where("not __refs and label <> 'reference_content'")
    has = F.length(text) > 0
    caption = F.when((F.col("label") == "figure_title") & has, F.concat(F.lit("\n*"), text, F.lit("*\n"))).when(
        has & (is_caption(text) | is_panel(text)), F.concat(F.lit("\n"), text, F.lit("\n"))
    )
    rows = rows.withColumn("__caption", caption).withColumn("md", F.coalesce("__caption", rendered(F.col("label"), F.col("content")))).where("md is not null")
    part = F.when(F.col("__caption").isNotNull(), "figure_captions").when(F.col("__methods"), "methods").otherwise("main_text")
    out = rows.withColumn("part", part).groupBy(key).pivot("part", ["main_text", "methods", "figure_captions"])
    return out.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "nth", "md"))), lambda p: p["md"]), "\n")).select(
        key, F.coalesce("main_text", F.lit("")).alias("main_text"), F.nullif("methods", F.lit("")).alias("methods"), F.coalesce("figure_captions", F.lit("")).alias("figure_captions")
    )


def figure_clusters(blocks: DataFrame, key: str, gap: float = boxes.GAP) -> DataFrame:
    """(key, page, cluster, x0, y0, x1, y1, covered): groups of images and charts on
    a page whose grown boxes meet, or that stand close above one another."""
    page = Window.partitionBy(key, "page")
    margin = F.least(F.lit(30.0), F.coalesce(F.first("height").over(page.orderBy("nth")) * 0.015, F.lit(30.0)))
    rows = _visual(blocks).select(key, "page", "x0", "y0", "x1", "y1", margin.alias("margin"), (F.row_number().over(page.orderBy("nth")) - 1).cast("long").alias("i"))
    return boxes.grouped(rows, [key, "page"], gap).groupBy(key, "page", "cluster").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.sum((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("covered"),
    )


def figure_regions(blocks: DataFrame, key: str) -> DataFrame:
    """Clusters of at least a hundredth of the page, each with the first caption that
    starts within 15 % of the page's height of its lower edge."""
    size = blocks.groupBy(key, "page").agg(F.max("height").alias("height"), F.max("width").alias("width"))
    regions = figure_clusters(blocks, key).join(size.hint("merge"), [key, "page"]).where("covered >= 0.01 * width * height")
    captions = blocks.where((F.col("label") == "figure_title") & (F.length(trimmed(F.col("content"))) > 0) & F.col("y1").isNotNull())
    captions = captions.select(key, "page", F.col("nth").alias("__nth"), F.col("y0").alias("__y"), trimmed(F.col("content")).alias("__text"))
    near = regions.join(captions.hint("merge"), [key, "page"], "left")
    fits = F.abs(F.col("__y") - F.col("y1")) < 0.15 * F.col("height")
    out = near.groupBy(key, "page", "cluster", "x0", "y0", "x1", "y1", "covered").agg(F.min_by(F.when(fits, F.col("__text")), F.when(fits, F.col("__nth"))).alias("caption"))
    return out.withColumn("doc_order", F.col("page") * 10000 + js_round(F.col("y0"))).withColumn("caption", F.coalesce("caption", F.lit("")))


def all_sections(blocks: DataFrame, key: str, reference_blocks: DataFrame) -> DataFrame:
    """``sections`` with references, the entries parsed from (key, nth, content) as
    numbered lines, and figures, the regions as structs in their order."""
    entry = F.concat(F.col("ref_number").cast("string"), F.lit(". "), "text")
    refs = entries(reference_blocks.withColumnRenamed("nth", "block"), key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("nth", entry.alias("line")))).alias("__r"))
    refs = refs.select(key, F.array_join(F.transform("__r", lambda r: r["line"]), "\n").alias("references"))
    figures = figure_regions(blocks, key).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("doc_order", "page", "caption"))).alias("figures"))
    out = blocks.select(key).distinct().join(sections(blocks, key), key, "left").join(refs, key, "left").join(figures, key, "left")
    return out.select(
        key, F.coalesce("main_text", F.lit("")).alias("main_text"), "methods", F.coalesce("references", F.lit("")).alias("references"),
        F.coalesce("figure_captions", F.lit("")).alias("figure_captions"), F.coalesce("figures", F.array().cast("array<struct<doc_order: bigint, page: int, caption: string>>")).alias("figures"),
    )


def first_figures(blocks: DataFrame, key: str, band: float = 0.8) -> DataFrame:
    """(key, page, x0, y0, x1, y1) of each document's first figure.

    Its caption is the first that says Figure 1, else the first of any figure. Images
    and charts that may belong to it are those above it on the page, down from the
    caption before and within ``band`` of the page; without any, those below it; else
    those of the page before. The largest group of them by area, of equal ones the
    first, is the figure.
    """
    text = trimmed(F.col("content"))
    captions = blocks.where((F.col("label") == "figure_title") & F.col("y1").isNotNull() & is_numbered_caption(text))
    at = F.struct(~is_first_caption(text), "page", "nth")
    chosen = captions.groupBy(key).agg(F.min_by(F.struct("page", "y0", "height"), at).alias("c")).select(
        key, F.col("c.page").alias("__page"), F.col("c.y0").alias("__y"), F.col("c.height").alias("__height")
    )
    above = captions.join(chosen, key).where((F.col("page") == F.col("__page")) & (F.col("y1") < F.col("__y"))).groupBy(key).agg(F.max("y1").alias("__above"))
    chosen = chosen.join(above, key, "left").withColumn("__above", F.greatest(F.lit(0.0), F.coalesce("__above", F.lit(0.0))))
    same = F.col("page") == F.col("__page")
    tier = (
        F.when(same & (F.col("y1") <= F.col("__y")) & (F.col("y0") >= F.col("__y") - band * F.col("__height")) & (F.col("y0") >= F.col("__above")), 1)
        .when(same & (F.col("y0") >= F.col("__y")), 2)
        .when(F.col("page") == F.col("__page") - 1, 3)
    )
    near = _visual(blocks).join(chosen, key).withColumn("__tier", tier).where("__tier is not null")
    near = near.withColumn("__best", F.min("__tier").over(Window.partitionBy(key))).where("__tier = __best").withColumn("height", F.col("__height"))
    groups = figure_clusters(near, key).join(chosen.select(key, "__page").hint("merge"), key)
    best = groups.groupBy(key, "__page").agg(F.max_by(F.struct("x0", "y0", "x1", "y1"), F.struct("covered", -F.col("cluster"))).alias("b"))
    return best.select(key, F.col("__page").alias("page"), "b.*")


def _natural_end(text: str, start: int, target: int, back: int) -> int:
    """Where a chunk ends: after the last paragraph, sentence, line or word that ends in
    the last ``back`` characters before the target, in this order of preference."""
    tail = text[max(start, target - back) : target]
    base = target - len(tail)
    for pattern in (r"\n\n", r"[.!?]\s", r"\n", " "):
        ends = [m.end() for m in re.finditer(pattern, tail)]
        if ends:
            return base + ends[-1]
    return target


def text_chunks(texts: DataFrame, key: str, text_col: str = "text", tokens: int = 1000, overlap: int = 100) -> DataFrame:
    """(key, nth, start, end, tokens, content): texts in chunks of at most so many tokens,
    of four characters each, that end at natural boundaries and overlap. As the
    documentation describes it, no code of it exists. Null and empty texts have none.
    """
    most, over = 4 * tokens, 4 * overlap
    kind = "array<struct<start: long, end: long, tokens: long, content: string>>"

    def of(text):
        out, start = [], 0
        while text and start < len(text):
            end = min(start + most, len(text))
            if end < len(text):
                end = _natural_end(text, start, end, most // 5)
            out.append({"start": start, "end": end, "tokens": -(-(end - start) // 4), "content": text[start:end]})
            if end >= len(text):
                break
            start = max(start + 1, end - over)
            gap = re.search(r"[ \n]", text[start : start + 50])
            start += gap.end() if gap and not text[start - 1].isspace() else 0
        return out

    @F.pandas_udf(kind)
    def chunked(column: pd.Series) -> pd.Series:
        return column.map(of)

    return texts.select(key, F.posexplode(chunked(F.col(text_col))).alias("nth", "c")).select(key, "nth", "c.*")


def figure_window(blocks: DataFrame, key: str) -> DataFrame:
    """For each caption of a figure, the lower edge of the nearest caption above it on
    the page (0 without one): where its figure may begin."""
    captions = blocks.where((F.col("label") == "figure_title") & F.col("y1").isNotNull())
    above = captions.select(key, "page", F.col("y1").alias("__end"))
    out = captions.select(key, "page", "nth", "y0").join(above, [key, "page"]).groupBy(key, "page", "nth", "y0")
    return out.agg(F.coalesce(F.max(F.when(F.col("__end") < F.col("y0"), F.col("__end"))), F.lit(0.0)).alias("from_y"))


def context_of(sections: DataFrame, key: str, wanted: DataFrame, request: str = "request") -> DataFrame:
    """(request, context) of ``wanted`` (request, key, title): its documents that have
    a main text, each under its title and with its figures' captions, in order of their
    keys with a rule between them. Requests without such a document go.
    """
    has = F.coalesce("figure_captions", F.lit("")) != ""
    head = F.concat(F.lit("## [Paper "), F.col(key).cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit("\n\n"), "main_text")
    part = F.concat(head, F.when(has, F.concat(F.lit("\n\n### Figure Captions\n\n"), "figure_captions")).otherwise(""))
    rows = sections.where(F.col("main_text") != "").join(wanted.select(request, key, "title").dropDuplicates([request, key]), key)
    parts = F.array_sort(F.collect_list(F.struct(key, part.alias("s"))))
    return rows.groupBy(request).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n\n---\n\n").alias("context"))
