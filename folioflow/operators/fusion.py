"""Results of several searches made one, citations pruned, chats cut in sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cited_numbers, closed_thinking, is_reputable, renumbered, renumbering


def fused(results: DataFrame, most: int, *by: str) -> DataFrame:
    """results (query_idx, rank, title, url, content) without later rows of a URL that
    came before, the first ``most`` of them, numbered from 1 in nth; with ``by``, those
    of each request."""
    w = Window.partitionBy(*by, "url").orderBy("query_idx", "rank")
    first = results.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    if by:
        return _nth(first, by, "query_idx", "rank").where(F.col("nth") <= most)
    return numbered(first.orderBy("query_idx", "rank").limit(most), "query_idx", "rank")


def numbered(rows: DataFrame, *order) -> DataFrame:
    """A list that a limit keeps short, numbered from 1 in nth."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def _nth(rows: DataFrame, by: tuple, *order) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def reputable_first(rows: DataFrame, *by: str) -> DataFrame:
    """nth anew: reputable publishers first, both parts in their old order."""
    if by:
        return _nth(rows.withColumnRenamed("nth", "__old"), by, F.desc(is_reputable(F.col("url"))), "__old").drop("__old")
    return numbered(rows.withColumnRenamed("nth", "__old"), F.desc(is_reputable(F.col("url"))), "__old").drop("__old")


def judged(rows: DataFrame, relevant: DataFrame, fallback: int = 3, most: int = 15, by: tuple = ()) -> DataFrame:
    """rows (nth, url, ...) that the judge named (nth), or the first ``fallback`` if it
    named none; at most ``most`` of them, then reputable ones first. With ``by``, those
    of each request, named by (by, nth)."""
    if by:
        good = rows.join(relevant.select(*by, "nth"), [*by, "nth"], "left_semi")
        first = rows.where(F.col("nth") <= fallback).join(good.select(*by).distinct(), list(by), "left_anti")
        some = _nth(good.unionByName(first).withColumnRenamed("nth", "__of"), by, "__of").where(F.col("nth") <= most).drop("__of")
        return reputable_first(some, *by)
    good = rows.join(relevant.select("nth"), "nth", "left_semi")
    none = good.agg(F.count(F.lit(1)).alias("__good"))
    first = rows.orderBy("nth").limit(fallback).crossJoin(F.broadcast(none)).where("__good = 0").drop("__good")  # one row
    return reputable_first(good.unionByName(first).orderBy("nth").limit(most))


def prompt(rows: DataFrame, label: str = "Content", *keys: str) -> DataFrame:
    """The sources (nth, title, url, content) as one text for a model."""
    one = F.concat(F.lit("Source ["), F.col("nth"), F.lit("]:\nTitle: "), F.col("title"), F.lit("\nURL: "), F.col("url"), F.lit(f"\n{label}: "), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("nth", one.alias("s"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), "\n\n").alias("prompt"))


def pruned(answers: DataFrame, text: str = "answer", sources: str = "sources") -> DataFrame:
    """answers with ``sources`` cut to those that the text cites and the text's
    numbers changed to match; as they are if it cites none."""
    rows = answers.withColumn("cited", cited_numbers(F.col(text), F.size(sources)))
    some = F.size("cited") > 0
    kept = F.transform("cited", lambda n: F.element_at(sources, n.cast("int")))
    return rows.withColumn(text, F.when(some, renumbered(F.col(text), renumbering(F.col("cited")))).otherwise(F.col(text))).withColumn(
        sources, F.when(some, kept).otherwise(F.col(sources))
    )


def chat_sections(messages: DataFrame, chat: str = "chat_id") -> DataFrame:
    """messages (chat, seq, role, content) as one row for each user message: its
    number, the first answer before the next user message, whether its thinking
    ended, and the answer for display."""
    w = Window.partitionBy(chat).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("section", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w)).where("section > 0")
    is_user, is_answer = F.col("role") == "user", F.col("role") == "assistant"
    out = rows.groupBy(chat, "section").agg(
        F.min_by(F.when(is_user, F.col("content")), F.when(is_user, F.col("seq"))).alias("question"),
        F.min_by(F.when(is_answer, F.col("content")), F.when(is_answer, F.col("seq"))).alias("answer"),
        F.count_if(F.col("role") == "source").alias("source_messages"),
    )
    shown = F.coalesce(closed_thinking(F.col("answer")), F.lit(""))
    return out.withColumn("thinking_ended", F.coalesce(F.col("answer").contains("</think>"), F.lit(False))).withColumn("shown", shown)


def linked_citations(answers: DataFrame) -> DataFrame:
    """answers (answer, urls) with ``linked``: each [n, m] that no ! precedes as links
    to the URLs; numbers without one go, other marks stay in brackets."""
    mark = r"(?<!!)\[([^\]]+)\]"

    def one(part):
        sign, digits = F.regexp_extract(part, r"^([+-]?)0*(\d+)", 1), F.regexp_extract(part, r"^([+-]?)0*(\d+)", 2)
        # Numbers of more digits than a list can have places are as good as the largest.
        size = F.when(F.length(digits) > 9, 2_000_000_000).when(digits != "", digits.try_cast("int"))
        n = F.when(sign == "-", -size).otherwise(size)
        url = F.get(F.col("urls"), n - 1)
        link = F.concat(F.lit('<citation href="'), url, F.lit('">'), part, F.lit("</citation>"))
        return F.when(n.isNull() | (n <= 0), F.concat(F.lit("["), part, F.lit("]"))).when(url.isNotNull(), link).otherwise("")

    made = F.transform(
        F.regexp_extract_all("answer", F.lit(mark), F.lit(1)), lambda m: F.array_join(F.transform(F.split(m, ","), lambda p: one(F.trim(p))), "")
    )
    ends = F.concat(made, F.array(F.lit("")))
    return answers.withColumn("linked", F.array_join(F.zip_with(F.split("answer", mark, -1), ends, lambda g, m: F.concat(g, m)), ""))
