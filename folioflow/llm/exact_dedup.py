"""Exact deduplication by skew-safe combining.

Rows are combined three times, each time by digest *and* full content:

1. inside each input partition (Spark's map-side aggregation);
2. per (digest, salt): a text with millions of copies is spread over ``salts``
   tasks;
3. per digest over the salt winners, at most ``salts`` rows for each text.

Rows meet their winner by digest; those of hot digests are salted there too.

No step compares digests alone, so two texts that share a digest stay apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import SPACES, hot_join, keep, text_or_empty

SALTS = 16


def normalised(col: str = "text") -> Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(col), SPACES, " ")


def duplicate_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: its id, keep_id (smallest id among equal
    texts), group_size, kept, text_sha256.

    Nulls and empty texts are equal to each other. Rows whose id repeats are all
    returned; with a null id a row can't win unless the whole group has none.
    An empty table gives no rows; columns other than the id and the text are not
    looked at, whatever their names. ``digest`` may be replaced (tests use a
    weak one); results don't depend on it.
    """
    sha = lambda c: F.sha2(c, 256)
    # Names of our own, so that extra columns of the input can't clash.
    rows = docs.select(F.col(id_col).alias("__id"), normalised(text_col).alias("__t"))
    rows = rows.withColumn("__sha", sha(F.col("__t")))
    rows = rows.withColumn("__d", digest(F.col("__t")) if digest else F.unhex("__sha"))

    salted = (
        rows.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int"))
        .groupBy("__d", "__salt", "__t")
        .agg(F.min("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    )
    merged = (
        salted.repartition("__d")
        .groupBy("__d", "__t")
        .agg(F.min("__keep").alias("__keep"), F.sum("__n").alias("__n"))
    )
    # Still partitioned by digest: texts that share one are told apart here, and
    # only those carry their text on.
    winners = (
        merged.groupBy("__d")
        .agg(F.collect_list(F.struct("__keep", "__n", "__t")).alias("__v"))
        .select("__d", (F.size("__v") > 1).alias("__clash"), F.explode("__v").alias("__v"))
        .select(
            "__d",
            "__clash",
            F.col("__v.__keep").alias("__keep"),
            F.col("__v.__n").alias("__n"),
            F.when(F.col("__clash"), F.col("__v.__t")).alias("__w"),
        )
    )
    winners = keep(winners, "exact-winners")
    plain, clash = winners.where(~F.col("__clash")), winners.where("__clash")
    # A text with very many copies is a hot key of this join too.
    out = hot_join(rows.drop("__t"), plain, ["__d"], "__n").where("__n is not null").select("__id", "__keep", "__n", "__sha")
    if not clash.isEmpty():
        both = rows.join(clash, (rows["__d"] == clash["__d"]) & (rows["__t"] == clash["__w"]))
        out = out.unionByName(both.select("__id", "__keep", "__n", "__sha"))
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__keep").alias("keep_id"),
        F.col("__n").cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__keep")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not the first of their group, all columns as
    they were. Of rows of one id and one text, or without an id, one stays; rows of one
    id and other texts are judged each by its own. Texts of any length are compared whole."""
    key = lambda sha: F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.lit(":"), sha)
    won = duplicate_groups(docs, id_col, text_col).where("kept").select(key(F.col("text_sha256")).alias("__won"))
    # Whole rows go in one column, so no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("__doc"), key(F.sha2(normalised(text_col), 256)).alias("__key"))
    rows = rows.join(won, F.col("__key") == F.col("__won"), "left_semi")
    # Rows of a key are together already: the window moves none.
    nth = F.row_number().over(Window.partitionBy("__key").orderBy("__key"))
    return rows.withColumn("__nth", nth).where("__nth = 1").select("__doc.*")
