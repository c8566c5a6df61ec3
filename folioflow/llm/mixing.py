"""Mixing sources to target weights by Sainte-Laguë apportionment.

A mix is dealt in blocks of equally many words. Sources get blocks by the highest
quotients target / (2 k + 1), then each source deals its blocks to its shards by
size in the same way. A shard lays its documents on a line in a seeded order and
takes its quota of blocks from the line's start, after as many whole passes as
the quota holds. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import SPACES, WORDS, keep, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 16
SHARD_DOCS = 4096
SEED = "mix-1"


def seeded(col: str, seed: str) -> Column:
    """A number that depends on the seed and the id alone, below 2**60."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col(col).cast("string"))), 1, 15)
    return F.conv(hexed, 16, 10).cast("long")


def sainte_lague(rows: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """``rows`` with ``quota``: the seats each row of a group gets when the group's
    ``seats`` go one by one to the highest votes / (2 k + 1), ties to the smaller key.

    A row's seats differ from votes / divisor by a bounded number, so only the
    quotients around that are made: some nine for each row on average.
    """
    w = Window.partitionBy(*group)
    near = (
        rows.withColumn("__sum", F.sum(votes).over(w))
        .withColumn("__rows", F.count(F.lit(1)).over(w))
        .withColumn("__share", F.when(F.col("__sum") > 0, F.col(votes) / F.col("__sum")).otherwise(0.0))
        .withColumn("__base", F.floor(F.col("__share") * F.col(seats) + 0.5))
        .withColumn("__slack", F.ceil(2 * F.col("__share") * F.col("__rows")) + 2)
        .withColumn("__low", F.greatest(F.lit(0), F.col("__base") - F.col("__slack")))
        .withColumn("__left", F.col(seats) - F.sum("__low").over(w))
    )
    rank = Window.partitionBy(*group).orderBy(F.desc("__quotient"), key)
    won = (
        near.where(F.col(votes) > 0)
        .select(*group, key, votes, "__left", F.explode(F.sequence("__low", F.col("__base") + F.col("__slack"))).alias("__k"))
        .withColumn("__quotient", F.col(votes) / (2 * F.col("__k") + 1))
        .withColumn("__rank", F.row_number().over(rank))
        .where("__rank <= __left")
        .groupBy(*group, key)
        .agg(F.count(F.lit(1)).alias("__more"))
    )
    return near.join(won, [*group, key], "left").select(
        *rows.columns, (F.col("__low") + F.coalesce("__more", F.lit(0))).cast("long").alias("quota")
    )


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources`` (source, source_size) with rank, weight and target: ``share`` of
    all sizes by weight, no target above ``most`` times its source's size, the
    excess shared again among the others.

    Filled as water is: sources in the order of limit / weight are full as long as
    the level that the rest would reach lies above theirs.
    """
    # The few rows of a table of sources, one each, go to one task.
    ranked = sources.withColumn(
        "source_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    )
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), F.col("source_rank") % len(weights) + 1)
    order = Window.partitionBy(F.lit(0)).orderBy("__full", "source_rank")
    every = Window.partitionBy(F.lit(0))
    filled = (
        ranked.withColumn("weight", weight)
        .withColumn("__limit", most * F.col("source_size").cast("double"))
        .withColumn("__full", F.col("__limit") / F.col("weight"))
        .withColumn("__all", share * F.sum("source_size").over(every))
        .withColumn("__before", F.coalesce(F.sum("__limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("__open", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("__level", (F.col("__all") - F.col("__before")) / F.col("__open"))
        .withColumn("__level", F.max(F.when(F.col("__level") <= F.col("__full"), F.col("__level"))).over(every))
    )
    return filled.withColumn(
        "target", F.least("__limit", F.coalesce(F.col("__level"), F.col("__full")) * F.col("weight"))
    ).select("source", "source_rank", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = SEED,
    block: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row for each row of ``docs``: its id, size in words, source_size, target
    (its source's) and taken, the words that the mix takes of it (at most twice its
    size).

    A null source is a source of its own, last in order; null and empty texts have
    size 0 and give nothing. A source's taken words differ from its target by about
    a block. Rows of one id, or of none, are rows of their own, in the order of their
    sizes; an empty table gives no rows. Other columns are not looked at; texts of any length count whole.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"))
    dealt = _dealt(keep(sizes, "mix-sizes"), seed, block, shard_docs)
    return dealt.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", "taken")


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORDS)).cast("long")


def _dealt(sizes: DataFrame, seed: str, block: int, shard_docs: int) -> DataFrame:
    """``sizes`` (doc_id, source, size, further columns, which order rows that are equal
    in these) with source_size, target and taken."""
    more = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    by_source = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    counts = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("__docs"))
    sources = (
        by_source.join(counts.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("shards", F.ceil(F.col("__docs") / shard_docs))
        .withColumn("__all", F.lit(0))
        .withColumn("__blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    )
    dealt = keep(
        sainte_lague(sources, ["__all"], "source_rank", "target", "__blocks").select(
            "source", "source_rank", "source_size", "target", "shards", F.col("quota").alias("source_blocks")
        ),
        "mix-sources",
    )
    placed = (
        sizes.join(dealt.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")))
        .withColumn("seeded", seeded("doc_id", seed))
        .withColumn("shard", F.coalesce(F.pmod(F.col("seeded"), F.col("shards")), F.lit(0)))
    )
    by_shard = sainte_lague(
        placed.groupBy("source_rank", "shard", "source_blocks").agg(F.sum("size").alias("shard_size")),
        ["source_rank"],
        "shard",
        "shard_size",
        "source_blocks",
    ).select("source_rank", "shard", "shard_size", F.least(F.col("quota") * block, MOST * F.col("shard_size")).alias("words"))
    line = Window.partitionBy("source_rank", "shard").orderBy("seeded", "doc_id", "size", *more)
    passes = F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0)
    return (
        placed.withColumn("__before", F.coalesce(F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .join(by_shard, ["source_rank", "shard"])
        .withColumn("__passes", passes)
        .withColumn("__rest", F.col("words") - F.col("__passes") * F.col("shard_size") - F.col("__before"))
        .select(
            "doc_id",
            "size",
            *more,
            "source_size",
            "target",
            (F.col("__passes") * F.col("size") + F.greatest(F.lit(0), F.least("size", "__rest"))).cast("long").alias("taken"),
        )
    )


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as many times as its taken words hold it
    whole, then its first words for the rest; columns as in ``docs``, with n_chars
    counted anew. Documents of which nothing is taken don't appear. Each row has a
    share of its own, also where its id is null or occurs again.
    """
    # Rows meet their shares by all that the mix looks at; of rows that are equal in
    # it, the first gets the first share, and so on.
    says = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    row = F.sha2(F.concat_ws("\0", says("doc_id"), says("source"), says("text")), 256)
    sizes = keep(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count("text").alias("size"), row.alias("__row")), "mix-sizes")
    shares = _dealt(sizes, seed, BLOCK_WORDS, SHARD_DOCS).where("taken > 0")
    shares = shares.groupBy(F.col("__row").alias("__of")).agg(F.first("size").alias("__size"), F.sort_array(F.collect_list("taken"), asc=False).alias("__shares"))
    nth = F.row_number().over(Window.partitionBy("__row").orderBy(F.lit(0)))
    # Whole rows go in one column, so no name of theirs can clash.
    numbered = docs.select(F.struct("*").alias("__doc"), row.alias("__row")).withColumn("__nth", nth)
    mixed = numbered.join(shares, F.col("__row") == F.col("__of")).withColumn("__taken", F.get("__shares", F.col("__nth") - 1)).where("__taken > 0")
    copies = F.transform(
        F.sequence(F.lit(0), F.expr("int((__taken - 1) div __size)")),
        lambda i: F.least(F.col("__size"), F.col("__taken") - i * F.col("__size")),
    )
    # Each word with the white space before it; the first n of them are a prefix.
    whole = F.col("__doc").getField("text")
    words = F.regexp_extract_all(F.coalesce(whole.cast("string"), F.lit("")), F.lit(SPACES.replace("+", "*") + WORDS), F.lit(0))
    part = F.array_join(F.slice(words, F.lit(1), F.col("__words").cast("int")), "")
    mixed = mixed.withColumn("__words", F.explode(copies))
    own = {c: F.col("__doc").getField(c) for c in docs.columns}
    own["text"] = F.when(F.col("__words") == F.col("__size"), whole).otherwise(part)
    if "n_chars" in own:
        own["n_chars"] = F.length(own["text"]).cast(docs.schema["n_chars"].dataType)
    return mixed.select(*(v.alias(c) for c, v in own.items()))
