"""How far the sources of each language differ in their words.

Words are counted in tasks, per group (language, source). The distance of two groups
sums, over all terms, the gap of their smoothed shares, which depend on a term's two
counts alone. So each block of terms becomes an indicator matrix, a column for each
(group, count level), level zero included; its product with its own transpose is the
joint table of levels of every two groups, exactly, and each cell is priced by the gap
of its two levels' shares. Terms of like frequency are in one block, so that a block
has few levels; sources are in stripes, and a task prices two stripes of one block.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tasks import keep

LEAST_DOCS = 30
SMOOTHING = 5
UNIT = 1_000_000_000
TOP = 50
#: Counts that a task holds before it hands them on, bytes that it splits at once.
MOST_HELD = 400_000
SLICE_BYTES = 1 << 20
#: Counts in a block of terms, sources in a stripe, columns of a dense indicator matrix.
BLOCK_COUNTS = 16_384
STRIPE = 64
COLUMNS = 2048
#: Rows of a table of languages' levels or groups that goes to all tasks; larger ones are
#: left to Spark's joins.
MOST_SENT = 100_000

#: To lower case, and all that no term has to a space.
_LETTERS = bytes(c if 97 <= c <= 122 or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _counted(batches, most_held=MOST_HELD, slice_bytes=SLICE_BYTES):
    """(lang, source, term, n, docs) of a task's rows, added up as far as memory goes."""
    held, size = {}, 0

    def handed_on():
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch.column("lang"), batch.column("source"), batch.column("text")):
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, plain, at, own = len(n), text.as_py().translate(_LETTERS), 0, set()
            while at < len(plain):
                end = plain.find(b" ", at + slice_bytes) if len(plain) - at > slice_bytes else -1
                end = len(plain) if end < 0 else end
                words = plain[at:end].split()
                n.update(words)
                own.update(words)
                at = end
            docs.update(own)
            size += len(n) - before
            if size > most_held:
                yield from handed_on()
                held, size = {}, 0
    yield from handed_on()


def kept_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term binary, n, c, once) of the terms that at least ``least_docs``
    documents of their language have: c the language's count, once on one row a term."""
    counts = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term binary, n long, docs long")
    # Rows of a term are together from here on, at most one for each source and task.
    counts = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"c": F.sum("n").over(of_term), "df": F.sum("docs").over(of_term), "once": F.min("source").over(of_term) == F.col("source")})
    return keep(counts.where(F.col("df") >= least_docs).drop("docs", "df"), "divergence-counts")


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 5) / (n + 5 * v)), exactly; null where no term is kept."""
    top = (count + SMOOTHING).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return 1 + F.call_function("div", top, F.nullif(n + SMOOTHING * v, F.lit(0)).cast("decimal(20,0)"))


def _priced(stripe: int, columns: int):
    """The summed gaps of all pairs of sources of two stripes over one block of terms."""

    def run(key, table):
        lang, _, _, first, second = (k.as_py() for k in key)
        nr, n, p = (table.column(c).to_numpy() for c in ("nr", "n", "p"))
        term = pa.concat_arrays(table.column("term").chunks).dictionary_encode().indices
        mark = np.asarray(term.is_null())
        code = term.fill_null(0).to_numpy(zero_copy_only=False)
        names = dict(zip(nr[mark].tolist(), table.column("source").filter(pa.array(mark)).to_pylist()))
        terms = int(table.column("terms").filter(pa.array(mark))[0].as_py())
        seen = int(code[~mark].max()) + 1 if (~mark).any() else 0
        stripes = [np.flatnonzero(nr // stripe == s) for s in (first, second)]
        sources = [np.unique(nr[s]) for s in stripes]
        total = np.zeros((len(sources[0]), len(sources[1])), np.int64)

        def side(rows, a, b):
            """Indicator matrix of terms a to b, shares of its columns, first column a source."""
            rows = rows[mark[rows] | ((code[rows] >= a) & (code[rows] < b))]
            order = rows[np.lexsort((n[rows], nr[rows]))]
            new = np.ones(len(order), bool)
            new[1:] = (nr[order][1:] != nr[order][:-1]) | (n[order][1:] != n[order][:-1])
            column = np.cumsum(new) - 1
            starts = np.flatnonzero(mark[order][new])  # level zero comes first in each source
            x = np.zeros((b - a, int(new.sum())), np.float32)
            counted = ~mark[order]
            x[code[order][counted] - a, column[counted]] = 1
            x[:, starts] = 1 - np.add.reduceat(x, starts, axis=1)
            return x, p[order][new], starts

        def price(a, b, rest):
            left = side(stripes[0], a, b)
            right = left if first == second else side(stripes[1], a, b)
            if max(left[0].shape[1], right[0].shape[1]) > columns and b - a > 1:
                middle = (a + b) // 2
                price(a, middle, 0)
                price(middle, b, rest)
                return
            joint = (left[0].T @ right[0]).astype(np.int64)  # counts below 2^24: exact
            joint[np.ix_(left[2], right[2])] += rest  # terms that neither stripe has
            cost = joint * np.abs(left[1][:, None] - right[1][None, :])
            total[...] += np.add.reduceat(np.add.reduceat(cost, left[2], axis=0), right[2], axis=1)

        if terms:
            price(0, seen, terms - seen)
        at = [(i, j) for i, g in enumerate(sources[0]) for j, h in enumerate(sources[1]) if g < h or first != second]
        pairs = [(names[int(sources[0][i])], names[int(sources[1][j])], int(total[i, j])) for i, j in at]
        both = [*pairs, *((b, a, v) for a, b, v in pairs)]
        columns_out = [pa.array([lang] * len(both), pa.string()), *(pa.array([x[k] for x in both], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.int64())))]
        return pa.Table.from_arrays(columns_out, ["lang", "source", "item", "value"])

    return run


def _sent(small: DataFrame) -> DataFrame:
    """``small``, sent to all tasks if its rows are few: its keys are, so a shuffle by
    them would leave a few large tasks."""
    small = keep(small, "divergence-small")
    return F.broadcast(small) if small.count() <= MOST_SENT else small


def _pairs(counts: DataFrame, groups: DataFrame, stripe: int, block_counts: int, columns: int) -> DataFrame:
    """(lang, source, item, value): all pairs of sources of a language."""
    level = F.floor(F.log2("c")).cast("int").alias("level")
    sizes = counts.groupBy("lang", level).agg(F.ceil(F.count(F.lit(1)) / block_counts).alias("blocks"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    dealt = counts.withColumn("level", level).join(_sent(sizes), ["lang", "level"]).withColumn("block", block)
    of_group = _sent(groups.select("lang", "source", "nr", "stripes", "total", "v"))
    rows = dealt.join(of_group, ["lang", "source"]).select(
        "lang", "level", "block", "nr", "stripes", "term", F.col("n"), share(F.col("n"), F.col("total"), F.col("v")).alias("p"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("terms")
    )
    blocks = dealt.where("once").groupBy("lang", "level", "block").agg(F.count(F.lit(1)).alias("terms"))
    # A language without terms has one block of none, so its pairs come out too.
    bare = groups.where("v = 0").select("lang", F.lit(-1).alias("level"), F.lit(0).alias("block"), F.lit(0).cast("long").alias("terms")).distinct()
    marks = blocks.unionByName(bare).join(of_group, "lang").select(
        "lang", "level", "block", "nr", "stripes", F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"),
        F.coalesce(share(F.lit(0).cast("long"), F.col("total"), F.col("v")), F.lit(0)).alias("p"), "source", "terms",
    )
    own = F.floor(F.col("nr") / stripe).cast("int")
    met = rows.unionByName(marks).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("stripes") - 1)))
    met = met.withColumns({"first": F.least(own, "other"), "second": F.greatest(own, "other")}).drop("stripes", "other")
    priced = met.groupBy("lang", "level", "block", "first", "second").applyInArrow(_priced(stripe, columns), "lang string, source string, item string, value long")
    return priced.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, stripe: int = STRIPE, block_counts: int = BLOCK_COUNTS, columns: int = COLUMNS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (text, lang, source).

    Terms are runs of letters and characters beyond ASCII, A-Z lower-cased; each language
    keeps those that ``least_docs`` of its documents have. Part ``pair``: the other sources of
    the language, by the summed gap of shares over all kept terms, 0 where there are
    none. Part ``term``: the ``top`` kept terms that a source has more of than its language,
    by the gap. Ranks count from 1 by value, falling, then by item. Nulls count as empty;
    a group whose documents have no kept term, or no text, is one too; a language of one
    source has no pairs; repeated rows count each; an empty table gives none. Other
    columns are not looked at. Texts of any length are counted whole.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.select(empty("text"), empty("lang"), empty("source"))
    counts = kept_counts(docs, least_docs)
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.where("once").groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("lang_total"))
    # Sources of a language are numbered in one task: their pairs are what is asked for.
    of_lang = Window.partitionBy("lang")
    groups = docs.select("lang", "source").distinct().withColumns(
        {"nr": F.row_number().over(of_lang.orderBy("source")) - 1, "stripes": F.ceil(F.count(F.lit(1)).over(of_lang) / stripe).cast("int")}
    )
    groups = keep(groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"]), "divergence-groups")

    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("c"), F.col("lang_total"), F.col("v"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = counts.join(_sent(groups.select("lang", "source", "total", "v", "lang_total")), ["lang", "source"])
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    pairs = _pairs(counts, groups, stripe, block_counts, columns).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return terms.unionByName(pairs)
