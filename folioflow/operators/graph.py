"""Citation graphs: expansion from a seed, coupling scores and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import author_line, domain, is_academic, shortened
from ..functions.vectors import cosine
from ..sources.tables import keep

MAX_EDGES = 500
POOL = 1000


def references(edges: DataFrame, seed, most: int | None = None) -> DataFrame:
    """id of what the seed cites; with ``most``, the smallest ids only."""
    out = edges.where(F.col("src") == seed).select(F.col("dst").alias("id")).distinct()
    return out.orderBy("id").limit(most) if most else out


def citations(edges: DataFrame, seed, most: int | None = None) -> DataFrame:
    out = edges.where(F.col("dst") == seed).select(F.col("src").alias("id")).distinct()
    return out.orderBy("id").limit(most) if most else out


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """All that the nodes (id) cite or are cited by; one row an id."""
    out = edges.join(nodes, edges["src"] == nodes["id"], "left_semi").select(F.col("dst").alias("id"))
    back = edges.join(nodes, edges["dst"] == nodes["id"], "left_semi").select(F.col("src").alias("id"))
    return out.unionByName(back).distinct()


def layers(edges: DataFrame, seed, depth: int, most: int | None = MAX_EDGES) -> DataFrame:
    """(id, depth) of the nodes within ``depth`` (1 to 3) steps in either direction;
    the smallest depth counts, the seed is left out."""
    first = references(edges, seed, most).unionByName(citations(edges, seed, most)).distinct().where(F.col("id") != seed)
    found = last = keep(first.withColumn("depth", F.lit(1)))
    for d in range(2, depth + 1):
        new = neighbours(edges, last).where(F.col("id") != seed).join(found, "id", "left_anti")
        last = keep(new.withColumn("depth", F.lit(d)))  # each layer is written once
        found = found.unionByName(last)
    return found


def progress_rows(edges: DataFrame, found: DataFrame, seed, depth: int) -> DataFrame:
    """(phase, message, total, current): what a run over ``found``, the layers (id, depth)
    around the seed, reports of its references, its citations and each step outwards."""
    def row(rows, phase, message, total=None, current=None):
        n = rows.agg(F.count(F.lit(1)).cast("string").alias("n"))
        said = F.concat(F.lit(message[0]), "n", F.lit(message[1]))
        return n.select(F.lit(phase).alias("phase"), said.alias("message"), F.lit(total).cast("int").alias("total"), F.lit(current).cast("int").alias("current"))

    out = row(references(edges, seed), 2, ("Found ", " references.")).unionByName(row(citations(edges, seed), 3, ("Found ", " citations.")))
    for d in range(1, depth + 1):
        out = out.unionByName(row(found.where(F.col("depth") == d), 4, ("Processing, (", " papers)..."), depth, d))
    return out


def coupling(edges: DataFrame, candidates: DataFrame, seed, most: int | None = MAX_EDGES) -> DataFrame:
    """candidates (id, ...) with bc, cc and score: shares of the seed's references
    that the candidate cites too, and of its citations that cite it too.

    Edges meet the seed's two small sets before they are counted, so pairs of
    candidates are never made.
    """
    cited, citing = references(edges, seed, most), citations(edges, seed, most)
    b = edges.join(cited, edges["dst"] == cited["id"], "left_semi").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("b"))
    c = edges.join(citing, edges["src"] == citing["id"], "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("c"))
    sizes = cited.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("nb")).crossJoin(citing.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("nc")))
    out = candidates.join(b, "id", "left").join(c, "id", "left").crossJoin(F.broadcast(sizes))  # one row
    out = out.withColumn("bc", F.coalesce("b", F.lit(0)) / F.col("nb")).withColumn("cc", F.coalesce("c", F.lit(0)) / F.col("nc"))
    return out.withColumn("score", 0.5 * F.col("bc") + 0.5 * F.col("cc")).drop("b", "c", "nb", "nc")


def ranked(scored: DataFrame, most: int, bc_from: float = 0.0, cc_from: float = 0.0) -> DataFrame:
    return scored.where((F.col("bc") >= bc_from) & (F.col("cc") >= cc_from)).orderBy(F.desc("score"), "id").limit(most)


def described(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """rows (id, ...) with title, snippet, authors, year, venue, url, domain and
    is_academic of their metadata; those without a title go."""
    known = metadata.where(F.coalesce("title", F.lit("")) != "")
    out = rows.join(known, "id").withColumn("domain", domain(F.col("url"))).withColumn("snippet", shortened(F.col("abstract"), 250))
    return out.withColumn("authors", author_line(F.col("authors"))).withColumn("is_academic", is_academic(F.col("domain"), F.col("url"))).drop("abstract")


def spread(rows: DataFrame, score: str = "score") -> DataFrame:
    """Scores from 0 (least) to 1 (most); left as they are if all are equal."""
    ends = rows.agg(F.min(score).alias("__low"), F.max(score).alias("__high"))
    gap = F.col("__high") - F.col("__low")
    out = rows.crossJoin(F.broadcast(ends))  # one row
    return out.withColumn(score, F.when(gap > 0, (F.col(score) - F.col("__low")) / gap).otherwise(F.col(score))).drop("__low", "__high")


def reranked(rows: DataFrame, vectors: DataFrame, seed_vector: DataFrame, most: int, score_from: float = 0.0) -> DataFrame:
    """rows (id, ...) by the similarity of their vectors (id, vector) to the seed's
    (one row, seed_vector): spread to 0..1, cut by threshold and number. Rows
    without a vector count as 0 before the spread."""
    near = rows.join(vectors, "id", "left").crossJoin(F.broadcast(seed_vector))  # one row
    near = near.withColumn("score", F.coalesce(cosine(F.col("vector"), F.col("seed_vector")), F.lit(0.0))).drop("vector", "seed_vector")
    return spread(near).where(F.col("score") >= score_from).orderBy(F.desc("score"), "id").limit(most)


def snowball(edges: DataFrame, metadata: DataFrame, seed, depth: int = 1, most: int = 50, bc_from: float = 0.0, cc_from: float = 0.0,
             vectors: DataFrame | None = None, seed_vector: DataFrame | None = None, score_from: float = 0.0) -> DataFrame:
    """Papers related to a seed, best first; by vectors where these are given, from
    a pool of POOL by coupling."""
    scored = coupling(edges, layers(edges, seed, depth), seed)
    if vectors is None:
        return described(ranked(scored, most, bc_from, cc_from), metadata)
    pool = described(ranked(scored, POOL, bc_from, cc_from), metadata)
    return reranked(pool, vectors, seed_vector, most, score_from).withColumn("bc", F.lit(0.0)).withColumn("cc", F.lit(0.0))


def resolve_seed(papers: DataFrame, doi: str | Column | None, title: str | Column | None) -> DataFrame:
    """The paper with the DOI, else the first of those with the title; one row at most.
    A DOI or title that is null or empty is not looked for; both may be columns of
    ``papers``."""
    by_doi, by_title = (F.lower(c) == F.lower(F.nullif(w if isinstance(w, Column) else F.lit(w).cast("string"), F.lit(""))) for c, w in (("doi", doi), ("title", title)))
    found = papers.withColumn("__tier", F.when(by_doi, 1).when(by_title, 2)).where("__tier is not null")
    return found.orderBy("__tier", "id").limit(1).drop("__tier")
