"""Indexes and maps: a graph of vectors and its life, layouts, terms inside texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import layout, search
from ..operators.cache import ResultCache
from ..operators.substrings import SubstringIndex
from ..operators.vector_index import VectorIndex
from ..sources.tables import shared_folder
from .registry import query
from .research import asked_vectors, vectors


def _new_index(df) -> VectorIndex:
    return VectorIndex(df.sparkSession, f"{shared_folder(df.sparkSession)}/index-{uuid.uuid4().hex}")


@query("v6_index_search")
def _(t):
    """The 10 nearest of all vectors by the graph index, for the contract's queries."""
    rows = vectors(t)
    index = _new_index(rows)
    index.rebuild(rows)
    return index.search(asked_vectors(t), [f for f in rows.schema if f.name != "vector"], 10)


@query("v8_index_life", """
WITH n AS (SELECT count(*) FILTER (vec_id % 3 <> 0) AS part, count(*) AS rows FROM embeddings WHERE embedding IS NOT NULL), d AS (SELECT any_value(len(embedding)) AS dim FROM embeddings)
SELECT * FROM (SELECT 'built' AS step, 1::BIGINT AS version, dim, part AS rows, 2::BIGINT AS skipped, part > 0 AS ready FROM n, d
  UNION ALL SELECT 'added', 2, dim, rows, 2, rows > 0 FROM n, d UNION ALL SELECT 'rebuilt', 3, dim, rows, 0, rows > 0 FROM n, d UNION ALL SELECT 'cleared', 0, 0, 0, 0, false)""")  # fmt: skip
def _(t):
    rows = vectors(t)
    index, said = _new_index(rows), []

    def tell(step):
        s = index.stats().first()
        said.append((step, s["version"], s["dim"], s["rows"], s["skipped"], index.ready()))

    # Two vectors of another size are skipped and counted.
    odd = rows.limit(2).withColumn("vector", F.slice("vector", 1, 3))
    index.rebuild(rows.where("id % 3 <> 0").unionByName(odd))
    tell("built")
    index.add(rows.where("id % 3 = 0"))
    tell("added")
    index.rebuild(rows)
    tell("rebuilt")
    index.clear()
    tell("cleared")
    return rows.sparkSession.createDataFrame(said, "step string, version long, dim int, rows long, skipped long, ready boolean")


@query("v12_layout")
def _(t):
    """A map of all vectors for display: neighbour graph, rounds, extents of six."""
    return layout.displayed(layout.laid_out(vectors(t).select("id", "vector")))


@query("f47_display_coordinates", """
WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, CASE WHEN vec_id % 7 > 0 THEN embedding[3]::DOUBLE * 100 END AS z FROM embeddings),
m AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z), 1) AS s FROM v)
SELECT vec_id, round((x - cx) / s * 6, 6) AS x, round((y - cy) / s * 6, 6) AS y, round(coalesce((z - cz) / s * 6, 0), 6) AS z FROM v, m""")  # fmt: skip
def _(t):
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    # A seventh of the last coordinates is none, in turn null, not a number and infinite.
    odd = F.when(F.col("vec_id") % 21 == 0, F.lit(None)).when(F.col("vec_id") % 21 == 7, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    v = t("embeddings").select("vec_id", at(0).alias("x"), at(1).alias("y"), F.when(F.col("vec_id") % 7 > 0, at(2) * 100).otherwise(odd).alias("z"))
    return layout.displayed(v).select("vec_id", *(F.round(c, 6).alias(c) for c in layout.AXES))


def _searched(n: str) -> str:
    """Terms of the documents whose id is divisible by 100: some characters of their text
    in upper case, their first two, and two words with a wildcard between."""
    lower = "translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    term = "translate(q.term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH q AS (
  SELECT doc_id * 10 AS term_id, upper(substr(text, 20, 9)) AS term FROM documents WHERE doc_id % 100 = 0 AND NOT regexp_matches(substr(text, 20, 9), '[^\\x00-\\x7F]')
  UNION ALL SELECT doc_id * 10 + 1, substr(text, 1, 2) FROM documents WHERE doc_id % 100 = 0
  UNION ALL SELECT doc_id * 10 + 2, substr(text, 5, 6) || '%' || substr(text, 40, 5) FROM documents WHERE doc_id % 100 = 0)
SELECT term_id, doc_id FROM (SELECT q.term_id, d.doc_id FROM documents d, q WHERE {lower} LIKE '%' || {term} || '%') {n}"""


def _terms(t):
    some = t("documents").where("doc_id % 100 = 0")
    plain = some.where(~F.substring("text", 20, 9).rlike(r"[^\x00-\x7F]"))
    upper = plain.select((F.col("doc_id") * 10).alias("term_id"), F.upper(F.substring("text", 20, 9)).alias("term"))
    start = some.select((F.col("doc_id") * 10 + 1).alias("term_id"), F.substring("text", 1, 2).alias("term"))
    wild = F.concat(F.substring("text", 5, 6), F.lit("%"), F.substring("text", 40, 5))
    return upper.unionByName(start).unionByName(some.select((F.col("doc_id") * 10 + 2).alias("term_id"), wild.alias("term")))


@query("p5_substring_search", _searched(""))
def _(t):
    return SubstringIndex(t("documents"), "doc_id").search(_terms(t))


@query("o7_substring_first_ten", _searched("QUALIFY row_number() OVER (PARTITION BY term_id ORDER BY doc_id) <= 10"))
def _(t):
    return SubstringIndex(t("documents"), "doc_id").search(_terms(t), limit=10)


@query("v9_cached_search", """
SELECT * FROM (VALUES ('first', false, 10), ('again', true, 10), ('changed', false, 10), ('back', true, 10)) v(step, hit, rows)
WHERE (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) > 0""")  # fmt: skip
def _(t):
    """Hits and misses of one search over a library, over one with other rows, and over the first again."""
    rows, said = vectors(t), []
    cache = ResultCache(rows.sparkSession, f"{shared_folder(rows.sparkSession)}/cache-{uuid.uuid4().hex}")
    other = rows.withColumn("vector", F.when(F.col("id") % 2 == 0, F.reverse("vector")).otherwise(F.col("vector")))
    for step, query_text, library in (("first", "Graphs ", rows), ("again", "graphs", rows.repartition(3)), ("changed", "graphs", other), ("back", "graphs", rows)):
        asked = {"query": query_text, "folders": [3, 1, 2] if step == "first" else [1, 2, 3], "scope": "all", "model": None}
        one = asked_vectors(t).where("query_id = 0")
        found, hit = cache.get(asked, {"library": library, "asked": one}, lambda library=library, one=one: search.nearest_each(library, one, 10))
        said.append((step, hit, found.count()))
    return rows.sparkSession.createDataFrame(said, "step string, hit boolean, rows int")
