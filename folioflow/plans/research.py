"""Vector search, citation graphs, documents, fusion, functions and event folds,
on the stand-ins that the tables offer: parts that meet in an order cite each
other, a document's lines are its blocks, conversations are chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.vectors import cosine, from_blob, strict_cosine, to_blob
from ..operators import documents as D
from ..operators import fusion, graph, pivots, search
from ..operators import references as R
from ..sources.tables import keep
from ..streaming import events as E
from .registry import query

COS = "list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[])"
L2 = "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))"


def vectors(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("folder"), F.col("embedding").alias("vector"))


def first_vector(t) -> DataFrame:
    return t("embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def asked_vectors(t) -> DataFrame:
    """The contract's queries: each row whose id is divisible by 100."""
    return t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


@query("v5_vector_topk", f"""
SELECT a.vec_id AS id, a.label AS folder, round({COS}, 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 0
ORDER BY {COS} DESC, id LIMIT 10""")  # fmt: skip
def _(t):
    return search.nearest(vectors(t), first_vector(t), 10).withColumn("score", F.round("score", 6))


@query("v5_distance_scores", f"""
SELECT a.vec_id AS id, a.label AS folder, round(exp(-{L2}), 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 0
ORDER BY {L2}, id LIMIT 20""")  # fmt: skip
def _(t):
    return search.nearest(vectors(t), first_vector(t), 20, "distance").withColumn("score", F.round("score", 6))


@query("v7_in_folders", f"""
SELECT id, folder, round(score, 6) AS score FROM (
  SELECT a.vec_id AS id, a.label AS folder, exp(-{L2}) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 0 ORDER BY score DESC, id LIMIT 60)
WHERE folder IN (0, 1, 2) AND score >= 0.01 ORDER BY score DESC, id LIMIT 20""")  # fmt: skip
def _(t):
    return search.nearest_in(vectors(t), first_vector(t), 20, [0, 1, 2], 0.01).withColumn("score", F.round("score", 6))


# The same for all queries of the contract; those above take the one of their SQL.
TOP_EACH = f"""
SELECT query_id, id, folder, round(s, 6) AS score FROM (SELECT q.vec_id AS query_id, a.vec_id AS id, a.label AS folder, {COS} AS s FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10"""  # fmt: skip


@query("v5_vector_topk_each", TOP_EACH)
def _(t):
    return search.nearest_each(vectors(t), asked_vectors(t), 10).withColumn("score", F.round("score", 6))


NEAR_EACH = f"""
SELECT query_id, id, folder, round(exp(-d), 6) AS score FROM (SELECT q.vec_id AS query_id, a.vec_id AS id, a.label AS folder, {L2} AS d FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 20"""  # fmt: skip


@query("v5_distance_scores_each", NEAR_EACH)
def _(t):
    return search.nearest_each(vectors(t), asked_vectors(t), 20, "distance").withColumn("score", F.round("score", 6))


# The same rows by pivots and triangle bounds.
@query("v5_vector_topk_pruned", TOP_EACH)
def _(t):
    return pivots.nearest_pruned(vectors(t), asked_vectors(t), 10).withColumn("score", F.round("score", 6))


@query("v5_distance_scores_pruned", NEAR_EACH)
def _(t):
    return pivots.nearest_pruned(vectors(t), asked_vectors(t), 20, "distance").withColumn("score", F.round("score", 6))


@query("v7_in_folders_each", f"""
SELECT query_id, id, folder, round(exp(-d), 6) AS score FROM (
  SELECT * FROM (SELECT q.vec_id AS query_id, a.vec_id AS id, a.label AS folder, {L2} AS d FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 60)
WHERE folder IN (0, 1, 2) AND exp(-d) >= 0.01 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, id) <= 20""")  # fmt: skip
def _(t):
    return search.nearest_in_each(vectors(t), asked_vectors(t), 20, [0, 1, 2], 0.01).withColumn("score", F.round("score", 6))


@query("v1_cosine_pairs", f"""
SELECT a.vec_id AS id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings q ON q.vec_id = a.vec_id + 1""")  # fmt: skip
def _(t):
    v = vectors(t)
    next_ = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return v.join(next_, "id").select("id", F.round(cosine(F.col("vector"), F.col("other")), 6).alias("score"))


@query("v3_strict_cosine", "SELECT vec_id AS id, 1.0::DOUBLE AS score FROM embeddings")
def _(t):
    return vectors(t).select("id", F.round(strict_cosine(F.col("vector"), F.col("vector")), 6).alias("score"))


@query("f57_blob_round_trip", "SELECT vec_id AS id, len(embedding) * 4 AS bytes, true AS same FROM embeddings")
def _(t):
    v = vectors(t).withColumn("blob", to_blob("vector"))
    return v.select("id", F.length("blob").cast("long").alias("bytes"), (from_blob("blob") == F.col("vector")).alias("same"))


@query("v9_library_search", f"""
WITH s AS (
  SELECT 'chunk' AS type, a.vec_id AS id, a.vec_id % 50 AS paper_id, NULL::BIGINT[] AS source_papers, NULL::INT AS min_depth, {COS} AS score
  FROM embeddings a, embeddings q WHERE q.vec_id = 0 AND a.vec_id % 2 = 0 AND (a.vec_id % 50) % 4 < 3
  UNION ALL
  SELECT 'abstract', a.vec_id, NULL, [a.vec_id % 50], (a.vec_id % 3)::INT, {COS}
  FROM embeddings a, embeddings q WHERE q.vec_id = 0 AND a.vec_id % 2 = 1 AND (a.vec_id % 50) % 4 < 3 AND a.vec_id % 3 <= 1)
SELECT type, id, paper_id, source_papers, min_depth, round(score, 6) AS score FROM s ORDER BY s.score DESC, type, id LIMIT 50""")  # fmt: skip
def _(t):
    return _library_search(t, first_vector(t))


def _library_search(t, asked: DataFrame) -> DataFrame:
    v = vectors(t).withColumn("paper_id", F.col("id") % 50)
    papers = v.select("paper_id").distinct().withColumn("folder", F.col("paper_id") % 4)
    chunks = v.where("id % 2 = 0").select("id", "paper_id", F.col("id").cast("string").alias("content"))
    odd = v.where("id % 2 = 1")
    abstracts = odd.select(F.col("id").alias("graph_id"), F.col("id").cast("string").alias("abstract"), "vector")
    links = odd.select(F.col("id").alias("graph_id"), "paper_id", (F.col("id") % 3).cast("int").alias("depth"))
    found = search.search_library(papers, chunks, v.select("id", "vector"), abstracts, links, asked, [0, 1, 2], "all", 50, 1)
    return found.drop("content").withColumn("score", F.round("score", 6))


@query("v9_library_search_each", f"""
WITH s AS (
  SELECT q.vec_id AS query_id, 'chunk' AS type, a.vec_id AS id, a.vec_id % 50 AS paper_id, NULL::BIGINT[] AS source_papers, NULL::INT AS min_depth, {COS} AS score
  FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND a.vec_id % 2 = 0 AND (a.vec_id % 50) % 4 < 3
  UNION ALL
  SELECT q.vec_id, 'abstract', a.vec_id, NULL, [a.vec_id % 50], (a.vec_id % 3)::INT, {COS}
  FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND a.vec_id % 2 = 1 AND (a.vec_id % 50) % 4 < 3 AND a.vec_id % 3 <= 1)
SELECT query_id, type, id, paper_id, source_papers, min_depth, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, type, id) <= 50""")  # fmt: skip
def _(t):
    return _library_search(t, asked_vectors(t))


@query("j6_vectors_of_missing", """
SELECT doc_id AS id, 64 AS dim FROM documents WHERE regexp_matches(text, '\\w')""".replace("\\\\", "\\"))  # fmt: skip
def _(t):
    rows = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    cached = search.hashed_vectors(rows.where("id % 2 = 0"))
    return search.with_vectors(rows, cached, search.hashed_vectors).select("id", F.size("vector").alias("dim"))


EDGES = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_linenumber > b.l_linenumber AND a.l_partkey <> b.l_partkey)"""
SEED = 10


def edges(t) -> DataFrame:
    """Parts that cite one another, written once for all that a plan does with them."""
    a, b = (t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias(n)) for n in ("src", "dst"))
    b = b.withColumnRenamed("l_linenumber", "n")
    return keep(a.join(b, "l_orderkey").where("l_linenumber > n and src <> dst").select("src", "dst").distinct())


def papers(t) -> DataFrame:
    return t("part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("abstract"), F.array("p_brand").alias("authors"),
        F.col("p_size").alias("year"), F.col("p_brand").alias("venue"), F.concat(F.lit("https://www.nature.com/"), F.col("p_partkey").cast("string")).alias("url"),
    )


SETS = f"{EDGES}, r AS (SELECT DISTINCT dst AS id FROM e WHERE src = {SEED} ORDER BY id LIMIT 500), c AS (SELECT DISTINCT src AS id FROM e WHERE dst = {SEED} ORDER BY id LIMIT 500)"
L1 = f"l1 AS (SELECT DISTINCT id FROM (FROM r UNION ALL FROM c) WHERE id <> {SEED})"
LAYERS = f"{SETS}, {L1}, l2 AS (SELECT DISTINCT id FROM (SELECT dst AS id FROM e WHERE src IN (FROM l1) UNION ALL SELECT src FROM e WHERE dst IN (FROM l1)) WHERE id <> {SEED} AND id NOT IN (FROM l1))"


@query("g1_references_citations", f"WITH {EDGES} SELECT 'r' AS side, dst AS id FROM e WHERE src = {SEED} UNION ALL SELECT 'c', src FROM e WHERE dst = {SEED}")
def _(t):
    e = edges(t)
    return graph.references(e, SEED).withColumn("side", F.lit("r")).unionByName(graph.citations(e, SEED).withColumn("side", F.lit("c")))


@query("g2_layers", f"WITH {LAYERS} SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2")
def _(t):
    return graph.layers(edges(t), SEED, 2)


def _coupled(nodes: str) -> str:
    return f"""k AS (SELECT n.id,
  (SELECT count(DISTINCT dst) FROM e WHERE e.src = n.id AND dst IN (FROM r)) / greatest((SELECT count(*) FROM r), 1) AS bc,
  (SELECT count(DISTINCT src) FROM e WHERE e.dst = n.id AND src IN (FROM c)) / greatest((SELECT count(*) FROM c), 1) AS cc FROM {nodes} n)"""


@query("g3_g4_coupling", f"WITH {SETS}, {L1}, {_coupled('l1')} SELECT id, round(bc, 6) AS bc, round(cc, 6) AS cc, round(0.5 * bc + 0.5 * cc, 6) AS score FROM k")
def _(t):
    e = edges(t)
    rows = graph.coupling(e, graph.layers(e, SEED, 1), SEED)
    return rows.select("id", *(F.round(c, 6).alias(c) for c in ("bc", "cc", "score")))


@query("g6_snowball", f"""
WITH {SETS}, {L1}, {_coupled('l1')}, t AS (SELECT *, 0.5 * bc + 0.5 * cc AS score FROM k ORDER BY score DESC, id LIMIT 50)
SELECT t.id, round(score, 6) AS score, p_name AS title, p_brand AS authors, p_size AS year, 'nature.com' AS domain, true AS is_academic
FROM t JOIN part ON p_partkey = t.id""")  # fmt: skip
def _(t):
    return graph.snowball(edges(t), papers(t), SEED, 1, 50).select("id", F.round("score", 6).alias("score"), "title", "authors", "year", "domain", "is_academic")


@query("g6_snowball_by_vectors", f"""
WITH {SETS}, {L1}, {_coupled('l1')}, t AS (SELECT *, 0.5 * bc + 0.5 * cc AS score FROM k ORDER BY score DESC, id LIMIT 1000),
s AS (SELECT t.id, coalesce({COS}, 0) AS s FROM t LEFT JOIN embeddings a ON a.vec_id = t.id CROSS JOIN (SELECT * FROM embeddings WHERE vec_id = {SEED}) q),
n AS (SELECT id, CASE WHEN max(s) OVER () > min(s) OVER () THEN (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER ()) ELSE s END AS score FROM s)
SELECT id, round(score, 6) AS score FROM n WHERE score >= 0.2 ORDER BY n.score DESC, id LIMIT 50""")  # fmt: skip
def _(t):
    seed = t("embeddings").where(F.col("vec_id") == SEED).select(F.col("embedding").alias("seed_vector"))
    found = graph.snowball(edges(t), papers(t), SEED, 1, 50, vectors=vectors(t).select("id", "vector"), seed_vector=seed, score_from=0.2)
    return found.select("id", F.round("score", 6).alias("score"))


@query("s12_resolve_seed", "SELECT p_partkey AS id, p_name AS title FROM part WHERE lower(p_name) = (SELECT lower(p_name) FROM part WHERE p_partkey = 3) ORDER BY id LIMIT 1")
def _(t):
    known = papers(t).withColumn("doi", F.lit(None).cast("string"))
    return _resolved(t, known, "p_partkey = 3", F.lit(None).cast("string"))


def _resolved(t, known: DataFrame, seed: str, doi) -> DataFrame:
    name = t("part").where(seed).select(F.col("p_partkey").alias("k"), F.col("p_name").alias("wanted"))
    both = known.crossJoin(F.broadcast(name))  # one row
    return graph.resolve_seed(both, doi, F.col("wanted")).select("id", "title")


@query("s12_resolve_seed_by_doi", "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey = 7 UNION ALL SELECT p_partkey, p_name FROM part WHERE p_partkey = 3 AND NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = 7)")
def _(t):
    # The DOI is of another paper than the title is: it goes first.
    known = papers(t).withColumn("doi", F.concat(F.lit("10.1000/P"), F.col("id").cast("string")))
    return _resolved(t, known, "p_partkey = 3", F.lit("10.1000/p7"))


# Blocks: line by line twelve to a page; some lines stand for headings and figures.
BLOCKS = r"""ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
b AS (SELECT doc_id, (i // 12)::INT AS page, (i % 12)::INT AS nth,
  CASE WHEN i = 0 THEN 'doc_title' WHEN i % 9 = 4 THEN 'paragraph_title' WHEN i % 11 = 7 THEN 'image' WHEN i % 11 = 8 THEN 'figure_title' ELSE 'text' END AS label,
  CASE WHEN i > 0 AND i % 9 = 4 AND (doc_id + i) % 4 = 0 THEN 'Methods' WHEN i > 0 AND i % 9 = 4 AND (doc_id + i) % 4 = 1 THEN 'References'
       WHEN i > 0 AND i % 9 = 4 AND (doc_id + i) % 4 = 2 THEN 'Results' ELSE content END AS content,
  (i % 12) * 80.0 + CASE WHEN i % 5 = 0 THEN 50 ELSE 20 END AS y0, (i % 12) * 80.0 + 90 AS y1 FROM ln)"""


def blocks(t) -> DataFrame:
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "content"))
    i, kind = F.col("i"), (F.col("doc_id") + F.col("i")) % 4
    heading = (i > 0) & (i % 9 == 4)
    label = F.when(i == 0, "doc_title").when(heading, "paragraph_title").when(i % 11 == 7, "image").when(i % 11 == 8, "figure_title").otherwise("text")
    named = F.when(heading & (kind == 0), "Methods").when(heading & (kind == 1), "References").when(heading & (kind == 2), "Results").otherwise(F.col("content"))
    y = (i % 12) * 80.0
    return d.select(
        "doc_id", (i / 12).cast("int").alias("page"), (i % 12).alias("nth"), label.alias("label"), named.alias("content"),
        F.lit(1000.0).alias("height"), F.lit(600.0).alias("width"), F.lit(50.0).alias("x0"), (y + F.when(i % 5 == 0, 50).otherwise(20)).alias("y0"), F.lit(550.0).alias("x1"), (y + 90).alias("y1"),
    )


_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_BAD = "length(t) < 100 OR NOT regexp_matches(t, '[a-zA-Z0-9]') OR regexp_matches(t, '^(https?://)?(www\\.)?doi\\.org/[^\\s]+$|^10\\.\\d{4,9}/[-._;()/:A-Z0-9]+$', 'i') OR " + " OR ".join("contains(lower(t), '" + w.replace("'", "''") + "')" for w in X.BOILERPLATE) + f" OR regexp_matches(t, '{X.PUBLISHED}', 'i') OR len(regexp_extract_all(t, '{X.AUTHOR_MARK}')) >= 2"


@query("p13_uninformative", f"SELECT doc_id, ({_BAD}) AS uninformative FROM (SELECT doc_id, {_TRIM.format('text')} AS t FROM documents)")
def _(t):
    return t("documents").select("doc_id", X.is_uninformative(F.col("text")).alias("uninformative"))


@query("d1_chunks", f"""
WITH {BLOCKS}, g AS (SELECT *, coalesce(sum((label = 'text')::INT) OVER (PARTITION BY doc_id ORDER BY page, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM b WHERE label IN ('paragraph_title', 'figure_title', 'text')),
h AS (SELECT *, last_value(CASE WHEN label = 'paragraph_title' THEN content END IGNORE NULLS) OVER (PARTITION BY doc_id, g ORDER BY page, nth) AS head FROM g),
c AS (SELECT doc_id, page, nth, CASE WHEN label = 'text' THEN 'paragraph_title' ELSE label END AS section_type,
  CASE WHEN label = 'text' AND coalesce(head, '') <> '' THEN head || chr(10) || content ELSE content END AS content FROM h WHERE label <> 'paragraph_title')
SELECT doc_id, page, nth, section_type, 0 AS chunk_index, content FROM (SELECT *, {_TRIM.format('content')} AS t FROM c) WHERE NOT ({_BAD})""")  # fmt: skip
def _(t):
    return D.chunks(blocks(t), "doc_id")


@query("d2_repeated_edges", f"""
WITH {BLOCKS} SELECT doc_id, noise FROM (SELECT doc_id, page, regexp_replace(lower(t), '\\s+', ' ', 'g') AS noise
  FROM (SELECT *, {_TRIM.format('content')} AS t FROM b) WHERE length(t) BETWEEN 1 AND 120 AND (y0 <= 120 OR y1 >= 880)) GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3""")  # fmt: skip
def _(t):
    return D.repeated_edges(blocks(t), "doc_id")


CLEAN = f"""{BLOCKS}, bt AS (SELECT *, {_TRIM.format('content')} AS t FROM b),
nz AS (SELECT doc_id, noise FROM (SELECT doc_id, page, regexp_replace(lower(t), '\\s+', ' ', 'g') AS noise FROM bt WHERE length(t) BETWEEN 1 AND 120 AND (y0 <= 120 OR y1 >= 880)) GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3),
inf AS (SELECT DISTINCT a.doc_id, a.page, a.nth FROM bt a JOIN bt f ON a.doc_id = f.doc_id AND a.page = f.page AND f.label = 'image'
  WHERE greatest(0, least(a.y1, f.y1) - greatest(a.y0, f.y0)) > 0.3 * (a.y1 - a.y0)),
cl AS (SELECT * FROM bt WHERE (doc_id, page, nth) NOT IN (FROM inf) AND (doc_id, regexp_replace(lower(t), '\\s+', ' ', 'g')) NOT IN (FROM nz))"""
_MD = "CASE WHEN t = '' THEN NULL WHEN label = 'paragraph_title' THEN chr(10) || '## ' || t || chr(10) WHEN label = 'doc_title' THEN chr(10) || '# ' || t || chr(10) WHEN label = 'text' THEN chr(10) || t || chr(10) END"


@query("d3_markdown", f"WITH {CLEAN} SELECT doc_id, string_agg({_MD}, chr(10) ORDER BY page, nth) AS markdown FROM cl GROUP BY doc_id HAVING count({_MD}) > 0")
def _(t):
    return D.markdown(blocks(t), "doc_id")


SECTIONS = f"""
WITH {CLEAN}, m AS (SELECT *, CASE WHEN label = 'paragraph_title' AND t <> '' THEN CASE WHEN regexp_matches(t, '^(?:{X.REFERENCES})$', 'i') THEN 'R' WHEN regexp_matches(t, '^(?:{X.METHODS})$', 'i') THEN 'M' ELSE 'O' END END AS mark FROM cl),
s AS (SELECT *, coalesce(last_value(CASE WHEN mark <> 'O' THEN mark END IGNORE NULLS) OVER w = 'R', false) AS refs, coalesce(last_value(mark IGNORE NULLS) OVER w = 'M', false) AS meth FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page, nth)),
p AS (SELECT *, CASE WHEN label = 'figure_title' AND t <> '' THEN chr(10) || '*' || t || '*' || chr(10) WHEN t <> '' AND (regexp_matches(t, '^(Figure|Fig\\.)\\s*\\d+\\s*[.|:]', 'i') OR regexp_matches(t, '{X.PANEL}')) THEN chr(10) || t || chr(10) END AS cap FROM s WHERE NOT refs),
o AS (SELECT *, coalesce(cap, {_MD}) AS md FROM p)
SELECT doc_id, coalesce(string_agg(md, chr(10) ORDER BY page, nth) FILTER (cap IS NULL AND NOT meth), '') AS main_text,
  string_agg(md, chr(10) ORDER BY page, nth) FILTER (cap IS NULL AND meth) AS methods,
  coalesce(string_agg(md, chr(10) ORDER BY page, nth) FILTER (cap IS NOT NULL), '') AS figure_captions FROM o WHERE md IS NOT NULL GROUP BY doc_id"""  # fmt: skip


@query("d4_sections", SECTIONS)
def _(t):
    return D.sections(blocks(t), "doc_id")


# No two figures of these pages stand near one another, so each is a cluster; tests
# have pages on which they do.
@query("d5_figure_regions", f"""
WITH {BLOCKS}, v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY nth) - 1 AS cluster FROM b WHERE label = 'image'),
c AS (SELECT doc_id, page, nth, y0, {_TRIM.format('content')} AS t FROM b WHERE label = 'figure_title')
SELECT v.doc_id, v.page, v.cluster, 50.0::DOUBLE AS x0, v.y0::DOUBLE AS y0, 550.0::DOUBLE AS x1, v.y1::DOUBLE AS y1, (500 * (v.y1 - v.y0))::DOUBLE AS covered,
  coalesce(arg_min(c.t, c.nth) FILTER (abs(c.y0 - v.y1) < 150), '') AS caption, (v.page * 10000 + floor(v.y0 + 0.5))::BIGINT AS doc_order
FROM v LEFT JOIN c ON c.doc_id = v.doc_id AND c.page = v.page AND c.t <> '' WHERE 500 * (v.y1 - v.y0) >= 6000 GROUP BY ALL""")  # fmt: skip
def _(t):
    return D.figure_regions(blocks(t), "doc_id")


@query("d6_figure_window", f"""
WITH {BLOCKS} SELECT a.doc_id, a.page, a.nth, a.y0, coalesce(max(CASE WHEN c.y1 < a.y0 THEN c.y1 END), 0) AS from_y
FROM b a JOIN b c ON a.doc_id = c.doc_id AND a.page = c.page WHERE a.label = 'figure_title' AND c.label = 'figure_title' GROUP BY 1, 2, 3, 4""")  # fmt: skip
def _(t):
    return D.figure_window(blocks(t), "doc_id")


# Counts of texts, as its SQL has it; d8_context_text gives the texts.
@query("d8_context", f"""
WITH {CLEAN} SELECT doc_id, count(*) FILTER (label = 'text') AS n FROM cl GROUP BY doc_id""")  # fmt: skip
def _(t):
    return D._clean(blocks(t), "doc_id").groupBy("doc_id").agg(F.count_if(F.col("label") == "text").alias("n"))


@query("d8_context_text", f"""
SELECT doc_id // 10 AS request, string_agg('## [Paper ' || doc_id || '] ' || title || chr(10) || chr(10) || main_text || CASE WHEN figure_captions <> '' THEN chr(10) || chr(10) || '### Figure Captions' || chr(10) || chr(10) || figure_captions ELSE '' END,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS context
FROM ({SECTIONS}) JOIN (SELECT doc_id, coalesce(source, '') AS title FROM documents) USING (doc_id) WHERE main_text <> '' GROUP BY 1""")  # fmt: skip
def _(t):
    # Requests ask for ten documents each, so that all are asked for.
    wanted = t("documents").select(F.expr("doc_id div 10").alias("request"), "doc_id", F.col("source").alias("title"))
    return D.context_of(D.sections(blocks(t), "doc_id"), "doc_id", wanted)


def reference_blocks(t) -> DataFrame:
    """Each document's lines as reference blocks: two of three open an entry."""
    d = t("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("block", "line"))
    link = F.when(F.col("block") % 2 == 0, F.concat(F.lit(" https://doi.org/10.1000/d"), F.col("doc_id").cast("string"), F.lit("."), F.col("block").cast("string"), F.lit(")."))).otherwise("")
    start = F.when(F.col("block") % 3 != 1, F.concat((F.col("block") + 1).cast("string"), F.lit(". "))).otherwise("")
    return d.select("doc_id", "block", F.concat(start, X.trimmed(F.col("line")), link).alias("content"))


@query("d7_references")
def _(t):
    return R.entries(reference_blocks(t), "doc_id")


# All lines of all documents, as f6_doi_in_all_lines, which has come first.
@query("f6_doi_in_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents)
SELECT doc_id, block, CASE WHEN block % 2 = 0 THEN '10.1000/d' || doc_id || '.' || block END AS doi FROM l""")  # fmt: skip
def _(t):
    return reference_blocks(t).select("doc_id", "block", R.doi(F.col("content")).alias("doi"))


@query("f6_doi_in_all_lines", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents)
SELECT doc_id, block, CASE WHEN block % 2 = 0 THEN '10.1000/d' || doc_id || '.' || block END AS doi FROM l""")  # fmt: skip
def _(t):
    return reference_blocks(t).select("doc_id", "block", R.doi(F.col("content")).alias("doi"))


@query("f8_document_metadata", f"""
WITH {BLOCKS}, n AS (SELECT doc_id, nullif({_TRIM.format("replace(replace(regexp_replace(" + _TRIM.format("content") + ", '[ \\t]+', ' ', 'g'), ' ' || chr(10), chr(10)), chr(10) || ' ', chr(10))")}, '') AS title FROM b WHERE label = 'doc_title')
SELECT DISTINCT documents.doc_id, title, NULL::VARCHAR AS doi FROM documents LEFT JOIN n USING (doc_id)""")  # fmt: skip
def _(t):
    return R.document_metadata(blocks(t), "doc_id")


# One prompt for each start of a URL; f17_whole_prompt has one for each domain.
@query("f17_prompt", """
SELECT url[1:24] AS site, string_agg('Source [' || page_id || ']:' || chr(10) || 'Title: ' || page_id || chr(10) || 'URL: ' || url || chr(10) || 'Content: ' || html, chr(10) || chr(10) ORDER BY page_id) AS prompt
FROM pages GROUP BY 1""")  # fmt: skip
def _(t):
    p = t("pages").select(F.substring("url", 1, 24).alias("site"), F.col("page_id").alias("nth"), F.col("page_id").cast("string").alias("title"), "url", F.col("html").alias("content"))
    return fusion.prompt(p, "Content", "site")


@query("f17_whole_prompt", r"""
SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS site,
  string_agg('Source [' || page_id || ']:' || chr(10) || 'Title: ' || page_id || chr(10) || 'URL: ' || url || chr(10) || 'Content: ' || html, chr(10) || chr(10) ORDER BY page_id) AS prompt
FROM pages GROUP BY 1""")  # fmt: skip
def _(t):
    p = t("pages").select(X.domain(F.col("url")).alias("site"), F.col("page_id").alias("nth"), F.col("page_id").cast("string").alias("title"), "url", F.col("html").alias("content"))
    return fusion.prompt(p, "Content", "site")


RESULTS = """u AS (SELECT 0 AS query_idx, page_id AS rank, url FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT 1, page_id, url FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT 2, -page_id, url FROM pages WHERE page_id % 5 = 0),
f AS (SELECT *, row_number() OVER (ORDER BY query_idx, rank) AS nth FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY query_idx, rank) = 1) ORDER BY query_idx, rank LIMIT 45)"""


def results(t) -> DataFrame:
    p = t("pages").select("page_id", "url")
    parts = [p.where(f"page_id % {m} = 0").select(F.lit(i).alias("query_idx"), (F.col("page_id") * s).alias("rank"), "url") for i, m, s in ((0, 2, 1), (1, 3, 1), (2, 5, -1))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("d9_fused_results", f"WITH {RESULTS} SELECT url, query_idx, row_number() OVER (ORDER BY contains(lower(url), 'cell.com') DESC, nth) AS nth FROM f")
def _(t):
    return fusion.reputable_first(fusion.fused(results(t), 45)).select("url", "query_idx", "nth")


@query("d10_judged_results", f"""
WITH {RESULTS}, g AS (SELECT * FROM f WHERE nth IN (SELECT doc_id FROM labels WHERE quality = 1) ORDER BY nth LIMIT 15)
SELECT url, row_number() OVER (ORDER BY contains(lower(url), 'cell.com') DESC, nth) AS nth FROM g""")  # fmt: skip
def _(t):
    relevant = t("labels").where("quality = 1").select(F.col("doc_id").alias("nth"))
    return fusion.judged(fusion.fused(results(t), 45), relevant).select("url", "nth")


def cited_answers(t) -> DataFrame:
    said = F.concat(F.lit("x ["), F.col("conv_id") % 7, F.lit("] y ["), F.col("turn") + 1, F.lit(", "), F.col("conv_id") % 4, F.lit("] z"))
    return t("conversations").select("conv_id", "turn", said.alias("answer"), F.array(*(F.concat(F.lit(f"s{i}-"), F.col("conv_id").cast("string")) for i in range(1, 5))).alias("sources"))


@query("f19_f20_pruned_citations", """
WITH c AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter([conv_id % 7, turn + 1, conv_id % 4], lambda n: n BETWEEN 1 AND 4))) AS cited FROM conversations),
m AS (SELECT *, lambda_free.p AS p FROM c, (SELECT 1 AS p) lambda_free)
SELECT conv_id, turn, CASE WHEN len(cited) = 0 THEN 'x [' || conv_id % 7 || '] y [' || turn + 1 || ', ' || conv_id % 4 || '] z'
  ELSE 'x [' || coalesce(nullif(list_position(cited, conv_id % 7), 0), conv_id % 7) || '] y [' || coalesce(nullif(list_position(cited, turn + 1), 0), turn + 1) || ',' || coalesce(nullif(list_position(cited, conv_id % 4), 0), conv_id % 4) || '] z' END AS answer,
  CASE WHEN len(cited) = 0 THEN ['s1-' || conv_id, 's2-' || conv_id, 's3-' || conv_id, 's4-' || conv_id] ELSE list_transform(cited, lambda n: 's' || n || '-' || conv_id) END AS sources FROM m""")  # fmt: skip
def _(t):
    return fusion.pruned(cited_answers(t)).drop("cited")


# RE2 has no look-behind: marks that a ! precedes are put aside first.
@query("f21_linked_citations", r"""
WITH x AS (SELECT conv_id, turn, list_transform([1, 2, 3, 4], lambda i: 's' || i || '-' || conv_id) AS urls,
  replace('x [' || conv_id % 7 || '] y [' || turn + 1 || ', ' || conv_id % 4 || '] z tel. [41555512' || conv_id || '34] ![1] [x, 2] [-2] [00' || turn % 3 || ']', '![', chr(1)) AS s FROM conversations),
m AS (SELECT *, string_split_regex(s, '\[[^\]]+\]') AS gaps, regexp_extract_all(s, '\[([^\]]+)\]', 1) AS marks FROM x),
l AS (SELECT *, list_transform(marks, lambda k: array_to_string(list_transform(list_transform(string_split(k, ','), lambda p: trim(p)), lambda p:
  CASE WHEN NOT regexp_matches(p, '^[+-]?\d') OR regexp_matches(p, '^(-|[+-]?0+($|\D))') THEN '[' || p || ']'
    WHEN length(regexp_extract(p, '^\+?0*(\d+)', 1)) < 10 AND urls[regexp_extract(p, '^\+?0*(\d+)', 1)::BIGINT] IS NOT NULL
    THEN '<citation href="' || urls[regexp_extract(p, '^\+?0*(\d+)', 1)::BIGINT] || '">' || p || '</citation>' ELSE '' END), '')) AS made FROM m)
SELECT conv_id, turn, replace(array_to_string(list_transform(generate_series(1, len(gaps)), lambda i: gaps[i] || coalesce(made[i], '')), ''), chr(1), '![') AS linked FROM l""")  # fmt: skip
def _(t):
    more = F.concat(F.lit(" tel. [41555512"), F.col("conv_id").cast("string"), F.lit("34] ![1] [x, 2] [-2] [00"), (F.col("turn") % 3).cast("string"), F.lit("]"))
    answers = cited_answers(t).withColumn("answer", F.concat("answer", more)).withColumnRenamed("sources", "urls")
    return fusion.linked_citations(answers).select("conv_id", "turn", "linked")


@query("d11_chat_sections", """
WITH s AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id AS chat_id, section::BIGINT AS section, arg_min(text, turn) FILTER (role = 'user') AS question, arg_min(text, turn) FILTER (role = 'assistant') AS answer,
  0::BIGINT AS source_messages, false AS thinking_ended, coalesce(arg_min(text, turn) FILTER (role = 'assistant'), '') AS shown
FROM s WHERE section > 0 GROUP BY 1, 2""")  # fmt: skip
def _(t):
    m = t("conversations").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))
    return fusion.chat_sections(m)


@query("f18_history_text", """
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM conversations GROUP BY conv_id""")  # fmt: skip
def _(t):
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.col("text"))
    rows = F.array_sort(F.collect_list(F.struct("turn", line.alias("s"))))
    return t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["s"]), "\n").alias("history"))


@query("f_text_functions", r"""
SELECT page_id, regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g'), '\.{2,}', '.', 'g') AS file_name,
  CASE WHEN length(html) > 250 THEN html[1:250] || '…' ELSE html END AS snippet,
  regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^www\.', '') AS domain, substr(sha256(url), 1, 16) AS hash,
  lower(regexp_replace(url, '^\s+|\s+$', '', 'g')) AS query_key, list_filter(string_split(url, '/'), lambda p: p <> '')[-1] AS last_part FROM pages""")  # fmt: skip
def _(t):
    u = F.col("url")
    return t("pages").select(
        "page_id", X.safe_file_name(u).alias("file_name"), X.shortened(F.col("html"), 250).alias("snippet"), X.domain(u).alias("domain"),
        V.short_hash(u).alias("hash"), X.query_key(u).alias("query_key"), X.last_segment(u).alias("last_part"),
    )


@query("f_citation_lines", """
SELECT p_partkey, p_brand || '. ' || p_name || '. ' || p_type || '. ' || p_size || '.' AS citation, 'https://doi.org/' || p_partkey AS url FROM part""")  # fmt: skip
def _(t):
    none = F.lit(None).cast("string")
    c = X.citation(F.array("p_brand"), F.col("p_name"), F.col("p_type"), F.col("p_size"), none)
    return t("part").select("p_partkey", c.alias("citation"), X.library_url(none, F.col("p_partkey").cast("string"), none).alias("url"))


@query("f40_f43_values", """
SELECT o_orderkey, CASE WHEN d // 31536000 >= 1 THEN (d // 31536000) || ' year' || CASE WHEN d // 31536000 = 1 THEN '' ELSE 's' END
   WHEN d >= 86400 THEN (d // 86400) || ' day' || CASE WHEN d // 86400 = 1 THEN '' ELSE 's' END ELSE d || ' seconds' END AS ago,
  floor(o_totalprice / 500000 * 100 + 0.5)::BIGINT AS percent, CASE WHEN floor(o_totalprice / 500000 * 100 + 0.5) >= 40 THEN 'green' WHEN floor(o_totalprice / 500000 * 100 + 0.5) >= 15 THEN 'amber' ELSE 'grey' END AS colour,
  least(greatest(o_custkey, 1), 500) AS clamped
FROM (SELECT *, epoch(TIMESTAMP '2000-01-01' - o_orderdate::TIMESTAMP)::BIGINT AS d0, abs(epoch(TIMESTAMP '2000-01-01' - o_orderdate::TIMESTAMP))::BIGINT AS d FROM orders)""")  # fmt: skip
def _(t):
    b = V.badge(F.col("o_totalprice") / 500000, 40, 15)
    then = F.lit("2000-01-01").cast("timestamp")
    return t("orders").select("o_orderkey", V.time_difference(F.col("o_orderdate").cast("timestamp"), then).alias("ago"), b["percent"].alias("percent"), b["colour"].alias("colour"), V.clamp(F.col("o_custkey"), 1, 500).alias("clamped"))


@query("f51_line_chunks", """
SELECT doc_id, i AS nth, array_to_string(string_split(text, chr(10))[i * 3 + 1:i * 3 + 3], chr(10)) AS part
FROM (SELECT doc_id, text, unnest(range(0, (len(string_split(text, chr(10))) + 2) // 3)) AS i FROM documents)""")  # fmt: skip
def _(t):
    return t("documents").select("doc_id", F.posexplode(V.line_chunks(F.col("text"), 3)).alias("nth", "part")).withColumn("nth", F.col("nth").cast("long"))


@query("f53_json_fields", """
SELECT event_id, json_extract_string(props, '$.' || (json_keys(props)[1])) AS first_value FROM events""")  # fmt: skip
def _(t):
    keys = F.json_object_keys("props")
    m = F.from_json("props", "map<string,string>")
    return t("events").select("event_id", F.try_element_at(m, F.get(keys, F.lit(0))).alias("first_value"))


@query("a6_min_max_spread", """
SELECT s_suppkey AS id, round((s_acctbal - (SELECT min(s_acctbal) FROM supplier)) / (SELECT max(s_acctbal) - min(s_acctbal) FROM supplier), 6) AS score FROM supplier""")  # fmt: skip
def _(t):
    s = graph.spread(t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")))
    return s.select("id", F.round("score", 6).alias("score"))


@query("w10_first_wins", """
SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")  # fmt: skip
def _(t):
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t("events").withColumn("n", F.row_number().over(w)).where("n = 1").select("user_id", "event_type", "event_id")


@query("w2_section_counters", f"""
WITH {BLOCKS} SELECT doc_id, page, nth, CASE WHEN label = 'figure_title' THEN 'figure ' WHEN label = 'paragraph_title' THEN 'text ' ELSE label || ' ' END || row_number() OVER (PARTITION BY doc_id, label ORDER BY page, nth) AS label FROM b""")  # fmt: skip
def _(t):
    n = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy("page", "nth"))
    return blocks(t).withColumn("n", n).select("doc_id", "page", "nth", X.section_label(F.col("label"), F.col("n")).alias("label"))


def changes(t) -> DataFrame:
    rows = E.timed(t("events")).where("event_type <> 'view'")
    return rows.select("event_id", "ts", F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("folder"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("path"), F.col("event_type").alias("type"))


_CHANGES = "c AS (SELECT event_id, ts, 'u' || (user_id % 50) AS folder, 'f' || (event_id % 3) AS path, event_type AS type FROM events WHERE event_type <> 'view')"


@query("t1_debounced", f"""
WITH {_CHANGES}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS brk FROM c WINDOW w AS (PARTITION BY folder ORDER BY ts, event_id)),
s AS (SELECT *, sum(brk) OVER (PARTITION BY folder ORDER BY ts, event_id) AS sid FROM g),
l AS (SELECT folder, sid, path, arg_max(type, (ts, event_id)) AS type, min(ts) AS a, max(ts) AS z FROM s GROUP BY 1, 2, 3)
SELECT folder, min(a) AS "from", max(z) + INTERVAL 1 HOUR AS "to", count(*) AS n_paths, list(path || '=' || type ORDER BY path) AS changes FROM l GROUP BY folder, sid""")  # fmt: skip
def _(t):
    found = E.debounced(changes(t), gap="1 hour")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from", "to")})


@query("t2_progress_state", """
SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value, min(ts) AS started_at, max(ts) AS updated_at FROM events GROUP BY user_id""")  # fmt: skip
def _(t):
    return E.progress(t("events"), "user_id", ["event_type", "value"])


@query("t3_queue_counters", "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'purchase') AS processed FROM events GROUP BY user_id")
def _(t):
    return E.counters(t("events"), "user_id", F.col("event_type") == "purchase")


@query("t6_gathered_messages", "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS message, count(*) AS parts FROM conversations GROUP BY conv_id")
def _(t):
    return E.gathered(t("conversations"), "conv_id", "text", "turn")


@query("t10_after_grace", "SELECT event_id FROM events WHERE ts >= (SELECT min(ts) FROM events) + INTERVAL 1 SECOND")
def _(t):
    start = t("events").agg(F.min("ts").cast("timestamp").alias("start"))
    return E.after_grace(E.timed(t("events")).crossJoin(F.broadcast(start)), F.col("start")).select("event_id")  # one row
