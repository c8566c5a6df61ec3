"""More functions, ingest, streams' folds and chunks of the library as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.vectors import strict_cosine
from ..operators import documents as D
from ..operators import fusion, graph, search
from ..operators import references as R
from ..sources import ocr
from ..streaming import events as E
from .registry import query
from .research import _coupled as coupled
from .research import BLOCKS, COS, EDGES, L1, SEED, SETS, asked_vectors, blocks, edges, first_vector, reference_blocks, vectors


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("f17b_numbered_sources", """
SELECT p_brand, string_agg(n || '. ' || p_name || CASE WHEN p_size % 3 > 0 THEN printf(' [score: %.3f]', p_size / 7) ELSE '' END || ' ' || p_type, chr(10) ORDER BY n) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) GROUP BY p_brand""")  # fmt: skip
def _(t):
    row = F.struct("p_partkey", F.col("p_name").alias("t"), F.when(F.col("p_size") % 3 > 0, F.col("p_size") / 7).alias("s"), F.col("p_type").alias("c"))
    rows = t("part").groupBy("p_brand").agg(F.array_sort(F.collect_list(row)).alias("r"))
    part = lambda f: F.transform("r", lambda x: x[f])
    return rows.select("p_brand", X.numbered_sources(part("t"), part("s"), part("c")).alias("lines"))


@query("f23_math_tags", """
SELECT doc_id, '<mathblock data-latex="' || to_base64(encode('a' || doc_id)) || '">.</mathblock> x <mathinline data-latex="' || to_base64(encode(lang || '+1')) || '">.</mathinline> \\$5 $ $ ' AS tagged FROM documents""")  # fmt: skip
def _(t):
    said = F.concat(F.lit("$$ a"), F.col("doc_id").cast("string"), F.lit("\n$$ x $ "), "lang", F.lit("+1$ \\$5 $ $ "))
    return t("documents").select("doc_id", X.math_tags(said).alias("tagged"))


@query("f25_json_answers", """
SELECT conv_id, turn, '{"turn": ' || turn || '}' AS object, CASE WHEN turn % 2 = 0 THEN [turn, turn + 3] END AS list FROM conversations""")
def _(t):
    n = F.col("turn").cast("string")
    answer = F.concat(F.lit('Sure: {"turn": '), n, F.lit("} - done"))
    numbers = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n["), n, F.lit(", "), (F.col("turn") + 3).cast("string"), F.lit("]\n```"))).otherwise(F.concat(F.lit("no list, "), n))
    return t("conversations").select("conv_id", "turn", X.json_object(answer).alias("object"), X.json_list(numbers).alias("list"))


_HINT = {k: " OR ".join(f"contains(n, {_q(h)})" for h in v) for k, v in (("e", X.EMBEDDING_HINTS), ("o", X.OCR_HINTS))}


@query("f30_capabilities", f"""
SELECT p_partkey, chat OR NOT (e OR o) AS chat, e AS embedding, o AS ocr
FROM (SELECT p_partkey, p_size % 7 = 0 AS chat, {_HINT['e']} AS e, {_HINT['o']} AS o
  FROM (SELECT *, lower(p_name || ' ' || CASE p_size % 4 WHEN 1 THEN 'Embedder' WHEN 2 THEN 'PaddleX' ELSE p_brand END) AS n FROM part))""")  # fmt: skip
def _(t):
    family = F.when(F.col("p_size") % 4 == 1, "Embedder").when(F.col("p_size") % 4 == 2, "PaddleX").otherwise(F.col("p_brand"))
    found = t("part").select("p_partkey", X.capabilities(F.col("p_name"), F.array(family), chat=F.col("p_size") % 7 == 0).alias("c"))
    return found.select("p_partkey", "c.*")


# The way to the blocks goes through two of the five wrapper keys and a list, in turn
# with all documents; blocks have their old and their new field names.
_WAYS = "['res', 'result', 'parsing_result', 'blocks', 'children']"


@query("f52_nested_blocks", f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, {_WAYS}[doc_id % 5 + 1] AS a, {_WAYS}[doc_id // 5 % 5 + 1] AS b, doc_id % 3 AS k FROM documents WHERE doc_id % 11 > 0)
SELECT doc_id, 0::BIGINT AS nth, 'text' AS label, text AS content, 7::BIGINT AS block_order, NULL::DOUBLE AS x0, NULL::DOUBLE AS y1 FROM d
UNION ALL SELECT doc_id, 1, 'reference', lang, NULL, 1.0, 4.0 FROM d
UNION ALL SELECT doc_id, 2, 'number', '12', NULL, NULL, NULL FROM d
UNION ALL SELECT doc_id, 3, '', '', NULL, NULL, NULL FROM d WHERE k > 0
UNION ALL SELECT doc_id, 3 + (k > 0)::BIGINT, 'last', 'true', NULL, 0.5, 2.0 FROM d WHERE k < 2""")  # fmt: skip
def _(t):
    said = lambda c: F.get_json_object(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("c"))), "$")
    quoted = lambda c: F.regexp_extract(said(c), r'(?s)^\{"c":(.*)\}$', 1)
    ways = F.array(*map(F.lit, ocr.WRAPPERS))
    n = F.col("doc_id")
    a, b = F.get(ways, (n % 5).cast("int")), F.get(ways, (F.floor(n / 5) % 5).cast("int"))
    own = F.concat(F.lit('"parsing_res_list":[{"block_label":"text","label":"x","block_content":'), quoted("text"), F.lit(',"block_order":7,"block_bbox":[1,2]},"no block"]'))
    near = F.concat(F.lit('"parsing_res_list":[{"label":"reference","rec_text":'), quoted("lang"), F.lit(',"bbox":[1,2,3,4,5]},{"block_label":null,"label":"number","content":12}]'))
    bare = F.when(n % 3 > 0, '{"parsing_res_list":[{}]},').otherwise('{"other":{"parsing_res_list":[{"label":"never"}]}},')
    last = F.when(n % 3 < 2, '{"parsing_res_list":[{"label":"last","text":true,"block_bbox":[0.5,0,1,2]}]}').otherwise('{"parsing_res_list":{"label":"never"}}')
    inner = F.concat(F.lit('{"'), b, F.lit('":[['), bare, last, F.lit("]],"), near, F.lit("}"))
    raw = F.when(n % 11 == 0, "{broken").otherwise(F.concat(F.lit('{"'), a, F.lit('":'), inner, F.lit(","), own, F.lit("}")))
    pages = t("documents").select("doc_id", F.lit(0).alias("page"), F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), raw.alias("raw"))
    return ocr.blocks_of_pages(pages, "doc_id").select("doc_id", F.col("nth").cast("long").alias("nth"), "label", "content", "block_order", "x0", "y1")


@query("f58_settings_key", """
SELECT c_custkey, '{"topN":' || c_custkey || ',"graphDepth":' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ',"segment":"' || c_mktsegment || '"' ELSE '' END || '}' AS settings FROM customer""")
def _(t):
    key = X.settings_key(F.col("c_custkey").alias("topN"), F.col("c_nationkey").alias("graphDepth"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("segment"))
    return t("customer").select("c_custkey", key.alias("settings"))


@query("f12_f16_links_and_authors", """
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN p_brand WHEN 2 THEN p_brand || ', ' || p_type WHEN 3 THEN p_brand || ', ' || p_type || ', ' || p_name ELSE p_brand || ', ' || p_type || ', ' || p_name || ' et al.' END AS authors,
  CASE p_partkey % 4 WHEN 0 THEN 'https://arxiv.org/abs/a' || p_partkey WHEN 1 THEN 'https://doi.org/10.1%2F' || p_partkey WHEN 2 THEN 'https://pubmed.ncbi.nlm.nih.gov/' || p_partkey ELSE 'u' END AS url,
  CASE p_partkey % 4 WHEN 1 THEN 'https://doi.org/10.1/' || p_partkey ELSE 'https://www.semanticscholar.org/paper/' || p_partkey END AS stored,
  'en.www' AS short, 'x' || p_partkey AS host FROM part""")  # fmt: skip
def _(t):
    n, k = F.col("p_partkey").cast("string"), F.col("p_partkey") % 4
    names = F.slice(F.array("p_brand", "p_type", "p_name", "p_brand"), F.lit(1), (F.col("p_partkey") % 5).cast("int"))
    some = lambda i, c: F.when(k == i, c)
    doi = some(1, F.concat(F.lit("10.1/"), n))
    return t("part").select(
        "p_partkey", X.author_line(names).alias("authors"), X.paper_url(some(0, F.concat(F.lit("a"), n)), doi, some(2, n), F.lit("u")).alias("url"),
        X.stored_url(doi, n).alias("stored"), X.short_domain(F.lit("en.www.org")).alias("short"), X.bare_host(F.concat(F.lit("https://www.x"), n, F.lit(".co.uk/p"))).alias("host"),
    )


@query("f22_f26_answers", """
SELECT conv_id, turn, '<think>' || turn || '</think> <a> </a>' AS thinking, 'o' || turn AS output, ['one', 't' || turn, 'three'] AS suggested, turn + 2 AS files_changed, turn % 5 AS lines_deleted,
  CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END AS files_added FROM conversations""")  # fmt: skip
def _(t):
    n = F.col("turn").cast("string")
    change = X.change_counts(
        F.concat(F.lit(" "), (F.col("turn") + 2).cast("string"), F.lit(" files changed, 3 insertions(+)"), F.when(F.col("turn") % 5 > 0, F.concat(F.lit(", "), (F.col("turn") % 5).cast("string"), F.lit(" deletions(-)"))).otherwise("")),
        F.when(F.col("turn") % 3 == 0, "A\tx\nM\ty").otherwise("M\ty"),
    )
    lines = F.concat(F.lit("- item\none\n\n1. two\n t"), n, F.lit("\nthree\nfour"))
    rows = t("conversations").select("conv_id", "turn", X.closed_thinking(F.concat(F.lit("<think>"), n)).alias("thinking"), X.output_of(F.concat(F.lit("a<output>o"), n, F.lit("</output>b"))).alias("output"), X.suggestions(lines).alias("suggested"), change.alias("c"))
    return rows.select("conv_id", "turn", "thinking", "output", "suggested", F.col("c.files").alias("files_changed"), F.col("c.lines_deleted").alias("lines_deleted"), F.col("c.files_added").alias("files_added"))


@query("f49_versions", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size * 10 + p_partkey % 10 END AS version, coalesce(p_size % 3 > 0 AND p_size * 10 + p_partkey % 10 >= 128, false) AS fits FROM part")
def _(t):
    said = F.when(F.col("p_size") % 3 == 0, "n/a").otherwise(F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 10).cast("string"), F.lit(".1")))
    number = V.version_number(said)
    return t("part").select("p_partkey", number.alias("version"), F.coalesce(number >= 128, F.lit(False)).alias("fits"))


@query("d12_ingest", """
WITH p AS (SELECT p_partkey AS paper_id, p_partkey % 4 AS folder_id, '10.5/' || p_partkey AS doi, p_name AS title FROM part),
u AS (SELECT c_custkey AS new_id, c_custkey % 4 AS folder_id, c_custkey % 3 AS k, c_custkey // 2 AS of FROM customer),
m AS (SELECT lower(regexp_replace(lower(title), '[^a-z0-9]', '', 'g')) AS key, min(paper_id) AS paper_id FROM p GROUP BY 1 HAVING length(key) >= 10),
h AS (SELECT u.new_id, u.folder_id, u.k, CASE WHEN u.k = 2 THEN d.paper_id ELSE m.paper_id END AS paper_id
  FROM u LEFT JOIN p d ON d.paper_id = u.of LEFT JOIN m ON m.key = regexp_replace(lower(d.title), '[^a-z0-9]', '', 'g'))
SELECT new_id, CASE WHEN h.paper_id IS NULL THEN 'full' ELSE ['metadata', 'first_page', 'full'][k + 1] END AS stage,
  CASE WHEN h.paper_id IS NULL THEN 'new' WHEN p.folder_id = h.folder_id OR (h.paper_id + 1) % 4 = h.folder_id THEN 'duplicate_same_folder' ELSE 'duplicate' END AS outcome, h.paper_id
FROM h LEFT JOIN p ON p.paper_id = h.paper_id""")  # fmt: skip
def _(t):
    papers = t("part").select(F.col("p_partkey").alias("paper_id"), (F.col("p_partkey") % 4).alias("folder_id"), F.concat(F.lit("10.5/"), F.col("p_partkey").cast("string")).alias("doi"), F.col("p_name").alias("title"))
    links = papers.select("paper_id", ((F.col("paper_id") + 1) % 4).alias("folder_id"))
    c = t("customer").select(F.col("c_custkey").alias("new_id"), (F.col("c_custkey") % 4).alias("folder_id"), (F.col("c_custkey") % 3).alias("k"), F.expr("c_custkey div 2").alias("of"))
    # The paper that an upload is of shows at one stage: its title in the metadata, its
    # title on the first page, or its DOI after all pages.
    c = c.join(papers.select(F.col("paper_id").alias("of"), F.upper("title").alias("known")), "of", "left")
    none = F.lit(None).cast("string")
    title = lambda k: F.when(F.col("k") == k, F.col("known"))
    doi = F.when(F.col("k") == 2, F.concat(F.lit("10.5/"), F.col("of").cast("string")))
    uploads = c.select("new_id", "folder_id", title(0).alias("metadata_title"), title(1).alias("first_title"), none.alias("first_doi"), none.alias("title"), doi.alias("doi"))
    return R.ingested(papers, links, uploads)


_START = r"(?s)^\s*([^0-9]{0,2}?)(\d{1,4})\.\s*(.*)$"
_TRIMMED = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_JOIN = r"""CASE WHEN a = '' THEN b WHEN b = '' THEN a WHEN a LIKE '%-' AND regexp_matches(b, '^[a-zA-Z]') THEN a[:-2] || b
  WHEN regexp_matches(a, '(?:https?://|doi:|10\.\d{4,})$') THEN a || b ELSE a || ' ' || b END"""


@query("d7_stitched_entries", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS block FROM documents),
b AS (SELECT doc_id, block, CASE WHEN block % 3 <> 1 THEN (block + 1) || '. ' ELSE '' END || {_TRIMMED.format('line')} || CASE WHEN block % 2 = 0 THEN ' https://doi.org/10.1000/d' || doc_id || '.' || block || ').' ELSE '' END AS c FROM l),
n AS (SELECT doc_id, block, regexp_replace({_TRIMMED.format('c')}, '[ \\t]+', ' ', 'g') AS c FROM b),
s AS (SELECT *, CASE WHEN regexp_matches(c, '{_START}') THEN regexp_extract(c, '{_START}', 2)::INT END AS number,
  CASE WHEN regexp_matches(c, '{_START}') THEN {_TRIMMED.format(f"regexp_extract(c, '{_START}', 3)")} ELSE c END AS said
  FROM n WHERE c <> '' AND NOT regexp_matches(c, '(?i)^\\s*Citation:\\s+\\S')),
e AS (SELECT *, count(number) OVER (PARTITION BY doc_id ORDER BY block) AS e FROM s),
g AS (SELECT doc_id, greatest(e, 1) AS e, arg_min(number, block) FILTER (number IS NOT NULL) AS ref_number,
  coalesce(list(said ORDER BY block DESC) FILTER (e = 0), []) AS orphans, list(said ORDER BY block) FILTER (e > 0) AS own FROM e GROUP BY doc_id, greatest(e, 1) HAVING count(number) > 0),
f AS (SELECT *, len(orphans) > 0 AND own[1] = '' AS bare FROM g),
t AS (SELECT doc_id, e - 1 AS nth, ref_number,
  list_filter(list_concat(CASE WHEN bare THEN orphans[:-2] ELSE orphans END, [list_reduce(list_prepend(CASE WHEN bare THEN orphans[-1] ELSE '' END, own), lambda a, b: {_JOIN})]), lambda x: x <> '') AS parts FROM f)
SELECT doc_id, nth, ref_number, {_TRIMMED.format("array_to_string(parts, ' ')")} AS text FROM t""")  # fmt: skip
def _(t):
    return R.stitched(reference_blocks(t), "doc_id")


@query("d14_text_chunks")
def _(t):
    return D.text_chunks(t("documents").select("doc_id", "text"), "doc_id")


@query("d4_all_outputs")
def _(t):
    refs = reference_blocks(t).select("doc_id", F.col("block").alias("nth"), "content")
    return D.all_sections(blocks(t), "doc_id", refs)


@query("d6_first_figure")
def _(t):
    captioned = blocks(t).withColumn("content", F.when(F.col("label") == "figure_title", F.concat(F.lit("Figure "), (F.col("page") + 1).cast("string"), F.lit(". "), "content")).otherwise(F.col("content")))
    return D.first_figures(captioned, "doc_id")


_PIECES = """SELECT conv_id, turn, role, to_json(struct_pack(turn := turn, role := coalesce(role, ''))) AS line FROM conversations"""


@query("t4_reassembled_lines", f"""
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS nth, line FROM ({_PIECES})""")
def _(t):
    line = F.to_json(F.struct("turn", F.coalesce("role", F.lit("")).alias("role")))
    whole = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("all"))
    # Cut after every seven characters, as a network might.
    parts = whole.select("conv_id", F.posexplode(F.regexp_extract_all("all", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "part"))
    return E.lines_of(parts, "conv_id", "part", "seq")


@query("t5_output_between_tags", """
WITH w AS (SELECT conv_id, string_agg('<' || coalesce(role, '') || '>' || coalesce(text, ''), '' ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS m FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, substr(m, strpos(m, '<assistant>') + 11) AS rest FROM w WHERE strpos(m, '<assistant>') > 0)
SELECT conv_id, CASE WHEN strpos(rest, '<user>') > 0 THEN left(rest, strpos(rest, '<user>') - 1) ELSE rest END AS output, strpos(rest, '<user>') > 0 AS over FROM r""")  # fmt: skip
def _(t):
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("x"))
    whole = whole.select("conv_id", F.array_join(F.transform("x", lambda x: F.concat(F.lit("<"), x["role"], F.lit(">"), x["text"])), "").alias("all"))
    # Cut after every seven characters, so tags go over the cuts.
    parts = whole.select("conv_id", F.posexplode(F.regexp_extract_all("all", F.lit("(?s).{1,7}"), F.lit(0))).alias("seq", "part"))
    return E.output_of(parts, "conv_id", "part", "seq", "<assistant>", "<user>")


@query("t8_graph_progress", f"""
WITH {EDGES}, r AS (SELECT DISTINCT dst AS id FROM e WHERE src = {SEED}), c AS (SELECT DISTINCT src AS id FROM e WHERE dst = {SEED}),
l1 AS (SELECT id FROM r UNION SELECT id FROM c), l1s AS (SELECT id FROM l1 WHERE id <> {SEED}),
l2 AS (SELECT DISTINCT x AS id FROM (SELECT dst AS x FROM e WHERE src IN (FROM l1s) UNION ALL SELECT src FROM e WHERE dst IN (FROM l1s)) WHERE x <> {SEED} AND x NOT IN (FROM l1s))
SELECT 2 AS phase, 'Found ' || count(*) || ' references.' AS message, NULL::INT AS total, NULL::INT AS current FROM r
UNION ALL SELECT 3, 'Found ' || count(*) || ' citations.', NULL, NULL FROM c
UNION ALL SELECT 4, 'Processing, (' || count(*) || ' papers)...', 2, 1 FROM l1s
UNION ALL SELECT 4, 'Processing, (' || count(*) || ' papers)...', 2, 2 FROM l2""")  # fmt: skip
def _(t):
    e = edges(t)
    return graph.progress_rows(e, graph.layers(e, SEED, 2, None), SEED, 2)


@query("t9_polled_merge", """
WITH l AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_orderkey % 40 = 0 AS temp FROM orders WHERE o_orderkey % 3 > 0),
s AS (SELECT o_orderkey AS id, 'done' AS status FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(l.id, s.id) AS id, CASE WHEN l.temp THEN l.status ELSE coalesce(s.status, l.status) END AS status FROM l FULL JOIN s ON l.id = s.id WHERE s.id IS NOT NULL OR l.temp""")  # fmt: skip
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    fresh = o.where("id % 2 = 0").withColumn("status", F.lit("done"))
    return E.polled(o.where("id % 3 > 0"), fresh, "id", F.col("id") % 40 == 0)


@query("k10_sse_messages", """
SELECT event_id AS id, 'id: ' || event_id || chr(10) || 'event: folder-change' || chr(10) || 'data: {"user_id":' || user_id || ',"type":"' || event_type || '"}' || chr(10) || chr(10) AS message FROM events""")  # fmt: skip
def _(t):
    return E.sse_messages(t("events").select("event_id", "user_id", F.col("event_type").alias("type")), "folder-change")


@query("p11_dual_threshold", f"""
WITH {SETS}, {L1}, {coupled('l1')} SELECT id, round(bc, 6) AS bc, round(cc, 6) AS cc, round(0.5 * bc + 0.5 * cc, 6) AS score FROM k
WHERE bc >= 0.002 AND cc >= 0.002 ORDER BY 0.5 * bc + 0.5 * cc DESC, id LIMIT 40""")  # fmt: skip
def _(t):
    e = edges(t)
    rows = graph.ranked(graph.coupling(e, graph.layers(e, SEED, 1), SEED), 40, 0.002, 0.002)
    return rows.select("id", *(F.round(c, 6).alias(c) for c in ("bc", "cc", "score")))


@query("p7_folders_if_given", f"""
SELECT q.vec_id AS query_id, a.vec_id AS id, round({COS}, 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id % 100 = 0 AND a.vec_id % 2 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, a.vec_id) <= 20""")  # fmt: skip
def _(t):
    """As ``v10_chunks_each``, with no folder given: no folder is left out."""
    v = vectors(t).withColumn("paper_id", F.col("id") % 50)
    papers = v.select("paper_id").distinct().withColumn("folder", F.col("paper_id") % 25)
    chunks = v.where("id % 2 = 0").select("id", "paper_id", F.col("id").cast("string").alias("content"))
    return search.search_chunks(papers, chunks, v.select("id", "vector"), asked_vectors(t)).select("query_id", "id", F.round("score", 6).alias("score"))


# Searches of a request meet in thirty pages: three lists with pages in common.
_REQUESTS = """u AS (SELECT page_id // 30 AS request, 0 AS query_idx, page_id AS rank, url FROM pages WHERE page_id % 2 = 0
  UNION ALL SELECT page_id // 30, 1, page_id, url FROM pages WHERE page_id % 3 = 0 UNION ALL SELECT page_id // 30, 2, -page_id, url FROM pages WHERE page_id % 5 > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY query_idx, rank) AS nth FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY request, url ORDER BY query_idx, rank) = 1) QUALIFY nth <= 20)"""


def _fused_requests(t):
    p = t("pages").select(F.expr("page_id div 30").alias("request"), "page_id", "url")
    parts = [p.where(c).select("request", F.lit(i).alias("query_idx"), (F.col("page_id") * s).alias("rank"), "url") for i, c, s in ((0, "page_id % 2 = 0", 1), (1, "page_id % 3 = 0", 1), (2, "page_id % 5 > 0", -1))]
    return fusion.fused(parts[0].unionByName(parts[1]).unionByName(parts[2]), 20, "request")


@query("d9_fused_each", f"WITH {_REQUESTS} SELECT request, url, query_idx, row_number() OVER (PARTITION BY request ORDER BY contains(lower(url), 'cell.com') DESC, nth) AS nth FROM f")
def _(t):
    return fusion.reputable_first(_fused_requests(t), "request").select("request", "url", "query_idx", "nth")


@query("d10_judged_each", f"""
WITH {_REQUESTS}, j AS (SELECT request, nth FROM f WHERE request % 3 > 0 AND nth % (request % 3) = 0),
g AS (SELECT f.* FROM f JOIN j USING (request, nth) UNION ALL SELECT * FROM f WHERE nth <= 3 AND request NOT IN (SELECT request FROM j)),
m AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY request ORDER BY nth) <= 15)
SELECT request, url, row_number() OVER (PARTITION BY request ORDER BY contains(lower(url), 'cell.com') DESC, nth) AS nth FROM m""")  # fmt: skip
def _(t):
    rows = _fused_requests(t)
    # The judge names none for a third of the requests, all or half of the others'.
    named = rows.where("request % 3 > 0").where("nth % (request % 3) = 0").select("request", "nth")
    return fusion.judged(rows, named, by=("request",)).select("request", "url", "nth")


@query("v10_chunks_each", f"""
SELECT q.vec_id AS query_id, a.vec_id AS id, a.vec_id % 50 AS paper_id, round({COS}, 6) AS score FROM embeddings a, embeddings q
WHERE q.vec_id % 100 = 0 AND a.vec_id % 2 = 0 AND (a.vec_id % 50) % 25 IN (SELECT n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'CHINA') UNION SELECT 3)
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, a.vec_id) <= 20""")  # fmt: skip
def _(t):
    return _named_chunks(t, asked_vectors(t)).select("query_id", "id", "paper_id", F.round("score", 6).alias("score"))


@query("v3_strict_cosine_pairs", f"SELECT a.vec_id AS id, round({COS}, 6) AS score FROM embeddings a JOIN embeddings q ON q.vec_id = a.vec_id + 1")
def _(t):
    v = vectors(t)
    both = v.join(v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other")), "id")
    return both.select("id", F.round(strict_cosine(F.col("vector"), F.col("other")), 6).alias("score"))


@query("f8_metadata_with_dois", f"""
WITH {BLOCKS}, n AS (SELECT doc_id, min(page) AS page FROM b WHERE page < 3 AND page >= doc_id % 4 AND label <> 'doc_title' GROUP BY doc_id)
SELECT DISTINCT d.doc_id, '10.1000/d' || d.doc_id || '.' || n.page AS doi FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id WHERE d.doc_id IN (SELECT doc_id FROM b)""")  # fmt: skip
def _(t):
    # From a page on, which may lie beyond the first three, all blocks but titles have a DOI.
    said = F.concat(F.coalesce("content", F.lit("")), F.lit(" https://doi.org/10.1000/d"), F.col("doc_id").cast("string"), F.lit("."), F.col("page").cast("string"), F.lit(")."))
    rows = blocks(t).withColumn("content", F.when((F.col("page") >= F.col("doc_id") % 4) & (F.col("label") != "doc_title"), said).otherwise(F.col("content")))
    return R.document_metadata(rows, "doc_id").select("doc_id", "doi")


@query("v10_chunks_by_folder_names", f"""
SELECT a.vec_id AS id, a.vec_id % 50 AS paper_id, round({COS}, 6) AS score FROM embeddings a, embeddings q
WHERE q.vec_id = 0 AND a.vec_id % 2 = 0 AND (a.vec_id % 50) % 25 IN (SELECT n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'GERMANY', 'CHINA') UNION SELECT 3)
ORDER BY {COS} DESC, id LIMIT 20""")  # fmt: skip
def _(t):
    return _named_chunks(t, first_vector(t)).select("id", "paper_id", F.round("score", 6).alias("score"))


def _named_chunks(t, asked):
    names = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    v = vectors(t).withColumn("paper_id", F.col("id") % 50)
    papers = v.select("paper_id").distinct().withColumn("folder", F.col("paper_id") % 25)
    chunks = v.where("id % 2 = 0").select("id", "paper_id", F.col("id").cast("string").alias("content"))
    return search.search_chunks(papers, chunks, v.select("id", "vector"), asked, names, ["FRANCE", "GERMANY", "CHINA"], [3], 20)


