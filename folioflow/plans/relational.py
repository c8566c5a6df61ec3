"""Scans, predicates, joins, aggregates, windows, orders, sets and changes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import is_academic, is_reputable, loose_title, model_family, trimmed
from ..operators.references import duplicates
from ..sources import tables as T
from ..sources.tables import numbered_in_order
from .registry import query

# Fixed value: colours that papers get in turn.
COLOURS = 102


@query("s2_projected_scan", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t):
    return t("documents").select("doc_id", "lang", "source", "n_chars")


@query("s3_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def _(t):
    return t("orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice").limit(1)


@query("s4_find_first", "SELECT p_partkey, p_name FROM part WHERE p_size = 10 ORDER BY p_partkey LIMIT 1")
def _(t):
    return t("part").where("p_size = 10").orderBy("p_partkey").limit(1).select("p_partkey", "p_name")


@query("s18_page", """
SELECT vec_id, label, (SELECT count(*) FROM embeddings) AS total, (SELECT count(*) FROM embeddings) > 90 AS has_more
FROM embeddings ORDER BY vec_id LIMIT 50 OFFSET 40""")  # fmt: skip
def _(t):
    return T.page(t("embeddings").select("vec_id", "label"), "vec_id", 40, 50, 2000)


@query("p2_or_predicate", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0")
def _(t):
    return t("customer").where((F.col("c_mktsegment") == "BUILDING") | (F.col("c_acctbal") < 0)).select("c_custkey")


@query("p3_semi_join_in_list", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")  # fmt: skip
def _(t):
    some = t("customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return t("orders").join(some, "o_custkey", "left_semi").select("o_orderkey")


@query("p5_like_any_case", "SELECT p_partkey FROM part WHERE p_name ILIKE '%re%' OR p_type ILIKE '%re%'")
def _(t):
    return t("part").where(F.col("p_name").ilike("%re%") | F.col("p_type").ilike("%re%")).select("p_partkey")


@query("p8_within_ttl", """
SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAYS""")  # fmt: skip
def _(t):
    last = t("events").agg(F.max("ts").alias("now"))
    return t("events").crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("now") - F.expr("interval 90 days")).select("event_id")  # one row


@query("p9_not_blank", r"SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0")
def _(t):
    return t("documents").where(F.col("text").isNotNull() & (F.length(trimmed(F.col("text"))) > 0)).select("doc_id")


_ACADEMIC = " OR ".join(f"contains(url, '{d}')" for d in ("arxiv.org", "science.org", "nature.com", "springer.com", "ieee.org", "acm.org", "sciencedirect.com", "wiley.com", "plos.org", "cell.com", "pnas.org", "oup.com", "tandfonline.com", "mdpi.com", "frontiersin.org", "biorxiv.org", "medrxiv.org", "pubmed.ncbi.nlm.nih.gov", "researchgate.net"))
_REPUTABLE = " OR ".join(f"contains(lower(url), '{d}')" for d in ("nature.com", "science.org", "sciencedirect.com", "ieeexplore.ieee.org", "pnas.org", "nejm.org", "thelancet.com", "cell.com", "jamanetwork.com", "arxiv.org", "springer.com", "wiley.com"))


@query("p14_academic_pages", f"SELECT page_id, ({_ACADEMIC}) AS academic, ({_REPUTABLE}) AS reputable FROM pages")
def _(t):
    url = F.col("url")
    return t("pages").select("page_id", is_academic(F.lit(""), url).alias("academic"), is_reputable(url).alias("reputable"))


@query("p22_grouped_name_search", """
SELECT p_brand, list(p_name ORDER BY p_partkey) AS names FROM part
WHERE contains(lower(p_name), 'a') AND contains(lower(p_brand), '1') GROUP BY p_brand""")  # fmt: skip
def _(t):
    found = t("part").where(F.lower("p_name").contains("a") & F.lower("p_brand").contains("1"))
    groups = found.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("all"))
    return groups.select("p_brand", F.transform("all", lambda x: x["p_name"]).alias("names"))


@query("p23_loose_titles", """
SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS title_key, count(*) AS n FROM part
WHERE length(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')) >= 10 GROUP BY 1""")  # fmt: skip
def _(t):
    return t("part").groupBy(loose_title(F.col("p_name")).alias("title_key")).agg(F.count(F.lit(1)).alias("n")).where("length(title_key) >= 10")


@query("j1_inner_join", "SELECT l_orderkey, o_custkey, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 300000")
def _(t):
    o = t("orders").where("o_totalprice > 300000")
    return t("lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "o_custkey", "l_quantity")


@query("j3_anti_join", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _(t):
    return t("documents").join(t("labels"), "doc_id", "left_anti").select("doc_id")


@query("j4_semi_join_chain", """
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN
  (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name IN ('ASIA', 'EUROPE'))))""")  # fmt: skip
def _(t):
    n = t("nation").join(t("region").where(F.col("r_name").isin("ASIA", "EUROPE")), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    c = t("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("j6_cache_split", """
SELECT d.doc_id, l.quality IS NOT NULL AS hit, coalesce(l.quality, length(d.text) % 2)::INT AS value
FROM documents d LEFT JOIN labels l USING (doc_id)""")  # fmt: skip
def _(t):
    cached = t("labels").select("doc_id", F.col("quality").alias("value"))
    hit = t("documents").join(cached, "doc_id").select("doc_id", F.lit(True).alias("hit"), F.col("value").cast("int").alias("value"))
    miss = t("documents").join(cached, "doc_id", "left_anti").select("doc_id", F.lit(False).alias("hit"), (F.length("text") % 2).cast("int").alias("value"))
    return hit.unionByName(miss)


@query("j11_duplicate_detection", """
WITH p AS (SELECT p_partkey, p_brand || '/' || p_size || '/' || p_type AS doi, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
b AS (
  SELECT a.p_partkey AS new_id, b.p_partkey AS paper_id FROM p a JOIN p b ON lower(a.doi) = lower(b.doi)
  UNION ALL SELECT a.p_partkey, b.p_partkey FROM p a JOIN p b ON a.k = b.k WHERE length(a.k) >= 10)
SELECT new_id, min(paper_id) AS paper_id FROM b WHERE new_id <> paper_id GROUP BY new_id""")  # fmt: skip
def _(t):
    p = t("part").select(F.col("p_partkey").alias("paper_id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string"), "p_type").alias("doi"), F.col("p_name").alias("title"))
    return duplicates(p, p.withColumnRenamed("paper_id", "new_id"))


@query("j14_nearest_preceding", """
SELECT event_id, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_ts FROM events""")  # fmt: skip
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t("events").select("event_id", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w).alias("before_ts"))


@query("j15_version_as_of", """
SELECT s_suppkey, (SELECT max(p_size) FROM part WHERE p_size % 7 = 0 AND p_size <= s_nationkey + 10) AS version FROM supplier""")  # fmt: skip
def _(t):
    # Sizes of parts are the supported versions: a handful of distinct numbers.
    known = t("part").where("p_size % 7 = 0").agg(F.array_sort(F.collect_set("p_size")).alias("known"))
    rows = t("supplier").crossJoin(F.broadcast(known))  # one row
    return rows.select("s_suppkey", F.array_max(F.filter("known", lambda v: v <= F.col("s_nationkey") + 10)).alias("version"))


@query("j17_full_merge", """
WITH l AS (SELECT c_custkey, c_acctbal, c_custkey % 50 = 0 AS temp FROM customer WHERE c_custkey % 3 > 0),
s AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(l.c_custkey, s.c_custkey) AS c_custkey, CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE l.c_acctbal END AS c_acctbal
FROM l FULL JOIN s ON l.c_custkey = s.c_custkey WHERE s.c_custkey IS NOT NULL OR l.temp""")  # fmt: skip
def _(t):
    c = t("customer").select("c_custkey", "c_acctbal")
    return T.merged_lists(c.where("c_custkey % 3 > 0"), c.where("c_custkey % 2 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey", F.col("c_custkey") % 50 == 0)


@query("j19_names_with_default", """
SELECT s_suppkey, coalesce(n_name, 'unknown') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON s_nationkey = n_nationkey""")  # fmt: skip
def _(t):
    n = t("nation").where("n_regionkey < 3")
    return t("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("nation"))


@query("j20_names_or_ids", """
SELECT DISTINCT n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'CHINA') OR n_nationkey IN (1, 2)""")  # fmt: skip
def _(t):
    n = t("nation")
    return n.where(F.col("n_name").isin("FRANCE", "CHINA")).select("n_nationkey").union(n.where(F.col("n_nationkey").isin(1, 2)).select("n_nationkey")).distinct()


@query("a1_count_of_join", "SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def _(t):
    c = t("customer").where("c_acctbal > 5000").select("c_custkey")
    return t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


@query("a2_counts_with_zero", """
SELECT n_nationkey, n_name, count(s_suppkey) AS n FROM nation LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 8000) s ON s_nationkey = n_nationkey GROUP BY 1, 2""")  # fmt: skip
def _(t):
    n = t("supplier").where("s_acctbal > 8000").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    return t("nation").join(n, F.col("n_nationkey") == F.col("s_nationkey"), "left").select("n_nationkey", "n_name", F.coalesce("n", F.lit(0)).alias("n"))


@query("a4_collect_and_min", """
SELECT l_partkey, list_sort(list(DISTINCT l_suppkey)) AS suppliers, min(l_linenumber) AS least FROM lineitem GROUP BY l_partkey""")  # fmt: skip
def _(t):
    return t("lineitem").groupBy("l_partkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("suppliers"), F.min("l_linenumber").alias("least"))


@query("a11_index_stats", "SELECT label, count(*) AS vectors, min(len(embedding)) AS dim FROM embeddings GROUP BY label")
def _(t):
    return t("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.min(F.size("embedding")).cast("long").alias("dim"))


@query("a12_group_any", """
SELECT CASE WHEN contains(lower(p_name), 'gpt') THEN 'GPT' WHEN contains(lower(p_name), 'phi') THEN 'Phi' WHEN contains(lower(p_name), 'r1') THEN 'DeepSeek' ELSE 'Other' END AS family,
  bool_or(p_size > 45) AS any_large, count(*) AS n FROM part GROUP BY 1""")  # fmt: skip
def _(t):
    return t("part").groupBy(model_family(F.col("p_name")).alias("family")).agg(F.bool_or(F.col("p_size") > 45).alias("any_large"), F.count(F.lit(1)).alias("n"))


@query("a14_counts_by_reason", """
SELECT count(*) FILTER (l.doc_id IS NULL) AS unlabelled, count(*) FILTER (quality = 0) AS poor, count(*) FILTER (quality = 1) AS good
FROM documents d LEFT JOIN labels l USING (doc_id)""")  # fmt: skip
def _(t):
    rows = t("documents").select("doc_id").join(t("labels"), "doc_id", "left")
    return rows.agg(F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 0).alias("poor"), F.count_if(F.col("quality") == 1).alias("good"))


@query("a15_capabilities", """
SELECT user_id, bool_or(event_type = 'click') AS clicks, bool_or(event_type = 'purchase') AS buys FROM events GROUP BY user_id""")  # fmt: skip
def _(t):
    return t("events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "click").alias("clicks"), F.bool_or(F.col("event_type") == "purchase").alias("buys"))


@query("a17_methods_and_staleness", """
SELECT user_id, list_sort(list(DISTINCT event_type)) AS methods, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AS stale FROM events GROUP BY user_id""")  # fmt: skip
def _(t):
    now = t("events").agg(F.max("ts").alias("now"))
    rows = t("events").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("methods"), F.max("ts").alias("last"))
    return rows.crossJoin(F.broadcast(now)).select("user_id", "methods", (F.col("last") < F.col("now") - F.expr("interval 7 days")).alias("stale"))  # one row


@query("a18_members_per_folder", """
SELECT folder, count(*) AS papers FROM (SELECT source AS folder, doc_id FROM documents UNION SELECT 'src' || (doc_id % 20), doc_id FROM documents WHERE lang = 'de') GROUP BY folder""")  # fmt: skip
def _(t):
    d = t("documents")
    more = d.where("lang = 'de'").select(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("folder"), "doc_id")
    return d.select(F.col("source").alias("folder"), "doc_id").union(more).distinct().groupBy("folder").agg(F.count(F.lit(1)).alias("papers"))


@query("w1_rank", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return t("customer").select("c_custkey", F.row_number().over(w).alias("rank"))


@query("w7_colour_index", "SELECT n_nationkey, (dense_rank() OVER (ORDER BY n_regionkey) - 1) % 3 AS colour FROM nation")
def _(t):
    ids = numbered_in_order(t("nation").select("n_regionkey").distinct(), "nth", ["n_regionkey"])
    colours = ids.select("n_regionkey", ((F.col("nth") - 1) % 3).cast("int").alias("colour"))
    return t("nation").join(colours, "n_regionkey").select("n_nationkey", "colour")


@query("w7_paper_colours", "SELECT doc_id, ((dense_rank() OVER (ORDER BY doc_id) - 1) % 102)::INT AS colour FROM documents")
def _(t):
    ids = numbered_in_order(t("documents").select("doc_id").distinct(), "nth", ["doc_id"])
    return ids.select("doc_id", ((F.col("nth") - 1) % COLOURS).cast("int").alias("colour"))


@query("w8_last_turns", """
SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6""")  # fmt: skip
def _(t):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t("conversations").withColumn("n", F.row_number().over(w)).where("n <= 6").select("conv_id", "turn", "role")


@query("o2_top_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def _(t):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")


@query("o7_limit_then_filter", """
SELECT p_partkey, p_name FROM (SELECT * FROM part WHERE p_name ILIKE '%a%' ORDER BY p_partkey LIMIT 10) WHERE p_size > 10 ORDER BY p_partkey LIMIT 3""")  # fmt: skip
def _(t):
    ten = t("part").where(F.col("p_name").ilike("%a%")).orderBy("p_partkey").limit(10)
    return ten.where("p_size > 10").orderBy("p_partkey").limit(3).select("p_partkey", "p_name")


@query("o10_flag_then_name", """
SELECT n_name, n_regionkey = 1 AS flagged, row_number() OVER (ORDER BY n_regionkey = 1 DESC, n_name) AS nth FROM nation""")  # fmt: skip
def _(t):
    flagged = F.col("n_regionkey") == 1
    rows = t("nation").select("n_name", flagged.alias("flagged"), (~flagged).alias("rest"))
    return numbered_in_order(rows, "nth", ["rest", "n_name"]).select("n_name", "flagged", F.col("nth").cast("int").alias("nth"))


@query("o11_most_recent", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(t):
    return t("events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "ts")


@query("o13_canonical_key", """
SELECT o_custkey, '[' || string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) || ']' AS folder_key FROM orders GROUP BY o_custkey""")  # fmt: skip
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list("o_orderkey"))).alias("folder_key"))


@query("o14_number_in_name", """
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY regexp_extract(c_name, '(\\d+)', 1)::BIGINT, c_custkey) - 1 AS page FROM customer""".replace("\\\\", "\\"))  # fmt: skip
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.regexp_extract("c_name", r"(\d+)", 1).cast("long"), "c_custkey")
    return t("customer").select("c_custkey", (F.row_number().over(w) - 1).alias("page"))


@query("u5_union_of_kinds", """
SELECT 'customer' AS type, c_custkey AS id, c_acctbal AS score, NULL::BIGINT AS nation FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, s_nationkey FROM supplier""")  # fmt: skip
def _(t):
    c = t("customer").select(F.lit("customer").alias("type"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    s = t("supplier").select(F.lit("supplier").alias("type"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").cast("long").alias("nation"))
    return c.unionByName(s, allowMissingColumns=True)


@query("u8_merge_base_wins", """
WITH b AS (SELECT doc_id, quality AS v, 0 AS o FROM labels UNION ALL SELECT doc_id, -1, 1 FROM documents)
SELECT doc_id, v FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY o) = 1""")  # fmt: skip
def _(t):
    base = t("labels").select("doc_id", F.col("quality").alias("v"))
    return base.unionByName(t("documents").join(base, "doc_id", "left_anti").select("doc_id", F.lit(-1).alias("v")))


@query("k1_insert_with_ids", """
SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_custkey), c_name FROM customer WHERE c_nationkey = 5""")  # fmt: skip
def _(t):
    old = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = T.with_new_ids(t("customer").where("c_nationkey = 5").select("c_custkey", F.col("c_name").alias("name")), old, "id", ["c_custkey"])
    return old.unionByName(new.select("id", "name"))


@query("k2_upsert", """
WITH n AS (SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1),
o AS (SELECT user_id, event_type, 0.0::DOUBLE AS value, 0::BIGINT AS event_id FROM (SELECT DISTINCT user_id, 'view' AS event_type FROM events))
SELECT * FROM n UNION ALL SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = o.user_id AND n.event_type = o.event_type)""")  # fmt: skip
def _(t):
    new = t("events").select("user_id", "event_type", "value", "event_id")
    old = t("events").select("user_id").distinct().select("user_id", F.lit("view").alias("event_type"), F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("event_id"))
    return T.upserted(old, new, ["user_id", "event_type"], "event_id")


@query("k3_insert_or_ignore", """
SELECT c_nationkey AS k, 'customer' AS kind FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 9000)
UNION ALL SELECT n_nationkey, 'nation' FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)""")  # fmt: skip
def _(t):
    old = t("customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"), F.lit("customer").alias("kind")).distinct()
    return T.inserted_or_ignored(old, t("nation").select(F.col("n_nationkey").alias("k"), F.lit("nation").alias("kind")), ["k"])


@query("k5_conditional_update", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def _(t):
    return T.updated(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), F.col("o_orderstatus") == "O", o_totalprice=F.lit(0.0)).drop("o_orderstatus")


@query("k7_delete_after", """
SELECT conv_id, turn FROM conversations c WHERE turn <= (SELECT max(turn) // 2 FROM conversations x WHERE x.conv_id = c.conv_id)""")  # fmt: skip
def _(t):
    c = t("conversations").select("conv_id", "turn")
    return c.join(c.groupBy("conv_id").agg(F.expr("max(turn) div 2").alias("point")), "conv_id").where("turn <= point").select("conv_id", "turn")


@query("k8_delete_with_new_home", """
WITH p AS (SELECT doc_id, source AS folder FROM documents), l AS (SELECT doc_id, 'src' || (doc_id % 20) AS folder FROM documents WHERE lang = 'en'),
g AS (SELECT p.doc_id, min(l.folder) AS home FROM p LEFT JOIN l ON p.doc_id = l.doc_id AND l.folder <> 'src3' WHERE p.folder = 'src3' GROUP BY p.doc_id)
SELECT p.doc_id, coalesce(home, folder) AS folder FROM p LEFT JOIN g USING (doc_id) WHERE folder <> 'src3' OR home IS NOT NULL""")  # fmt: skip
def _(t):
    d = t("documents")
    papers = d.select("doc_id", F.col("source").alias("folder"))
    links = d.where("lang = 'en'").select("doc_id", F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("__l")).where("__l <> 'src3'")
    home = links.groupBy("doc_id").agg(F.min("__l").alias("home"))
    gone = F.col("folder") == "src3"
    out = papers.join(home, "doc_id", "left").where(~gone | F.col("home").isNotNull())
    return out.select("doc_id", F.when(gone, F.col("home")).otherwise(F.col("folder")).alias("folder"))


@query("k9_cascade_delete", """
WITH gc AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), go AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gc))
SELECT 'customer' AS t, count(*) AS n FROM customer WHERE c_nationkey <> 7
UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (FROM gc)
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM go)""")  # fmt: skip
def _(t):
    tables = {n: t(n) for n in ("customer", "orders", "lineitem")}
    out = T.cascade_deleted(tables, t("customer").where("c_nationkey = 7"), [("customer", "c_custkey", "orders", "o_custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey")])
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("t"), "n") for n, df in out.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
