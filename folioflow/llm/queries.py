"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import round_trip
from .cdc_dedup import repeats_of
from .chat_format import formatted_pairs
from .decontamination import contamination
from .divergence import divergence
from .exact_dedup import duplicate_groups
from .media import stored_features
from .mixing import mix
from .ngram_join import ngram_components
from .pii import pseudonymised
from .suffix_dedup import removed_repeats
from .toxicity import scored_documents
from .whitening import whitened


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark, sf_dir):
    return ngram_components(documents(spark, sf_dir))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe_round_trip(spark, sf_dir):
    return round_trip(documents(spark, sf_dir), tokenizer_path())


def op3_cdc_substrings(spark, sf_dir):
    return repeats_of(documents(spark, sf_dir))


def op4_chat_format(spark, sf_dir):
    return formatted_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_exact_dedup(spark, sf_dir):
    return duplicate_groups(documents(spark, sf_dir))


def op6_source_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir))


def op7_pii_pseudonyms(spark, sf_dir):
    return pseudonymised(documents(spark, sf_dir))


def op8_suffix_array(spark, sf_dir):
    return removed_repeats(documents(spark, sf_dir))


def op9_media_columns(spark, sf_dir):
    return stored_features(documents(spark, sf_dir))


def op10_toxicity(spark, sf_dir):
    return scored_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_source_divergence(spark, sf_dir):
    return divergence(documents(spark, sf_dir))


def op12_embedding_whitening(spark, sf_dir):
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_decontamination(spark, sf_dir):
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_bpe_round_trip": op2_bpe_round_trip,
        "op3_cdc_substrings": op3_cdc_substrings,
        "op4_chat_format": op4_chat_format,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_source_mix": op6_source_mix,
        "op7_pii_pseudonyms": op7_pii_pseudonyms,
        "op8_suffix_array": op8_suffix_array,
        "op9_media_columns": op9_media_columns,
        "op10_toxicity": op10_toxicity,
        "op11_source_divergence": op11_source_divergence,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_chat_format": OP4, "op5_exact_dedup": OP5, "op6_source_mix": OP6, "op11_source_divergence": OP11, "op13_decontamination": OP13}


OP4 = r"""
WITH la AS (
  SELECT conv_id, max(turn) AS lt FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), fo AS (
  SELECT conv_id - 1 AS conv_id, coalesce(text, '') AS other
  FROM conversations WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) = 1
), a AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations
), r AS (
  SELECT c.conv_id, c.turn, coalesce(c.role, '') AS role,
         coalesce(CASE WHEN c.role = 'assistant' AND c.turn = lt AND other IS NOT NULL THEN other ELSE c.text END, '') AS text
  FROM conversations c LEFT JOIN la ON c.conv_id = la.conv_id LEFT JOIN fo ON c.conv_id = fo.conv_id
), b AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM r
), n AS (
  SELECT a.conv_id, coalesce(min(CASE WHEN a.role <> b.role OR a.text <> b.text THEN a.k END) - 1, max(a.k)) AS n_common
  FROM a JOIN b ON a.conv_id = b.conv_id AND a.k = b.k GROUP BY a.conv_id
), ra AS (
  SELECT conv_id, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s,
         '-' || (length(role) + 5) || ',' || CASE WHEN role = 'assistant' THEN '' ELSE '-' END || (length(text) + 8) AS m FROM a
), rb AS (
  SELECT conv_id, k, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS s,
         '-' || (length(role) + 5) || ',' || CASE WHEN role = 'assistant' THEN '' ELSE '-' END || (length(text) + 8) AS m FROM b
), xa AS (
  SELECT conv_id, any_value(n_common) AS n_common,
         coalesce(string_agg(s, '' ORDER BY k) FILTER (k <= n_common), '') AS prompt,
         coalesce(string_agg(s, '' ORDER BY k) FILTER (k > n_common), '') AS chosen,
         coalesce(string_agg(m, ',' ORDER BY k) FILTER (k > n_common), '') AS chosen_mask
  FROM ra JOIN n USING (conv_id) GROUP BY conv_id
), xb AS (
  SELECT conv_id, coalesce(string_agg(s, '' ORDER BY k) FILTER (k > n_common), '') AS rejected,
         coalesce(string_agg(m, ',' ORDER BY k) FILTER (k > n_common), '') AS rejected_mask
  FROM rb JOIN n USING (conv_id) GROUP BY conv_id
)
SELECT conv_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask FROM xa JOIN xb USING (conv_id)
"""

OP5 = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM n
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 15))::BIGINT AS seeded
  FROM documents
), s AS (
  SELECT source, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r, sum(size)::BIGINT AS source_size,
         ceil(count(*) / 4096)::BIGINT AS shards
  FROM d GROUP BY source
), w AS (
  SELECT *, [3.0, 1.0, 2.0][(r % 3 + 1)::INT]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS lim FROM s
), f AS (
  SELECT *, lim / weight AS full_at FROM w
), g AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
             - coalesce(sum(lim) OVER (ORDER BY full_at, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY full_at, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM f
), t AS (
  SELECT *, least(lim, coalesce(max(CASE WHEN lev <= full_at THEN lev END) OVER (), full_at) * weight) AS target FROM g
), b AS (
  SELECT *, round(sum(target) OVER () / 16)::BIGINT AS seats, sum(target) OVER () AS votes, count(*) OVER () AS n FROM t
), b1 AS (
  SELECT *, CASE WHEN votes > 0 THEN target / votes ELSE 0 END AS share FROM b
), b2 AS (
  SELECT *, floor(share * seats + 0.5)::BIGINT AS base, ceil(2 * share * n)::BIGINT + 2 AS slack FROM b1
), b3 AS (
  SELECT *, greatest(0, base - slack) AS low, seats - sum(greatest(0, base - slack)) OVER () AS more FROM b2
), q AS (
  SELECT r, count(*) AS won FROM (
    SELECT r, more, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, r) AS nth
    FROM (SELECT r, more, target, unnest(range(low, base + slack + 1)) AS k FROM b3 WHERE target > 0)
  ) WHERE nth <= more GROUP BY r
), p AS (
  SELECT b3.*, low + coalesce(won, 0) AS source_blocks FROM b3 LEFT JOIN q USING (r)
), e AS (
  SELECT d.doc_id, d.size, d.seeded, p.r, p.source_size, p.target, p.source_blocks, d.seeded % p.shards AS shard
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), h AS (
  SELECT r, shard, any_value(source_blocks) AS seats, sum(size)::BIGINT AS z FROM e GROUP BY r, shard
), h1 AS (
  SELECT *, count(*) OVER (PARTITION BY r) AS n, CASE WHEN sum(z) OVER (PARTITION BY r) > 0 THEN z / sum(z) OVER (PARTITION BY r) ELSE 0 END AS share FROM h
), h2 AS (
  SELECT *, floor(share * seats + 0.5)::BIGINT AS base, ceil(2 * share * n)::BIGINT + 2 AS slack FROM h1
), h3 AS (
  SELECT *, greatest(0, base - slack) AS low, seats - sum(greatest(0, base - slack)) OVER (PARTITION BY r) AS more FROM h2
), hq AS (
  SELECT r, shard, count(*) AS won FROM (
    SELECT r, shard, more, row_number() OVER (PARTITION BY r ORDER BY z / (2 * k + 1) DESC, shard) AS nth
    FROM (SELECT r, shard, more, z, unnest(range(low, base + slack + 1)) AS k FROM h3 WHERE z > 0)
  ) WHERE nth <= more GROUP BY r, shard
), l AS (
  SELECT h3.r, h3.shard, z, least((low + coalesce(won, 0)) * 16, 2 * z)::BIGINT AS words FROM h3 LEFT JOIN hq USING (r, shard)
)
SELECT doc_id, size, source_size, target,
       ((CASE WHEN z > 0 THEN words // z ELSE 0 END) * size + greatest(0, least(size, words
         - (CASE WHEN z > 0 THEN words // z ELSE 0 END) * z
         - coalesce(sum(size) OVER (PARTITION BY r, shard ORDER BY seeded, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM e JOIN l USING (r, shard)
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), x AS (
  SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n) AS c FROM x GROUP BY ALL HAVING count(*) >= 30
), l AS (
  SELECT lang, count(*) AS v, sum(c) AS total FROM k GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), n AS (
  SELECT lang, source, term, sum(n) AS n FROM x JOIN k USING (lang, term) GROUP BY ALL
), a AS (
  SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n,
         (1 + (1000000000::HUGEINT * (coalesce(n.n, 0) + 5)) // (coalesce(a.total, 0) + 5 * l.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.c + 5)) // (l.total + 5 * l.v))::BIGINT AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN a ON a.lang = g.lang AND a.source = g.source
  LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN f ON f.lang = g.lang AND f.source = g.source AND f.item = h.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), s AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[p:p + 9], ' ') AS words FROM s
), k AS (
  SELECT DISTINCT k FROM g
), a AS (
  SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d CROSS JOIN k WHERE len(w) >= k
), o AS (
  SELECT a.r, a.p, a.k, g.item FROM (SELECT r, p, k, array_to_string(w[p:p + k - 1], ' ') AS words FROM a) a JOIN g ON a.k = g.k AND a.words = g.words
), h AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT r, p, k FROM o)) GROUP BY r
), n AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM o) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
