"""The queries opN_<name> over whole tables with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, fim, html_main, mixture, mtree, packing, prefix_trie, sharding, simhash, spotsigs, suffix_dedup, token_store, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(_table(spark, sf_dir, "documents"))


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_topk_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(_table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256")
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(_table(spark, sf_dir, "documents"), text_sha256=F.sha2(F.coalesce("text", F.lit("")), 256))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_suffix_dedup, op2_source_mixture, op3_simhash, op4_token_store, op5_topk_mtree,
        op6_spotsigs, op7_sharding, op8_vector_packing, op9_html_main, op10_toxicity_chain,
        op11_fim, op12_prefix_trie, op13_exact_dedup,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op2_source_mixture": MIXTURE_SQL, "op5_topk_mtree": TOP_K_SQL, "op11_fim": FIM_SQL, "op12_prefix_trie": TRIE_SQL, "op13_exact_dedup": EXACT_DEDUP_SQL}


MIXTURE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), x AS (SELECT *, 1000 * size // (size + 256) AS x FROM d
), per AS (
  SELECT source, sum(size)::DOUBLE AS words, sum(size * x)::DOUBLE AS sx, min(x)::DOUBLE AS low, max(x)::DOUBLE AS high,
    row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nth FROM x GROUP BY source
), w AS (SELECT *, (1 + nth % 3)::DOUBLE AS weight, 3 * words AS most, 3 * words / (1 + nth % 3) AS ratio FROM per
), r AS (
  SELECT *, sum(most) OVER up - most AS before, sum(weight) OVER up - weight AS before_w, sum(words) OVER () AS total, sum(weight) OVER () AS weights
  FROM w WINDOW up AS (ORDER BY ratio, nth)
), l AS (SELECT ratio, nth, (total - before) / (weights - before_w) AS level FROM r
), t AS (
  SELECT *, round(least(most, weight * coalesce((SELECT level FROM l WHERE ratio > level ORDER BY ratio, nth LIMIT 1), 'inf'::DOUBLE)), 6) AS target FROM r
), e AS (
  SELECT *, CASE WHEN words > 0 THEN target / words ELSE 0 END AS rate, CASE WHEN words > 0 THEN sx / words ELSE 0 END AS mean FROM t
), g AS (
  SELECT *, CASE WHEN rate > 0 AND greatest(high - mean, mean - low) > 0
    THEN greatest(0::DOUBLE, least(0.25::DOUBLE, 3::DOUBLE / rate - 1)) / greatest(high - mean, mean - low) ELSE 0 END AS tilt FROM e
), m AS (
  SELECT x.*, g.words, g.target, CASE WHEN words > 0 THEN CAST(floor(rate * (1 + tilt * (x.x - mean)) * 1000000 + 0.5::DOUBLE) AS BIGINT) ELSE 0 END AS micro,
    (('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM x JOIN g ON x.source IS NOT DISTINCT FROM g.source
), q AS (
  SELECT *, (micro % 1000000) / 1000000::DOUBLE AS p, target - sum(size * (micro // 1000000)) OVER (PARTITION BY source) AS left_words FROM m
), v AS (SELECT *, u * (1 - p) / (u * (1 - p) + (1 - u) * p) AS v FROM q
), o AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY v, doc_id NULLS FIRST, size) AS upto,
    count(*) OVER (PARTITION BY source, v, doc_id, size) AS n FROM v
)
SELECT doc_id, size, CAST(words AS BIGINT) AS source_size, target,
  CAST(size * (micro // 1000000 + CASE WHEN p > 0 AND upto - size * n / 2 <= left_words THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


EXACT_DEDUP_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size, sha256(text) AS text_sha256 FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text)
"""


# A node is named by its list of turns' digests; each node's ancestors are its smallest member's beginnings.
TRIE_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS lender, xor(list_reduce(list_prepend(4294967295::BIGINT,
    flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_transform(range(8), lambda i: (ord(x) >> i) & 1)))),
    lambda s, b: xor(s >> 1, xor(s & 1, b) * 3988292384)), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, place, digest, text FROM c JOIN o ON o.conv_id = c.lender AND place <= h
  UNION ALL SELECT c.conv_id, place + 8, digest, text FROM c JOIN o ON o.conv_id = c.conv_id AND place > h
), p AS (SELECT conv_id, CAST(row_number() OVER w AS BIGINT) AS depth, strlen(text) AS bytes, sha256(string_agg(digest, ',') OVER w) AS node FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), a AS (SELECT *, coalesce(lag(node) OVER (PARTITION BY conv_id ORDER BY depth), '') AS up FROM p UNION ALL SELECT conv_id, 0, 0, '', NULL FROM c
), n AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM a GROUP BY node, depth
), k AS (SELECT up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY up
), v AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON n.node = k.up
), s AS (
  SELECT a.node, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved
  FROM v JOIN a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.node
), l AS (SELECT conv_id, max(depth) AS depth FROM a GROUP BY conv_id
), e AS (SELECT node, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM a JOIN l USING (conv_id, depth) GROUP BY node)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM v JOIN s USING (node) LEFT JOIN e USING (node) LEFT JOIN v u ON v.up = u.node
"""


FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), l AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, ('0x' || h[1:8])::UBIGINT::BIGINT AS h1, ('0x' || h[9:16])::UBIGINT::BIGINT AS h2,
    ('0x' || h[17:24])::UBIGINT::BIGINT AS h3, ('0x' || h[25:32])::UBIGINT::BIGINT AS h4 FROM d
), c AS (SELECT *, len(lines) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM l
), p AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
