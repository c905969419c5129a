"""The queries of this subpackage, one for each operator, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bitfile, bpe, classifier, embedding_dedup, hard_negatives, html_extract, language_model, minhash, packing, prefix_trie, quality_rules, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract_pages(_table(spark, sf_dir, "pages"), "page_id", "url")
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")))
    base = sum(quality_rules.BITS[x] for x in quality_rules.BASE)
    return rows.select(
        "doc_id",
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed"),
        "kept",
        "failed",
        "n_wordy_lines",
        "n_loud_chars",
        "n_separators",
    )


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
g AS (SELECT r, i, w[i:i+4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
c AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
  len(lines)::BIGINT AS n_wordy_lines, coalesce(list_sum(list_transform(list_filter(lines, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')), lambda x: length(x))), 0)::BIGINT AS n_loud_chars,
  len(list_filter(w, lambda x: x = '|'))::BIGINT AS n_separators FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 10 AS b0, 100 * n_repeat_words > 20 * n_words AS b1, 100 * n_separators > 20 * n_words AS b2,
  100 * n_loud_chars > 40 * word_chars AS b3, 100 * n_symbols > 10 * word_chars AS b4, 100 * n_dup_lines > 50 * n_wordy_lines AS b5,
  word_chars > 20 * n_words OR word_chars < 2 * n_words AS b6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed,
  NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5) AS kept,
  (b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT + 64 * b6::INT)::BIGINT AS failed,
  n_wordy_lines, n_loud_chars, n_separators FROM b
"""


def op7_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitfile.read_documents(spark, bitfile.write_tokens(_table(spark, sf_dir, "documents")))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rows = classifier.score(docs, classifier.fit(docs, classifier.learnable(labels)), "doc_id")
    return rows.select("doc_id", (classifier.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.document_tokens(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(_table(spark, sf_dir, "conversations"))


#: Prefixes as lists, every node joined to the conversations' labels at its depth; the CRC is worked out bit by bit.
OP11_SQL = """
WITH own AS (SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS v
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, v, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda u, z: xor(u >> 1, (u & 1) * 3988292384))), 4294967295) % 6 AS h FROM own),
b AS (SELECT h.c, CASE WHEN h.h = 0 THEN [] ELSE coalesce(o.v[1:h.h], []) END || h.v[h.h + 1:] AS v FROM h LEFT JOIN own o ON o.c = h.c - h.c % 100),
p AS (SELECT c, len(v) AS n, unnest(range(0, len(v) + 1)) AS depth, v FROM b),
q AS (SELECT c, n, depth, CASE WHEN depth = 0 THEN [] ELSE v[1:depth] END AS k FROM p),
m AS (SELECT c, n, depth, min(c) OVER (PARTITION BY depth, k) AS node, CASE WHEN depth = 0 THEN 0 ELSE length(k[depth].t) END AS len FROM q),
d AS (SELECT node AS conv_id, depth, count(*) AS n_convs, any_value(len) AS len, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = depth), '')) AS ends_sha256 FROM m GROUP BY node, depth),
e AS (SELECT d.*, m.node AS parent_conv_id FROM d LEFT JOIN m ON m.c = d.conv_id AND m.depth = d.depth - 1),
f AS (SELECT e.*, coalesce(k.n, 0) AS n_children FROM e LEFT JOIN (SELECT parent_conv_id AS pc, depth - 1 AS pd, count(*) AS n FROM e WHERE depth > 0 GROUP BY ALL) k ON k.pc = e.conv_id AND k.pd = e.depth),
s AS (SELECT m.node, m.depth AS at, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.len) AS saved FROM f JOIN m ON m.c = f.conv_id AND m.depth <= f.depth GROUP BY m.node, m.depth)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.node = f.conv_id AND s.at = f.depth
"""


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return ann.nearest(rows).withColumnRenamed("id", "vec_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v")))


OP13_SQL = """
WITH r AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
s AS (SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.id % 100 = 0 AND b.id <> a.id AND len(a.v) = len(b.v)),
p AS (SELECT * FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_best_fit_packing, op2_bpe_encode_decode, op3_language_model, op4_html_extraction, op5_quality_rules, op6_minhash_near_dedup, op7_bit_packed_tokens, op8_quality_classifier, op9_embedding_near_dedup, op10_token_counts, op11_conversation_prefix_trie, op12_nearest_neighbours, op13_hard_negatives]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_quality_rules": OP5_SQL, "op11_conversation_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
