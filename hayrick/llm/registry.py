"""The numbered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hayrick.llm import bpe, filter_audit, importance, jaccard_join, langid, mixing, neardup, pii, quality_model, quality_rules, records, sharding, topk
from hayrick.llm.textarrays import held_out
from hayrick.session import table


def op1_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others: query_id, rank, vec_id, score."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256.0)


def op2_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_odd_sketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by 80 % of its four-word shingles: doc_id, n_shingles, component_id, kept."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op4_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as records, written and read back through the offset index: doc_id, start, n_tokens, ids_crc32."""
    manifest = records.write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    read = records.read_records(manifest)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids_le32").alias("ids_crc32"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes: doc_id, size, source_size, target, taken."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and the bytes they decode to, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks).withColumn("n_bytes", F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("bigint"))
    decoded = bpe.decode(encoded, ranks, keep=("doc_id", "ids", "n_bytes"))
    listed = F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "UTF-8")
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_bytes")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and secrets of every document, n_private in all; n_discovered of them were found by induced patterns."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in pii.KINDS]
    base, spans = pii.listed(pii.KINDS), pii.listed((*pii.KINDS, "secret"))
    more = [F.size("secret").cast("bigint").alias("n_secret"), F.size("discovered").cast("bigint").alias("n_discovered")]
    total = sum((F.size(k).cast("bigint") for k in (*pii.KINDS, "secret")), F.lit(0).cast("bigint")).alias("n_private")
    return found.select("doc_id", *counts, F.sha2(F.encode(base, "UTF-8"), 256).alias("base_sha256"), spans.alias("spans"), *more, total)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a model of two thirds of them: doc_id, held_out, lang_pred, score, n_spans."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    found = langid.identify(docs, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a model of the labels of two thirds of them: doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")) & (F.col("quality") == 1))
    model = quality_model.train(docs.where(~held_out(F.col("doc_id"))), labels.select("doc_id"))
    scored = quality_model.score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw of 5 % of all documents towards the benchmark's n-grams: doc_id, n_features, weight, score, rank."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42, buckets=10_000)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source in each of their 120 orders: part, filter_order, step and seven counts."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by 85 % of its four-word shingles: doc_id, n_shingles, component_id."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def queries() -> dict:
    return {
        "op1_cover_tree_topk": op1_cover_tree_topk,
        "op2_kd_sharding": op2_kd_sharding,
        "op3_odd_sketch_dedup": op3_odd_sketch_dedup,
        "op4_binary_records": op4_binary_records,
        "op5_quality_rules": op5_quality_rules,
        "op6_pareto_mixing": op6_pareto_mixing,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_pii": op8_pii,
        "op9_language_id": op9_language_id,
        "op10_quality_model": op10_quality_model,
        "op11_importance_resampling": op11_importance_resampling,
        "op12_filter_audit": op12_filter_audit,
        "op13_jaccard_join": op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_cover_tree_topk": TOP_K_SQL,
        "op3_odd_sketch_dedup": NEAR_DUPLICATES_SQL,
        "op5_quality_rules": quality_rules.oracle_sql(),
        "op11_importance_resampling": IMPORTANCE_SQL,
        "op12_filter_audit": FILTER_AUDIT_SQL,
        "op13_jaccard_join": JACCARD_JOIN_SQL,
    }


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS t FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS root FROM g UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, min(r.root) AS component_id, g.doc_id = min(r.root) AS kept
FROM g JOIN r USING (doc_id) GROUP BY g.doc_id, g.s
"""

JACCARD_JOIN_SQL = NEAR_DUPLICATES_SQL.replace(">= 80 *", ">= 85 *").replace(", g.doc_id = min(r.root) AS kept", "")

FILTER_AUDIT_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
             || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
      FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT x AS filter_order FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x)
      UNION ALL SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE len(filter_order) < 5 AND NOT contains(filter_order, x)),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[:step - 1] AS earlier FROM o, range(1, 6) AS r(step) WHERE len(filter_order) = 5),
x AS (SELECT part, filter_order, step, own, n, good, toxic, fails, contains(fails, own) AS failing,
             len(list_intersect(string_split(fails, ''), string_split(earlier, ''))) > 0 AND fails <> '' AND earlier <> '' AS gone
      FROM s, c),
y AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (failing AND NOT gone), 0) AS removed,
             coalesce(sum(n) FILTER (failing AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
             coalesce(sum(good) FILTER (failing AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (failing AND NOT gone), 0) AS toxic_lost
      FROM x GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM y
"""

IMPORTANCE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY b) AS t FROM (
        SELECT b, list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b::BIGINT) AS c FROM range(256) AS r(b))),
texts AS (SELECT true AS own, doc_id, text FROM documents UNION ALL SELECT false, item_id, text FROM benchmark),
w AS (SELECT own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS t FROM texts),
g AS (SELECT own, doc_id, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]),
             list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS x FROM w),
n AS (SELECT own, doc_id, x, count(*) AS n FROM g GROUP BY own, doc_id, x),
h AS (SELECT x, xor(list_reduce(list_transform(range(strlen(x)), lambda i: ('0x' || hex(x)[2 * i + 1 : 2 * i + 2])::BIGINT),
             lambda a, b: xor(a >> 8, tab.t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT x FROM n), tab),
b AS (SELECT bucket, sum(n) FILTER (own) AS s, sum(n) FILTER (NOT own) AS t FROM n JOIN h USING (x) GROUP BY bucket),
v AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (sum(s) OVER ()::DOUBLE + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (sum(t) OVER ()::DOUBLE + 10000))))::BIGINT AS gain FROM b),
d AS (SELECT doc_id, sum(n) AS n, sum(n * gain) AS weight FROM n JOIN h USING (x) JOIN v USING (bucket) WHERE own GROUP BY doc_id),
e AS (SELECT w.doc_id, len(w.t) >= 20 AS able, coalesce(d.n, 0)::BIGINT AS n_features, coalesce(d.weight, 0)::BIGINT AS weight,
             coalesce(d.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (doc_id) WHERE w.own),
r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 5 * n // 100 THEN place END AS rank FROM r
"""

TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
