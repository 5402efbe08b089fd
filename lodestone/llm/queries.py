"""The registered queries of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import infill, ranking
from lodestone.llm.decontam import benchmark_hits
from lodestone.llm.forest import near_vectors
from lodestone.llm.licenses import oracle_sql as _license_sql
from lodestone.llm.licenses import scan_licenses
from lodestone.llm.minhash import near_texts
from lodestone.llm.mixing import mix_sources
from lodestone.llm.neighbours import score_quality
from lodestone.llm.pii import find_personal_data
from lodestone.llm.substrings import remove_repeats
from lodestone.llm.tokens import token_counts
from lodestone.llm.toxicity import score_toxicity
from lodestone.llm.urls import judge_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # a package of the machine: without it only this query is missing

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"))


def op3_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(_table(spark, sf_dir, "documents"), n=3, hundredths=85)


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages")).drop("score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_table(spark, sf_dir, "documents")).drop("redacted")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.fill_in_middle(_table(spark, sf_dir, "documents"))
    digests = {"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(infill.restored(F.col("output"), F.col("form")).cast("binary"), 256)}
    return out.withColumns(digests).drop("output")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {f.__name__: f for f in (op1_token_counts, op2_source_mix, op3_vector_forest, op4_minhash, op5_substrings, op6_url_filter, op7_license_scan, op8_decontamination, op9_personal_data, op10_toxicity, op11_fill_in_middle, op12_quality, op13_ranked_search)} | {"pipeline": corpus_pipeline.run}


_WORD = r"[^\x20\x09-\x0D]+"

_ORACLE = {
    "op3_vector_forest": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE sqrt(list_dot_product(e, e)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT e.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) k ON k.a = e.vec_id
JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = e.vec_id""",
    "op4_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.b FROM r JOIN l ON r.y = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS m FROM r GROUP BY x) c ON c.x = d.doc_id""",
    "op5_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM w WHERE len(w) >= 20),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM s),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM f WHERE k > 1),
t AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS j FROM w),
k AS (SELECT t.doc_id, string_agg(t.t, ' ' ORDER BY t.j) AS x FROM t ANTI JOIN c ON t.doc_id = c.doc_id AND t.j = c.j GROUP BY t.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(r.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.x, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id) r ON r.doc_id = w.doc_id""",
    "op8_decontamination": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM q),
s AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
m AS (SELECT s.doc_id, s.n, s.i, q.item_id FROM s JOIN q ON s.n = q.n AND s.g = q.g),
h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
e AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(e.n, 0)::BIGINT AS n_items, sha256(coalesce(e.x, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators whose results it can express; the others are tested against brute force.

    Not so: token counts (merges), the mix and the URL models (Spark's hashes), and the
    trained models of personal data, toxicity and quality.
    """
    return _ORACLE | {"op7_license_scan": _license_sql(), "op11_fill_in_middle": infill.oracle_sql(), "op13_ranked_search": ranking.oracle_sql()}
