"""Rank fusion, reranking arithmetic and content deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the fusion.
RRF_K = 60
FIRST_BONUS, NEXT_BONUS = 0.05, 0.02
DUAL_BOOST = 1.35


def _share(rank: Column) -> Column:
    """What a list gives to its entry of 0-based ``rank``."""
    return 1 / (RRF_K + rank) + F.when(rank == 0, FIRST_BONUS).when(rank <= 2, NEXT_BONUS).otherwise(0.0)


def fuse_lists(lists: DataFrame, *, candidates: int = 20) -> DataFrame:
    """Fuses any number of lists (query_id, chunk_id, kind, rank, score) of the kinds fts and vec; ranks are 1-based.

    A chunk's score sums what each of its entries gives, whatever list it is of; a list that has a
    chunk twice gives twice. Chunks in lists of both kinds are boosted. Of several ranks and scores
    of a kind the best count, for ties by lexical rank, then vector rank, and for output. One
    aggregation, whatever the number of lists. Cut to ``candidates``.
    """
    of = lambda kind, x: F.when(F.col("kind") == kind, F.col(x))
    total = F.sum(_share(F.col("rank") - 1)).alias("total")
    one = lists.groupBy("query_id", "chunk_id").agg(F.max(of("fts", "score")).alias("fts_score"), F.min(of("fts", "rank")).alias("fts_rank"), F.max(of("vec", "score")).alias("vec_score"), F.min(of("vec", "rank")).alias("vec_rank"), total, F.count("*").alias("entries"))
    dual = F.col("fts_rank").isNotNull() & F.col("vec_rank").isNotNull()
    order = Window.partitionBy("query_id").orderBy(F.round("rrf_score", 9).desc(), F.col("fts_rank").asc_nulls_last(), F.col("vec_rank").asc_nulls_last(), F.col("chunk_id"))
    out = one.withColumn("rrf_score", F.col("total") * F.when(dual, DUAL_BOOST).otherwise(1.0)).withColumn("dual", dual)
    return out.withColumn("rrf_rank", F.row_number().over(order)).filter(F.col("rrf_rank") <= candidates).drop("total")


def as_list(hits: DataFrame, kind: str) -> DataFrame:
    """A ranked list of ``kind`` (fts or vec) as ``fuse_lists`` takes it."""
    return hits.select("query_id", "chunk_id", F.lit(kind).alias("kind"), F.col(f"{kind}_rank").alias("rank"), "score")


def reciprocal_rank_fusion(fts: DataFrame, vec: DataFrame, *, candidates: int = 20) -> DataFrame:
    """Fuses one list (query_id, chunk_id, score, fts_rank) and one (…, vec_rank)."""
    return fuse_lists(as_list(fts, "fts").unionByName(as_list(vec, "vec")), candidates=candidates).drop("entries")


def min_max(score: str, constant: float, by: str = "query_id") -> Column:
    """Scales to 0..1 within a query; a constant list becomes ``constant``."""
    w = Window.partitionBy(by)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high > low, (F.col(score) - low) / (high - low)).otherwise(constant)


def blend_rerank(hits: DataFrame, scores: DataFrame, *, reranker_only: bool = False, dual_floor: bool = True) -> DataFrame:
    """Blends fused hits with (query_id, chunk_id, rerank_score) half and half; a missing score is 0.

    Hits of both lists don't fall below 0.8 of their fused share, plus 0.15.
    """
    both = hits.join(scores.select("query_id", "chunk_id", "rerank_score"), ["query_id", "chunk_id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
    both = both.withColumn("n_rrf", min_max("rrf_score", 1.0)).withColumn("n_rerank", min_max("rerank_score", 0.5))
    mean = 0.5 * F.col("n_rrf") + 0.5 * F.col("n_rerank")
    if dual_floor:
        mean = F.when(F.col("dual"), F.greatest(mean, 0.8 * F.col("n_rrf")) + 0.15).otherwise(mean)
    return both.withColumn("score", F.col("n_rerank") if reranker_only else mean)


def dedup_by_text(hits: DataFrame) -> DataFrame:
    """Of hits with the same stripped text, the best of each query."""
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    w = Window.partitionBy("query_id", F.sha2(bare, 256)).orderBy(F.round("score", 9).desc(), "chunk_id")
    return hits.withColumn("turn", F.row_number().over(w)).filter("turn = 1").drop("turn")


def final_rank(hits: DataFrame, limit: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
