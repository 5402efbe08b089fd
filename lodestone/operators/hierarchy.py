"""Document-level and wide-to-narrow retrieval over ranked chunks.

Hits have query_id, chunk_id, collection, path, seq_id, score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the boosts.
DOC_BOOST, DIR_BOOST, DIR_SHARE = 1.35, 1.15, 0.75
#: Characters that hits of a document begin alike with.
SIGNATURE = 50


def _top(groups: DataFrame, keys: tuple[str, ...], n: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round("sum", 9).desc(), *keys)
    return groups.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).select("query_id", *keys)


def wide_to_narrow(hits: DataFrame, *, limit: int = 10, containers: int = 3, pool: int | None = None) -> DataFrame:
    """Boosts hits in the best documents and directories; others fill up if fewer than ``limit`` remain.

    Containers are keyed by collection and path. The directory ``.`` (none) is no container.
    Of hits that fill up, those that begin like another of their document are left out.
    Cut to ``pool``, by default the limit.
    """
    rows = hits.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    docs = _top(rows.groupBy("query_id", "collection", "path").agg(F.sum("score").alias("sum")), ("collection", "path"), containers)
    dirs = _top(rows.filter("dir <> ''").groupBy("query_id", "collection", "dir").agg((F.sum("score") * DIR_SHARE).alias("sum")), ("collection", "dir"), containers)
    rows = rows.join(docs.withColumn("in_doc", F.lit(True)), ["query_id", "collection", "path"], "left").join(dirs.withColumn("in_dir", F.lit(True)), ["query_id", "collection", "dir"], "left")
    boost = F.when(F.col("in_doc"), DOC_BOOST).when(F.col("in_dir"), DIR_BOOST)
    rows = rows.withColumn("boosted", boost.isNotNull())
    enough = F.count_if(F.col("boosted")).over(Window.partitionBy("query_id")) >= limit
    begin = F.substring("text", 1, SIGNATURE) if "text" in hits.columns else F.col("chunk_id").cast("string")
    alike = Window.partitionBy("query_id", "collection", "path", begin).orderBy(F.col("boosted").desc(), F.round("score", 9).desc(), "chunk_id")
    rows = rows.withColumn("enough", enough).withColumn("turn", F.row_number().over(alike))
    kept = rows.filter(F.col("boosted") | (~F.col("enough") & (F.col("turn") == 1))).withColumn("score", F.col("score") * F.coalesce(boost, F.lit(1.0)))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= (pool or limit)).drop("in_doc", "in_dir", "enough", "turn")


def discover(hits: DataFrame, *, limit: int = 10) -> DataFrame:
    """The best chunk of each document, with how many of its chunks matched."""
    best = F.struct(F.round("score", 9), -F.col("chunk_id"))
    own = [c for c in ("chunk_id", "seq_id", "score", "title", "text", "headers") if c in hits.columns]
    docs = hits.groupBy("query_id", "collection", "path").agg(F.max_by(F.struct(*own), best).alias("best"), F.count("*").alias("match_count"))
    docs = docs.select("query_id", "collection", "path", "best.*", "match_count")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    return docs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def group_by_document(hits: DataFrame, *, cap: int = 30) -> DataFrame:
    """Documents by best score, ranked, with their chunks in order; of equal texts the best once.

    At most ``cap`` chunks of a query are shown; ``omitted`` counts those left out, and
    ``resume`` has the places to read on at.
    """
    w = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
    rows = hits
    if "text" in hits.columns:
        same = Window.partitionBy("query_id", "collection", "path", "text").orderBy(F.round("score", 9).desc(), "chunk_id")
        rows = hits.withColumn("turn", F.row_number().over(same)).filter("turn = 1")
    rows = rows.withColumn("turn", F.row_number().over(w)).withColumn("omitted", F.greatest(F.count("*").over(Window.partitionBy("query_id")) - cap, F.lit(0)))
    own = F.struct(*(c for c in ("seq_id", "chunk_id", "score", "headers", "text") if c in hits.columns))
    shown = F.col("turn") <= cap
    docs = rows.groupBy("query_id", "collection", "path").agg(
        F.max(F.when(shown, F.col("score"))).alias("score"), *([F.first("title").alias("title")] if "title" in hits.columns else []),
        F.array_sort(F.collect_list(F.when(shown, own))).alias("chunks"), F.max("omitted").alias("omitted"),
        F.array_sort(F.collect_list(F.when(~shown, F.col("seq_id")))).alias("resume"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "collection", "path")
    return docs.filter(F.size("chunks") > 0).withColumn("rank", F.row_number().over(order))
