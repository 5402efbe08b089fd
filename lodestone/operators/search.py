"""Ranked search over query strings: lexical tiers, vectors, fusion, reranking, deduplication; and what builds on it.

Queries are a DataFrame (query_id, query, vector[, lexical][, session_id]): ``vector`` is the
embedded query (null: lexical only), ``lexical`` a match expression that takes the place of the
query's own, ``session_id`` whose seen chunks are left out. Lexical tiers are
written one after the other; the rest up to the last cut is one lazy plan, and texts join after
the candidates are cut: few hits are sent to the chunks, so that texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.functions.text import tokens
from lodestone.operators import fusion, hierarchy, lexical, sessions
from lodestone.operators.postings import PostingIndex, search_blocks
from lodestone.operators.similarity import vector_scan
from lodestone.operators.tables import written

#: Hits of all queries together, up to which they are sent to the chunks; above that both are dealt by chunk.
SENT_HITS = 200_000
#: Takes hits (query_id, query, chunk_id, path, text), gives (query_id, chunk_id, rerank_score).
Reranker = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """``chunks`` (chunk_id, collection, path, seq_id, title, text[, headers]), their index and vectors (chunk_id, embedding)."""

    chunks: DataFrame
    index: PostingIndex
    vectors: DataFrame
    stem: bool = False


@dataclass(frozen=True)
class Options:
    """Cuts and switches of a search; ``where`` filters chunks by collection, title and path."""

    limit: int = 10
    fts_limit: int = 50
    vec_limit: int = 50
    candidates: int = 20
    containers: int = 3
    where: Column | None = None
    kind: str = "cosine"
    rerank: Reranker | None = None
    reranker_only: bool = False
    tiers: Callable[[str], list[str]] | None = None
    #: More lists for a query: takes (query_id, query), gives (query_id, kind lex, vec or hyde, text).
    expand: Callable[[DataFrame], DataFrame] | None = None
    #: Embeds what ``expand`` adds: takes (query_id, query), gives these with ``vector``.
    embed: Callable[[DataFrame], DataFrame] | None = None
    #: Seen chunks (session_id, collection, path, seq_id), left out of their own session only.
    seen: DataFrame | None = field(default=None)


def seen_pairs(corpus: Corpus, queries: DataFrame, seen: DataFrame) -> DataFrame:
    """(query_id, chunk_id) that a query's session has seen."""
    places = corpus.chunks.select("chunk_id", *sessions.CHUNK)
    own = seen.select("session_id", *sessions.CHUNK).distinct().join(queries.select("query_id", "session_id"), "session_id")
    return own.join(places, sessions.CHUNK).select("query_id", "chunk_id").distinct()


def exclusion_stats(corpus: Corpus, queries: DataFrame, options: Options) -> DataFrame:
    """(query_id, chunks, documents): how much of the filtered corpus each query's session has seen."""
    inside = corpus.chunks.filter(options.where) if options.where is not None else corpus.chunks
    pairs = seen_pairs(replace(corpus, chunks=inside), queries, options.seen)
    counts = pairs.join(inside.select("chunk_id", "collection", "path"), "chunk_id").groupBy("query_id").agg(F.count("*").alias("chunks"), F.count_distinct("collection", "path").alias("documents"))
    return queries.select("query_id").join(counts, "query_id", "left").na.fill(0, ["chunks", "documents"])


def lexical_search(corpus: Corpus, queries: DataFrame, options: Options = Options(), excluded: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, tier, score, fts_rank): tiers from strict to loose, filters before any cut.

    One tier after the other is searched and written; a looser one asks only for the queries
    that have found fewer than the quorum so far. The driver reads how many tiers there are.
    """
    asked = written(lexical.compile_queries(queries, tiers=options.tiers, stem=corpus.stem), "compiled")
    allowed = corpus.chunks.filter(options.where).select("chunk_id") if options.where is not None else None
    tiers = [r[0] for r in asked.select("tier").distinct().orderBy("tier").collect()]
    found = None
    for tier in tiers or [0]:
        mine = asked.filter(F.col("tier") == tier)
        if found is not None:
            enough = found.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n")).filter(F.col("n") >= lexical.QUORUM)
            mine = mine.join(enough, "query_id", "left_anti")
        hits = search_blocks(corpus.index, mine, limit=options.fts_limit, allowed=allowed, excluded=excluded)
        best = written(lexical.ranked(hits, options.fts_limit, "tier_rank", ("query_id", "tier")).drop("tier_rank"), "tier")
        found = best if found is None else found.unionByName(best)
    return lexical.gated_tiers(found, limit=options.fts_limit)


def vector_search(corpus: Corpus, queries: DataFrame, options: Options = Options(), excluded: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, vec_rank) over the chunks that the filter leaves."""
    vectors = corpus.vectors
    if options.where is not None:
        vectors = vectors.join(corpus.chunks.filter(options.where).select("chunk_id"), "chunk_id", "left_semi")
    asked = queries.filter("vector IS NOT NULL").select("query_id", F.col("vector").alias("query"))
    return vector_scan(vectors, asked, limit=options.vec_limit, kind=options.kind, excluded=excluded)


def expanded(queries: DataFrame, expander: Callable[[list[str]], list[str]], size: int = 16) -> DataFrame:
    """(query_id, kind, text) of queries (query_id, query): what a model's answers name, in its lines ``lex:``, ``vec:`` and ``hyde:``.

    ``expander`` takes a batch of query texts and gives one answer for each; it runs in tasks, ``size`` queries at a time.
    """
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                said = [parse.expansions(x or "") for x in expander([q or "" for q in part.column("query").to_pylist()])]
                rows = [(i, k, t) for i, own in enumerate(said) for k, t in own]
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], ["query_id", "kind", "text"])

    return queries.select("query_id", "query").mapInArrow(run, f"query_id {kind}, kind string, text string")


def _more_lists(corpus: Corpus, queries: DataFrame, options: Options, excluded: DataFrame | None) -> DataFrame:
    """The lists that an expansion adds, as ``fuse_lists`` takes them; each searched like a query of its own."""
    rows = written(options.expand(queries.select("query_id", "query")).filter(F.length("text") > 0).distinct(), "expanded")
    own = rows.select(F.struct("query_id", "kind", "text").alias("query_id"), F.col("text").alias("query"), "kind")
    left_out = excluded.join(own.select(F.col("query_id.query_id").alias("own"), F.col("query_id").alias("id")), F.col("own") == F.col("query_id")).select(F.col("id").alias("query_id"), "chunk_id") if excluded is not None else None
    fts = lexical_search(corpus, own.filter("kind = 'lex'").select("query_id", "query"), options, left_out)
    out = fusion.as_list(fts, "fts")
    if options.embed is not None:
        vec = vector_search(corpus, options.embed(own.filter("kind <> 'lex'").select("query_id", "query")), options, left_out)
        out = out.unionByName(fusion.as_list(vec, "vec"))
    return out.withColumn("query_id", F.col("query_id.query_id"))


def overlap_reranker(hits: DataFrame) -> DataFrame:
    """A reranker without a model: the share of the query's distinct tokens that the text has."""
    asked, own = F.array_distinct(tokens(F.col("query"))), tokens(F.col("text"))
    share = F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, own)) / F.size(asked)).otherwise(0.0)
    return hits.select("query_id", "chunk_id", share.alias("rerank_score"))


def _reranked(hits: DataFrame, queries: DataFrame, rerank: Reranker) -> DataFrame:
    return rerank(hits.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "chunk_id", "path", "text"))


def hybrid_search(corpus: Corpus, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """The best chunks of each query by fused ranks, blended with a reranker's scores if one is given.

    At most ``candidates`` chunks of a query are considered, whatever the limit; of equal
    texts the best stays. Returns query_id, chunk_id, collection, path, seq_id, title, text,
    score, rank, and the scores and ranks of both lists and of the fusion.
    """
    excluded = seen_pairs(corpus, queries, options.seen) if options.seen is not None else None
    fts = lexical_search(corpus, queries, options, excluded)
    vec = vector_search(corpus, queries, options, excluded)
    lists = fusion.as_list(fts, "fts").unionByName(fusion.as_list(vec, "vec"))
    if options.expand is not None:
        lists = lists.unionByName(_more_lists(corpus, queries, options, excluded))
    fused = fusion.fuse_lists(lists, candidates=options.candidates).drop("entries")
    places = corpus.chunks.select("chunk_id", "collection", "path", "seq_id", "title", "text", *(["headers"] if "headers" in corpus.chunks.columns else []))
    few = queries.count() * options.candidates <= SENT_HITS
    hits = places.join(F.broadcast(fused) if few else fused, "chunk_id").withColumn("score", F.col("rrf_score"))
    if options.rerank is not None:
        hits = written(hits, "hits")  # read by the reranker and by the blend
        hits = fusion.blend_rerank(hits, _reranked(hits, queries, options.rerank), reranker_only=options.reranker_only).drop("n_rrf", "n_rerank")
    return fusion.final_rank(fusion.dedup_by_text(hits), options.limit)


def wide_to_narrow_search(corpus: Corpus, queries: DataFrame, options: Options = Options()) -> DataFrame:
    """Hybrid hits boosted in the best documents and directories, from a pool of twice the limit.

    A reranker judges the pool, half and half with its scores, without a floor.
    """
    wide = replace(options, limit=max(options.fts_limit, options.vec_limit, 5 * options.limit), rerank=None)
    pool = hierarchy.wide_to_narrow(hybrid_search(corpus, queries, wide), limit=options.limit, containers=options.containers, pool=2 * options.limit)
    if options.rerank is not None:
        pool = written(pool, "pool")
        scores = _reranked(pool, queries, options.rerank)
        blended = fusion.blend_rerank(pool.withColumn("rrf_score", F.col("score")), scores, reranker_only=options.reranker_only, dual_floor=False)
        order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "chunk_id")
        pool = blended.drop("n_rrf", "n_rerank").withColumn("rank", F.row_number().over(order))
    return pool.filter(F.col("rank") <= options.limit)


def discover(corpus: Corpus, queries: DataFrame, options: Options = Options(), *, narrow: bool = False) -> DataFrame:
    """The best chunk of each document, with how many candidates the document had."""
    wide = replace(options, limit=max(6 * options.limit, options.fts_limit, options.vec_limit))
    hits = (wide_to_narrow_search if narrow else hybrid_search)(corpus, queries, wide)
    return hierarchy.discover(hits, limit=options.limit)
