"""Lexical retrieval: tokens of chunks, queries as expressions, and ranks of what a stored index finds.

All functions take many queries at once. Texts stay out of the ranking stages, and corpus
statistics are computed before any metadata filter, since filters don't change them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.functions.stem import stemmed
from lodestone.functions.text import TOKEN_BREAK, contains_literal
from lodestone.operators.postings import MARK, PostingIndex, search_blocks

_FORM = "key:string,terms:array<string>,columns:array<int>,first:boolean,gap:int,distance:int"
#: Chunks that a query has found when no looser tier is asked for.
QUORUM = 3
#: The indexed columns.
COLUMNS = ("collection", "path", "title", "body", "headers")


def index_chunks(chunks: DataFrame, columns: tuple[str, ...] = COLUMNS, *, stem: bool = False) -> DataFrame:
    """(chunk_id, terms, length, bounds): the tokens of all indexed columns that ``chunks`` has, and their number.

    A mark ends each column, so that no phrase spans two and every chunk has one; ``bounds``
    are the places where the columns of ``columns`` begin (null for one that is missing). With ``stem``, tokens
    lose their diacritics and endings.
    """
    own = [c for c in columns if c in chunks.columns]
    bare = lambda c: F.when(F.contains(c, F.lit(MARK)), F.translate(c, MARK, " ")).otherwise(F.coalesce(c, F.lit("")))
    text = F.concat(*(x for c in own for x in (bare(F.col(c)), F.lit(f" {MARK} "))))
    terms = F.filter(F.split(F.lower(text), TOKEN_BREAK.replace("[^", f"[^{MARK}")), lambda t: t != "")
    rows = chunks.select("chunk_id", terms.alias("terms"))
    if stem:
        rows = stemmed(rows, "terms")
    marks = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: F.get("terms", i) == MARK)
    starts = F.concat(F.array(F.lit(0)), F.transform(marks, lambda i: i + 1))
    bounds = F.array(*(F.get(starts, F.lit(own.index(c))) if c in own else F.lit(None).cast("int") for c in columns))
    return rows.select("chunk_id", "terms", (F.size("terms") - len(own)).alias("length"), bounds.alias("bounds"))


def _plain() -> tuple[Column, ...]:
    return F.lit(None).cast("array<int>").alias("columns"), F.lit(False).alias("first"), F.lit(None).cast("int").alias("gap"), F.lit(None).cast("int").alias("distance")


def asked_terms(queries: DataFrame, *, every: bool = True) -> DataFrame:
    """Compiled queries of (query_id, term): all terms, or any; ``x*`` stands for all that begin with x."""
    one = F.struct(F.col("term").alias("key"), F.array("term").alias("terms"), *_plain())
    rows = queries.select("query_id", "term").distinct().groupBy("query_id").agg(F.sort_array(F.collect_list(one)).alias("leaves"))
    return _compiled(rows, "all" if every else "any")


def asked_phrases(queries: DataFrame) -> DataFrame:
    """Compiled queries of (query_id, terms): the terms one after the other."""
    one = F.struct(F.array_join("terms", " ").alias("key"), "terms", *_plain())
    return _compiled(queries.select("query_id", F.array(one).alias("leaves")), "all")


def _compiled(rows: DataFrame, kind: str) -> DataFrame:
    return rows.select("query_id", F.lit(0).alias("tier"), F.lit(False).alias("last"), F.col("leaves").cast(f"array<struct<{_FORM}>>").alias("leaves"), F.array().cast("array<int>").alias("program"), F.lit(kind).alias("kind"))


def match(index: PostingIndex, queries: DataFrame, *, every: bool = True, limit: int | None = None) -> DataFrame:
    """(query_id, chunk_id, score) for queries (query_id, term): all terms, or any; all that match or the first ``limit``."""
    hits = search_blocks(index, asked_terms(queries, every=every), limit=limit).select("query_id", "chunk_id", "score")
    return hits if limit is None else ranked(hits, limit).drop("fts_rank")


def without(hits: DataFrame, excluded: DataFrame) -> DataFrame:
    """Boolean NOT: drops hits that also match ``excluded`` (query_id, chunk_id)."""
    return hits.join(excluded.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")


# -- expressions -----------------------------------------------------------------------------

_ASKED = f"tier int, last boolean, leaves array<struct<{_FORM}>>, program array<int>, kind string"


def _leaf(leaf: parse.Leaf, columns: tuple[str, ...], fold: Callable[[list[str]], list[str]]) -> dict:
    terms = fold(list(leaf.tokens))
    if leaf.prefix:
        terms[-1] += "*"
    only = None if leaf.columns is None else sorted({columns.index(c) for c in leaf.columns if c in columns})
    plain = len(terms) == 1 and only is None and not leaf.first and leaf.near is None
    key = terms[0] if plain else json.dumps([terms, only, leaf.first, leaf.near is not None])
    gap, distance = leaf.near or (None, None)
    return {"key": key, "terms": terms, "columns": only, "first": leaf.first, "gap": gap, "distance": distance}


def compile_queries(queries: DataFrame, *, columns: tuple[str, ...] = COLUMNS, tiers: Callable[[str], list[str]] | None = None, stem: bool = False) -> DataFrame:
    """Expressions from strict to loose for queries (query_id, query[, lexical]).

    ``tiers`` makes the match expressions of a query (by default the query itself); a text in
    ``lexical`` takes their place. Any of the words of the query comes last. Returns query_id,
    tier, last, leaves, program (postfix), kind (whether all leaves must match, any, or as the
    program says). A query without tokens has no rows.
    """
    kinds = pa.schema([("tier", pa.int32()), ("last", pa.bool_()), ("leaves", pa.list_(pa.struct([("key", pa.string()), ("terms", pa.list_(pa.string())), ("columns", pa.list_(pa.int32())), ("first", pa.bool_()), ("gap", pa.int32()), ("distance", pa.int32())]))), ("program", pa.list_(pa.int32())), ("kind", pa.string())])

    def of(query: str | None, lexical: str | None) -> list[dict]:
        from lodestone.functions.stem import fold_words

        fold = fold_words if stem else list
        out = []
        strict = [lexical] if lexical else (tiers(query) if tiers else [query])
        every = [parse.compiled(t) for t in strict if t] + [parse.relaxed(query)] if query or lexical else []
        for k, e in enumerate(every):
            if e.program:
                ops = {x for x in e.program if x < 0}
                kind = "all" if ops <= {parse.AND} else "any" if ops == {parse.OR} else "tree"
                kind = "tree" if any(x.near for x in e.leaves) else kind
                used = [i for i in e.program if i >= 0]
                out.append({"tier": k, "last": k == len(every) - 1, "leaves": [_leaf(e.leaves[i], columns, fold) for i in used], "program": [x if x < 0 else used.index(x) for x in e.program], "kind": kind})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [of(q, x) for q, x in zip(batch.column("query").to_pylist(), batch.column("lexical").to_pylist(), strict=True)]
            ids = batch.column("query_id").take(pa.array([i for i, x in enumerate(found) for _ in x], pa.int64()))
            rows = pa.RecordBatch.from_pylist([r for x in found for r in x], kinds)
            yield pa.RecordBatch.from_arrays([ids, *rows.columns], ["query_id", *kinds.names])

    lexical = F.col("lexical") if "lexical" in queries.columns else F.lit(None).cast("string")
    rows = queries.select("query_id", "query", lexical.alias("lexical"))
    return rows.mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, {_ASKED}")


# -- filters and ranks -----------------------------------------------------------------------


def metadata_filter(collection: str | None = None, title: str | None = None, path: str | list[str] | None = None) -> Column:
    """Equal collection, title that contains a text, path that contains one of several (comma-separated) texts."""
    out = F.lit(True)
    if collection is not None:
        out = out & (F.col("collection") == collection)
    if title:
        out = out & contains_literal(F.col("title"), title)
    if path:
        parts = [p.strip() for x in ([path] if isinstance(path, str) else path) for p in x.split(",") if p.strip()]
        some = F.lit(False)
        for p in parts:
            some = some | contains_literal(F.col("path"), p)
        out = out & some
    return out


def ranked(hits: DataFrame, limit: int, rank: str = "fts_rank", by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first ``limit`` hits of each query by score, ties by chunk_id, with their rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.round("score", 9).desc(), "chunk_id")
    return hits.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= limit)


def gated_tiers(hits: DataFrame, *, limit: int = 50, quorum: int = QUORUM, penalty: float = 0.85, last_penalty: float = 0.5) -> DataFrame:
    """Tiered relaxation as one lazy plan, for hits (query_id, tier, last, chunk_id, score).

    A tier counts only while the tiers before it hold fewer than ``quorum`` chunks; a
    chunk keeps its first tier. The score of tier i is scaled by ``penalty**i``, that of
    the last (any-term) tier by ``last_penalty``; the list's order stays by tier.
    """
    top = ranked(hits, limit, "tier_rank", ("query_id", "tier"))
    first = Window.partitionBy("query_id", "chunk_id").orderBy("tier")
    top = top.withColumn("turn", F.row_number().over(first)).filter("turn = 1").drop("turn")
    before = top.groupBy("query_id", "tier").agg(F.count("*").alias("n"))
    running = Window.partitionBy("query_id").orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)
    open_ = before.withColumn("before", F.coalesce(F.sum("n").over(running), F.lit(0))).filter(F.col("before") < quorum)
    kept = top.join(open_.select("query_id", "tier"), ["query_id", "tier"])
    scale = F.when(F.col("last"), F.lit(last_penalty)).otherwise(F.pow(F.lit(penalty), F.col("tier")))
    order = Window.partitionBy("query_id").orderBy("tier", "tier_rank")
    return kept.select("query_id", "chunk_id", "tier", (F.col("score") * scale).alias("score"), F.row_number().over(order).alias("fts_rank"))
