"""Embedders: where vectors come from. Anything with ``model`` and ``embed(texts) -> vectors`` will do."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.parse import words

#: Texts that an embedder is handed at once.
BATCH = 16


class Embedder(Protocol):
    model: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """An embedder without a model: words hashed to signed dimensions, unit length."""

    dim: int = 64
    model: str = "hashing"

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in words(t):
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h & 0x40000000 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1), 1e-30)[:, None]).astype(np.float32).tolist()


# How texts are put to an embedder.
def document_prompt(title: Column, text: Column) -> Column:
    return F.concat(F.lit("title: "), F.coalesce(title, F.lit("")), F.lit(" | text: "), text)


def query_prompt(query: Column) -> Column:
    return F.concat(F.lit("task: search result | query: "), query)


def with_context(headers: Column, text: Column) -> Column:
    """A chunk's text below the headings that it stands under."""
    return F.when(F.coalesce(headers, F.lit("")) == "", text).otherwise(F.concat(F.lit("Context: "), headers, F.lit("\n\n"), text))


def embedded(rows: DataFrame, text: str, embedder: Embedder, *, out: str = "embedding", size: int = BATCH) -> DataFrame:
    """``rows`` with the vector of ``text``, in batches of ``size`` texts; equal texts of an Arrow batch once. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            known: dict[str, list[float]] = {}
            for at in range(0, len(distinct), size):
                part = distinct[at : at + size]
                known |= dict(zip(part, embedder.embed(part), strict=True))
            found = pa.array([None if t is None else known[t] for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, `{out}` array<float>")


def embedded_queries(queries: DataFrame, embedder: Embedder, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries with ``vector``, rows for the cache): only texts that ``cache`` (query, model, vector) lacks are embedded.

    A vector goes with its query's text and the embedder's model; rows of other models don't count.
    """
    empty = queries.sparkSession.createDataFrame([], "query string, model string, vector array<float>")
    known = (cache if cache is not None else empty).filter(F.col("model") == embedder.model).select("query", "model", "vector").dropDuplicates(["query"])
    fresh = queries.select("query").distinct().join(known, "query", "left_anti")
    fresh = embedded(fresh.withColumn("prompt", query_prompt(F.col("query"))), "prompt", embedder, out="vector")
    fresh = fresh.select("query", F.lit(embedder.model).alias("model"), "vector")
    return queries.join(known.unionByName(fresh).select("query", "vector"), "query", "left"), fresh


class Scorer(Protocol):
    """Judges how well texts answer queries, a batch of (query, text) pairs at a time."""

    model: str

    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def pair_scores(hits: DataFrame, scorer: Scorer, cache: DataFrame | None = None, *, size: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """((query_id, chunk_id, rerank_score) of hits (query_id, query, chunk_id, text), rows for the cache).

    Only pairs that ``cache`` (query_hash, text_hash, model, score) lacks are scored, each distinct one
    once, in batches of ``size``. A score goes with the hashes of both texts and the scorer's model.
    Write the second table before the first is used, and pass it in: else pairs are scored for each use.
    """
    empty = hits.sparkSession.createDataFrame([], "query_hash string, text_hash string, model string, score double")
    keys = ["query_hash", "text_hash"]
    asked = hits.withColumns({"query_hash": F.sha2("query", 256), "text_hash": F.sha2("text", 256)})
    known = (cache if cache is not None else empty).filter(F.col("model") == scorer.model).dropDuplicates(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = list(zip(batch.column("query").to_pylist(), batch.column("text").to_pylist(), strict=True))
            found = [x for at in range(0, len(pairs), size) for x in scorer.score(pairs[at : at + size])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(found, pa.float64())], [*keys, "score"])

    missing = asked.filter("query_hash IS NOT NULL AND text_hash IS NOT NULL").join(known.select(*keys), keys, "left_anti").dropDuplicates(keys)
    fresh = missing.select(*keys, "query", "text").mapInArrow(run, "query_hash string, text_hash string, score double").select(*keys, F.lit(scorer.model).alias("model"), "score")
    return asked.join(known.select(*keys, "score"), keys, "left").select("query_id", "chunk_id", F.col("score").alias("rerank_score")), fresh
