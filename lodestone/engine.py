"""The engine behind the command line: a stored index with its embedder, reranker and sessions.

Methods return limited results as dictionaries; everything before the limit runs as
DataFrames. Searches are kept by request and version, unless a session leaves chunks out.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.functions.embed import Embedder, HashingEmbedder, Scorer, embedded_queries
from lodestone.functions.text import contains_literal, redact_pii
from lodestone.operators import inspect, lexical, search, sessions
from lodestone.operators.markdown import merge_snippets
from lodestone.operators.store import Store
from lodestone.settings import Settings
from lodestone.sources import files
from lodestone.sources.formats import PROGRAM, About, Row

_HITS = ("collection", "path", "seq_id", "title", "text", "headers", "score", "rank", "match_count", "fts_score", "fts_rank", "vec_score", "vec_rank", "rrf_score", "rrf_rank")


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings
    embedder: Embedder = field(default_factory=HashingEmbedder)
    rerank: search.Reranker = search.overlap_reranker
    #: Reads a query as words with parts of speech; without it queries have one strict tier.
    reader: Callable[[str], list[parse.Word]] | None = None
    #: Judges (query, text) pairs in place of ``rerank``; its scores are kept in the store.
    scorer: Scorer | None = None
    #: Describes images of documents, some at once.
    describe: Callable[[bytes], str] | None = None
    #: Answers batches of queries with more lines to search for.
    expander: Callable[[list[str]], list[str]] | None = None
    cache: sessions.ResultCache | None = None

    def __post_init__(self) -> None:
        if self.cache is None:
            self.cache = sessions.ResultCache(read=self.store.cached, write=self.store.keep)

    @property
    def store(self) -> Store:
        return Store(self.spark, self.settings.index, self.settings)

    # -- index ----------------------------------------------------------------------------------

    def update(self, collection: str | None = None, *, force: bool = False) -> dict[str, int]:
        """Scans the configured collections, or one of them, and brings the index up to date."""
        chosen = {n: c for n, c in self.settings.collections.items() if collection in (None, n)}
        if not chosen:
            raise ValueError(f"no collection {collection!r} is configured" if collection else "no collections are configured")
        found = [files.to_markdown(files.scan(self.spark, c.path, n, glob=c.glob, extensions=c.extensions, convert_others=c.convert), self.describe, self.settings.image_concurrency) for n, c in chosen.items()]
        return self.store.update(reduce(DataFrame.unionByName, found), self.embedder, scope=list(chosen), configured=list(self.settings.collections), force=force)

    def collections(self) -> list[Row]:
        known = self.spark.createDataFrame([(n, c.path) for n, c in self.settings.collections.items()], "collection string, folder string")
        counts = inspect.collection_counts(self.store.documents(), known)
        return [r.asDict() for r in known.join(counts, "collection").orderBy("collection").collect()]

    # -- search ---------------------------------------------------------------------------------

    def _tiers(self) -> Callable[[str], list[str]] | None:
        reader = self.reader
        return (lambda q: parse.tiers(*parse.tiered_terms(reader(q)), q)) if reader else None

    def _asked(self, query: str, lexical_query: str | None, session: str) -> DataFrame:
        rows = self.spark.createDataFrame([(1, query, lexical_query, session)], "query_id int, query string, lexical string, session_id string")
        asked, fresh = embedded_queries(rows, self.embedder, self.store.table("queries"))
        if not fresh.isEmpty():
            self.store.record("queries", fresh)
        return asked

    def find(self, query: str, *, mode: str = "search", limit: int | None = None, collection: str | None = None, title: str | None = None, path: str | None = None, lex: str | None = None, deep: bool = False, rerank_only: bool = False, broad: bool = False, session: str | None = None, include_seen: bool = False, exclude_seen: bool = False, fts_limit: int | None = None, vec_limit: int | None = None, candidates: int | None = None, max_chunks: int | None = None, redact: bool = False) -> tuple[list[Row], About]:
        """Hits of a query (``mode`` search), or the best of each document (discover), and what to say about them.

        Directives in the query count unless a parameter says otherwise. What is shown is noted
        as seen by the session.
        """
        s = self.settings
        query, said = parse.directives(query)
        collection, title, path, lex = (v if v is not None else said.get(k) for k, v in (("collection", collection), ("title", title), ("path", path), ("lex", lex)))
        limit = limit or said.get("limit") or s.default_limit
        deep = deep or s.deep or said.get("rerank", False)
        redact = redact or said.get("redact_pii", False)
        own = session or secrets.token_hex(4)
        leave_out = sessions.exclusion_policy(session, include_seen, exclude_seen or said.get("exclude_seen", False)) and not include_seen
        seen = self.store.table("results").filter(F.col("session_id") == own)
        options = search.Options(limit=limit, fts_limit=fts_limit or s.fts_limit, vec_limit=vec_limit or s.vec_limit, candidates=candidates or s.rerank_candidates, where=lexical.metadata_filter(collection, title, path), rerank=(partial(self.store.rerank, self.scorer) if self.scorer else self.rerank) if deep or rerank_only else None, expand=(lambda rows: search.expanded(rows, self.expander)) if self.expander else None, embed=lambda rows: embedded_queries(rows, self.embedder)[0], reranker_only=rerank_only, tiers=self._tiers())
        asked = self._asked(query, lex, own)
        corpus = self.store.corpus()
        n_seen = sessions.seen(seen).count()
        about = About(query=query, session=own, seen=n_seen)
        if leave_out and n_seen:
            options = replace(options, seen=seen)
            left = search.exclusion_stats(corpus, asked, options).first()
            about = replace(about, excluded_chunks=left.chunks, excluded_docs=left.documents)

        def run() -> list[Row]:
            hits = search.discover(corpus, asked, options, narrow=broad) if mode == "discover" else (search.wide_to_narrow_search if broad else search.hybrid_search)(corpus, asked, options)
            if redact:
                hits = hits.withColumns({c: redact_pii(F.col(c)) for c in ("text", "title")})
            return [{k: v for k, v in r.asDict().items() if k in _HITS} for r in hits.orderBy("rank").collect()]

        version = (self.store.meta() or {"version": -1})["version"]
        key = sessions.cache_key(mode=mode, query=query, limit=limit, collection=collection, title=title, path=path, lex=lex, deep=deep, only=rerank_only, broad=broad, fts=options.fts_limit, vec=options.vec_limit, candidates=options.candidates, redact=redact, version=version, model=self.embedder.model, scorer=self.scorer.model if self.scorer else None, expander=getattr(self.expander, "__qualname__", None))
        hits = self.cache.get(key, run, bypass=options.seen is not None)
        cap = max_chunks if max_chunks is not None else s.max_chunks_per_response
        shown = hits[:cap] if cap > 0 else hits
        about = replace(about, omitted=len(hits) - len(shown), cap=cap)
        self._note(own, mode, query, lex, shown)
        return shown, about

    def _note(self, session: str, kind: str, query: str, lex: str | None, shown: list[Row]) -> None:
        """Records the request and what it showed."""
        event = secrets.token_hex(8)
        at = self.spark.createDataFrame([(event, session, kind, query, lex)], "event_id string, session_id string, kind string, query string, lexical string")
        self.store.record("events", at.withColumn("at", F.current_timestamp()))
        if shown:
            rows = [(session, event, h.get("collection"), h["path"], h["seq_id"], h.get("rank"), h.get("score")) for h in shown]
            self.store.record("results", self.spark.createDataFrame(rows, "session_id string, event_id string, collection string, path string, seq_id int, rank int, score double"))

    def session(self, session: str) -> Row:
        events, results = (self.store.table(t).filter(F.col("session_id") == session) for t in ("events", "results"))
        row = sessions.session_info(events, results).first()
        return row.asDict() if row else {"session_id": session, "events": 0, "results": 0, "documents": 0}

    @staticmethod
    def by_document(hits: list[Row]) -> list[Row]:
        """Limited hits by document, best first: chunks, and snippets merged in reading order."""
        docs: dict[tuple, Row] = {}
        for h in hits:
            d = docs.setdefault((h.get("collection"), h["path"]), {"title": h.get("title"), "collection": h.get("collection"), "path": h["path"], "score": h["score"], "chunks": []})
            d["score"] = max(d["score"], h["score"])
            if all(c["text"] != h["text"] for c in d["chunks"]):
                d["chunks"].append(h)
        for d in docs.values():
            d["snippets"] = merge_snippets([(c["seq_id"], c["text"], c.get("headers")) for c in d["chunks"]], d["title"] or "")
        return sorted(docs.values(), key=lambda d: -d["score"])

    # -- inspection -----------------------------------------------------------------------------

    def outline(self, target: str, collection: str | None = None) -> Row | None:
        at = parse.target(target, collection)
        found = inspect.document_outline(self.store.bodies(), self.store.chunks(), at.collection, at.path or target).first()
        return found.asDict(recursive=True) if found else None

    def grep(self, pattern: str, *, is_regex: bool = False, case_sensitive: bool = False, collection: str | None = None, path: str | None = None, limit: int = 50) -> list[Row]:
        rows = self.store.bodies()
        if path:
            at = parse.target(path, collection)
            collection, path = at.collection, at.path
        if collection:
            rows = rows.filter(F.col("collection") == collection)
        if path:
            rows = rows.filter(contains_literal(F.col("path"), path))
        return [r.asDict() for r in inspect.grep(rows, pattern, is_regex=is_regex, case_sensitive=case_sensitive, limit=limit).collect()]

    def read(self, target: str, *, seq: str | None = None, window: int = 0, collection: str | None = None, max_chunks: int | None = None) -> tuple[list[Row], About]:
        """Chunks by place, or by number; beyond the cap, how to read on."""
        at = parse.target(target, collection)
        places = parse.int_ranges(seq) if seq is not None else at.seq
        if seq is not None and places is None:
            raise ValueError(f"{seq!r} is no range of chunks")
        chunks = self.store.chunks().drop("vector", "code", "hash", "line")
        if at.row_ids is not None and at.path is None and seq is None:
            wanted = chunks.filter(F.col("chunk_id").isin(at.row_ids)).select("collection", "path", "seq_id")
        else:
            doc = inspect.raw_document(self.store.documents(), at.collection, at.path or target).select("collection", "path")
            wanted = doc.select("collection", "path", F.explode(F.array(*(F.lit(i) for i in places or [0]))).alias("seq_id"))
        found = [r.asDict() for r in inspect.read_window(chunks, wanted, window).orderBy("collection", "path", "seq_id").collect()]
        cap = max_chunks if max_chunks is not None else self.settings.max_chunks_per_response
        shown = found[:cap] if cap > 0 else found
        about = About(omitted=len(found) - len(shown), cap=cap)
        if about.omitted:
            then = found[len(shown)]
            end = then["seq_id"] + min(about.omitted, cap) - 1
            span = f"{then['seq_id']}-{end}" if end > then["seq_id"] else f"{then['seq_id']}"
            about = replace(about, resume=f"{PROGRAM} read '{then['collection']}:{then['path']}:{span}'")
        return shown, about

    def document(self, collection: str | None, path: str) -> Row | None:
        row = inspect.raw_document(self.store.bodies(), collection, path).first()
        return row.asDict() if row else None

    def tree(self, collection: str | None = None, *, max_depth: int | None = None, pattern: str | None = None, is_regex: bool = False, case_sensitive: bool = False) -> list[Row]:
        rows = self.store.documents()
        if collection:
            rows = rows.filter(F.col("collection") == collection)
        return inspect.nested(rows, max_depth=max_depth, pattern=pattern, is_regex=is_regex, case_sensitive=case_sensitive)


def asked_by(values: dict[str, Any], *names: str) -> dict[str, Any]:
    """The named entries that are set."""
    return {n: values[n] for n in names if values.get(n) is not None}


