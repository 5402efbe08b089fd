"""A stored index: documents, chunks, vectors, postings and sessions as Parquet tables in one folder.

Every update writes a new version; a version counts once its row in ``meta`` is written, so
readers see whole versions and a failed update leaves none. An update claims its version first,
so that of two at once one fails before it writes.

``documents`` is the manifest, a snapshot by version: of each place its content's hash, the
version that holds the content's chunks (``stored``) and the one that holds its postings
(``indexed``). Readers take the folders of those versions only, and nothing is ranked or
sorted to find the last. Chunks with vectors are kept by content: only content that no version
before has is converted, chunked and embedded, whatever collections and paths refer to it.
Postings are blocks by term and segment; chunks of places that are gone or indexed anew are
listed in ``dead``, a snapshot as well, until ``compact`` writes all anew.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.embed import Embedder, Scorer, document_prompt, embedded, pair_scores, with_context
from lodestone.operators import lexical, maintenance, postings
from lodestone.operators.markdown import markdown_chunks
from lodestone.operators.search import Corpus
from lodestone.operators.similarity import packed
from lodestone.operators.tables import written
from lodestone.settings import Settings

#: The layout that this code writes; others are refused.
LAYOUT = 3
#: Minutes after which another update may take over the claim of one that has died.
CLAIM_MINUTES = 60
# Columns of the tables; each also has the version that wrote it.
DOCUMENTS = "collection string, path string, title string, hash string, modified_at timestamp, stored long, indexed long"
CONTENT = "hash string, body string"
CHUNKS = "hash string, seq_id int, text string, headers string, line int, vector array<float>, code binary"
POSTINGS = f"{postings.ROWS}, bucket int"
DEAD = "segment long, at array<int>"
FAILED = "collection string, path string, hash string, error string"
EVENTS = "event_id string, session_id string, kind string, query string, lexical string, at timestamp"
RESULTS = "session_id string, event_id string, collection string, path string, seq_id int, rank int, score double"
QUERIES = "query string, model string, vector array<float>"
SCORES = "query_hash string, text_hash string, model string, score double"
CACHED = "key string, body string, at timestamp"
META = "version long, layout int, updated_at timestamp, quantization string, dim int, stem boolean"
_TABLES = {"documents": DOCUMENTS, "content": CONTENT, "chunks": CHUNKS, "postings": POSTINGS, "dead": DEAD, "failed": FAILED, "events": EVENTS, "results": RESULTS, "queries": QUERIES, "scores": SCORES, "cached": CACHED, "meta": META}


def chunk_key() -> Column:
    """A chunk's number by its place, the same in every version."""
    return F.xxhash64("collection", "path", "seq_id")


@dataclass(frozen=True)
class Store:
    """The index in ``folder``, which must be one that the whole cluster reaches."""

    spark: SparkSession
    folder: str
    settings: Settings = Settings()

    # -- tables -------------------------------------------------------------------------------

    def _exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def table(self, name: str) -> DataFrame:
        """A table with all its versions; empty before its first row."""
        kinds = f"{_TABLES[name]}, version long" if name != "meta" else META
        if not self._exists(name):
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(f"{self.folder}/{name}")

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        """One folder by version: an update that is run again replaces what it left."""
        out = rows.select(*self.spark.createDataFrame([], _TABLES[name]).columns).write.mode("overwrite")
        (out.partitionBy("bucket") if name == "postings" else out).parquet(f"{self.folder}/{name}/version={version}")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    @contextmanager
    def _claimed(self, version: int) -> Iterator[None]:
        """Holds the right to write a version: a file that only one update can create."""
        path, system = self._path(f"claims/{version}")
        system.mkdirs(path.getParent())
        if not system.createNewFile(path):
            if time.time() * 1000 - system.getFileStatus(path).getModificationTime() < CLAIM_MINUTES * 60_000:
                raise RuntimeError(f"another update writes version {version} of the index")
            system.delete(path, False)
            if not system.createNewFile(path):
                raise RuntimeError(f"another update writes version {version} of the index")
        try:
            yield
        finally:
            system.delete(path, False)

    def meta(self) -> dict | None:
        """The latest version's row; None before the first. Another layout than this code's is an error."""
        last = self.table("meta").orderBy(F.col("version").desc()).limit(1).collect()
        if last and last[0].layout != LAYOUT:
            raise ValueError(f"the index has layout {last[0].layout}, this code reads {LAYOUT}: build it anew in another folder")
        return last[0].asDict() if last else None

    def documents(self) -> DataFrame:
        """The latest snapshot."""
        version = (self.meta() or {"version": -1})["version"]
        return self.table("documents").filter(F.col("version") == version).drop("version")

    def _of_versions(self, name: str, documents: DataFrame, column: str) -> DataFrame:
        """A table's rows of the versions that ``documents`` name in ``column``: other folders aren't read."""
        versions = sorted(r[0] for r in documents.select(column).distinct().collect())
        return self.table(name).filter(F.col("version").isin(versions)) if versions else self.table(name).limit(0)

    def _known(self, documents: DataFrame, most: int = 200_000) -> DataFrame:
        """The manifest's narrow columns, sent to all tasks if they are few."""
        return F.broadcast(documents) if documents.count() <= most else documents

    def live(self, name: str) -> DataFrame:
        """Rows of content, or of chunks, that documents of the latest version refer to."""
        documents = self.documents()
        keys = documents.select("hash", F.col("stored").alias("version")).distinct()
        return self._of_versions(name, documents, "stored").join(self._known(keys), ["hash", "version"], "left_semi").drop("version")

    # -- updates ------------------------------------------------------------------------------

    def update(self, files: DataFrame, embedder: Embedder, *, scope: list[str] | None = None, configured: list[str] | None = None, force: bool = False) -> dict[str, int]:
        """Brings the index up to ``files`` (collection, path, title, hash, body, error[, modified_at]).

        ``scope`` names the collections that were scanned (by default those of the files);
        their other documents are deleted. ``configured`` names all collections there are;
        documents of others are pruned. Files with an error keep what is stored of them and are
        noted. ``force`` chunks and embeds again what is there. Returns how many documents are new, changed, moved,
        unchanged, deleted and failed; the version goes up only if something changed.
        """
        meta = self.meta()
        version = meta["version"] + 1 if meta else 0
        kind, stem = (meta["quantization"], meta["stem"]) if meta else (self.settings.vector_quantization, self.settings.stem)
        stored = self.documents()
        if "modified_at" not in files.columns:
            files = files.withColumn("modified_at", F.current_timestamp())
        scope = scope if scope is not None else [r[0] for r in files.select("collection").distinct().collect()]
        failed = files.filter("error IS NOT NULL")
        fine = files.filter("error IS NULL")
        broken = stored.join(failed.select("collection", "path"), ["collection", "path"], "left_semi")
        inside = stored.filter(F.col("collection").isin(scope)).join(failed.select("collection", "path"), ["collection", "path"], "left_anti")
        states = maintenance.classify(fine, inside)
        counts = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
        moved = states.filter("state = 'moved'").select("collection", F.col("old_path").alias("path"))
        gone = maintenance.stale(fine, inside).join(moved, ["collection", "path"], "left_anti")
        counts |= {"deleted": gone.count(), "failed": failed.count()}
        others = stored.filter(~F.col("collection").isin(scope))
        if configured is not None:
            kept = others.filter(F.col("collection").isin(configured))
            counts["deleted"] += others.count() - kept.count()
            others = kept
        if meta and not force and not any(counts.get(k) for k in ("new", "changed", "moved", "deleted")):
            return counts
        with self._claimed(version):
            # Content has its chunks in the version that was first to have it; places are indexed when they or their content change.
            have = stored.select("hash", "stored").filter(F.lit(not force)).groupBy("hash").agg(F.max("stored").alias("stored"))
            touched = states.filter((F.col("state") != "unchanged") | F.lit(force)).select("collection", "path", F.lit(True).alias("touched"))
            own = stored.select("collection", "path", F.col("indexed").alias("was"))
            now = fine.select("collection", "path", "title", "hash", "modified_at").join(have, "hash", "left").join(touched, ["collection", "path"], "left").join(own, ["collection", "path"], "left")
            now = now.withColumn("stored", F.coalesce("stored", F.lit(version))).withColumn("indexed", F.when(F.col("touched") | F.col("was").isNull(), version).otherwise(F.col("was"))).drop("touched", "was")
            self._write("documents", now.unionByName(others).unionByName(broken), version)
            snapshot = self.table("documents").filter(F.col("version") == version).drop("version")
            fresh = fine.join(snapshot.filter(F.col("stored") == version).select("hash").distinct(), "hash", "left_semi").dropDuplicates(["hash"])
            self._write("content", fresh.select("hash", "body"), version)
            self._write("chunks", self._chunked(self.table("content").filter(F.col("version") == version).join(fresh.select("hash", "title"), "hash"), embedder, kind), version)
            self._write("postings", self._indexed(snapshot.filter(F.col("indexed") == version), version, stem), version)
            self._write("dead", self._dead(stored, snapshot, meta["version"] if meta else None), version)
            self._write("failed", failed.select("collection", "path", "hash", "error"), version)
            dim = getattr(embedder, "dim", None) or self.table("chunks").filter(F.col("version") == version).agg(F.max(F.coalesce(F.size("vector"), F.octet_length("code")))).first()[0]
            self._commit(version, kind, dim, stem)
        return counts

    def _commit(self, version: int, kind: str, dim: int | None, stem: bool) -> None:
        """From here on the version counts."""
        done = self.spark.createDataFrame([(version, LAYOUT, kind, dim, stem)], "version long, layout int, quantization string, dim int, stem boolean").withColumn("updated_at", F.current_timestamp())
        done.select(*self.spark.createDataFrame([], META).columns).write.mode("append").parquet(f"{self.folder}/meta")

    def _dead(self, before: DataFrame, now: DataFrame, version: int | None) -> DataFrame:
        """The chunks, by segment, that postings of live versions have of places that are gone or indexed anew.

        Only chunk numbers are compared: those of old places with those of the segments' own rows.
        """
        old = self.table("dead").filter(F.col("version") == (version if version is not None else -1)).select("segment", F.explode("at").alias("at"))
        gone = before.join(now.select("collection", "path", "indexed"), ["collection", "path", "indexed"], "left_anti")
        if gone.isEmpty():
            return old.groupBy("segment").agg(F.sort_array(F.collect_set("at")).alias("at"))
        ids = self._places(gone).select("chunk_id", F.col("indexed").alias("version"))
        rows = self._of_versions("postings", gone, "indexed").filter(F.col("bucket") == postings.OWN)
        new = rows.select("version", "segment", F.posexplode("chunks").alias("at", "chunk_id")).join(ids, ["version", "chunk_id"]).select("segment", "at")
        return old.unionByName(new).groupBy("segment").agg(F.sort_array(F.collect_set("at")).alias("at"))

    def _chunked(self, content: DataFrame, embedder: Embedder, kind: str) -> DataFrame:
        s = self.settings
        rows = markdown_chunks(content.select("hash", "body"), "hash", target=s.target_chunk_size, most=s.max_chunk_size, strip_links=s.strip_links)
        prompt = document_prompt(F.col("title"), with_context(F.col("headers"), F.col("text")))
        rows = embedded(rows.join(content.select("hash", "title"), "hash").withColumn("prompt", prompt), "prompt", embedder, out="vector", size=s.embed_batch_size)
        own = rows.select("hash", "seq_id", "text", "headers", "line", "vector")
        if kind == "none":
            return own.withColumn("code", F.lit(None).cast("binary"))
        return packed(own.withColumnRenamed("vector", "code"), "code", kind).withColumn("vector", F.lit(None).cast("array<float>"))

    def _places(self, documents: DataFrame) -> DataFrame:
        """Chunks of documents (with ``stored``) at their places. The manifest meets them by broadcast unless it is large."""
        rows = self._of_versions("chunks", documents, "stored").withColumnRenamed("version", "stored")
        kept = [c for c in documents.columns if c != "modified_at"]
        return rows.join(self._known(documents.select(*kept)), ["hash", "stored"]).withColumn("chunk_id", chunk_key())

    def _indexed(self, documents: DataFrame, version: int, stem: bool) -> DataFrame:
        rows = self._places(documents).withColumnRenamed("text", "body")
        blocks = postings.build_blocks(lexical.index_chunks(rows, stem=stem), first=version << 48)
        return blocks.hint("rebalance", "bucket")

    def compact(self) -> None:
        """Writes content, chunks and postings of what the latest version refers to as one new version, and deletes the others."""
        meta = self.meta()
        if not meta:
            return
        version = meta["version"] + 1
        with self._claimed(version):
            for name in ("content", "chunks"):
                self._write(name, self.live(name), version)
            self._write("documents", self.documents().withColumns({"stored": F.lit(version), "indexed": F.lit(version)}), version)
            snapshot = self.table("documents").filter(F.col("version") == version).drop("version")
            self._write("postings", self._indexed(snapshot, version, meta["stem"]), version)
            self._write("dead", self.table("dead").limit(0), version)
            self._write("failed", self.table("failed").filter(F.col("version") == meta["version"]), version)
            self._commit(version, meta["quantization"], meta["dim"], meta["stem"])
        for name in ("content", "chunks", "postings", "dead", "documents"):
            for r in self.table(name).filter(F.col("version") < version).select("version").distinct().collect():
                self._delete(f"{name}/version={r.version}")

    def _delete(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    # -- reading ------------------------------------------------------------------------------

    def chunks(self) -> DataFrame:
        """(chunk_id, collection, path, seq_id, title, text, headers, vector or code) of every document."""
        return self._places(self.documents()).drop("stored", "indexed")

    def corpus(self) -> Corpus:
        meta = self.meta() or {"quantization": "none", "stem": self.settings.stem}
        rows = self.chunks()
        stored = "vector" if meta["quantization"] == "none" else "code"
        vectors = rows.filter(F.col(stored).isNotNull()).select("chunk_id", F.col(stored).alias("embedding"))
        return Corpus(rows.drop("vector", "code"), self.postings(), vectors, meta["stem"])

    def postings(self) -> postings.PostingIndex:
        """The live versions' postings, with what is dead in them."""
        documents = self.documents()
        dead = self.table("dead").filter(F.col("version") == (self.meta() or {"version": -1})["version"])
        rows = self._of_versions("postings", documents, "indexed").drop("version")
        return postings.PostingIndex(rows, dead=dead.select("segment", "at"))

    def bodies(self) -> DataFrame:
        """(collection, path, title, body) of every document."""
        return self.documents().join(self.live("content"), "hash").select("collection", "path", "title", "body")

    # -- sessions -----------------------------------------------------------------------------

    def record(self, name: str, rows: DataFrame) -> None:
        """Appends to events, results, queries, scores or cached."""
        kinds = self.spark.createDataFrame([], _TABLES[name])
        rows.select(*kinds.columns).write.mode("append").parquet(f"{self.folder}/{name}/version=0")

    def rerank(self, scorer: Scorer, hits: DataFrame) -> DataFrame:
        """(query_id, chunk_id, rerank_score): pairs that no search before has scored are scored and kept."""
        hits = written(hits, "hits")
        fresh = pair_scores(hits, scorer, self.table("scores"))[1]
        if not (fresh := written(fresh, "scores")).isEmpty():
            self.record("scores", fresh)
        return pair_scores(hits, scorer, self.table("scores"))[0]

    def cached(self, key: str) -> str | None:
        """A result that was kept under ``key``: a digest of the parameters, the version and the models."""
        found = self.table("cached").filter(F.col("key") == key).select("body").head()
        return found.body if found else None

    def keep(self, key: str, body: str) -> None:
        one = self.spark.createDataFrame([(key, body)], "key string, body string")
        self.record("cached", one.withColumn("at", F.current_timestamp()))

    def create(self) -> None:
        """Writes empty tables where there are none."""
        for name in _TABLES:
            if not self._exists(name):
                empty = self.spark.createDataFrame([], _TABLES[name])
                empty.write.parquet(f"{self.folder}/{name}" + ("/version=0" if name != "meta" else ""))
