"""Grep, outlines, chunk reads, trees and counts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_literal


def _checked(pattern: str) -> str:
    try:
        re.compile(pattern)
    except re.error as e:
        raise ValueError(f"bad pattern: {e}") from e
    return pattern


def grep(docs: DataFrame, pattern: str, *, is_regex: bool = False, case_sensitive: bool = False, limit: int | None = 50) -> DataFrame:
    """First match in each line of ``body``, in order of collection, path and line."""
    if is_regex:
        _checked(pattern)
    full = ("" if case_sensitive else "(?i)") + (pattern if is_regex else f"\\Q{pattern}\\E")
    lines = docs.filter(F.rlike("body", F.lit(full))).select("collection", "path", "title", F.posexplode(F.split("body", "\n")).alias("at", "line_text"))
    hits = lines.filter(F.rlike("line_text", F.lit(full))).select("collection", "path", "title", (F.col("at") + 1).alias("line_number"), "line_text", F.regexp_extract("line_text", f"({full})", 1).alias("match_text"))
    return hits.orderBy("collection", "path", "line_number").limit(limit) if limit is not None else hits


def read_window(chunks: DataFrame, targets: DataFrame, window: int = 0) -> DataFrame:
    """Chunks at the targets (collection, path, seq_id) and up to ``window`` places around them, once each."""
    around = F.explode(F.sequence(F.greatest(F.col("seq_id") - window, F.lit(0)), F.col("seq_id") + window))
    wanted = targets.select("collection", "path", around.alias("seq_id")).distinct()
    return chunks.join(wanted, ["collection", "path", "seq_id"])


def tree(docs: DataFrame, *, max_depth: int | None = None, pattern: str | None = None, is_regex: bool = False, case_sensitive: bool = False) -> DataFrame:
    """Flat tree nodes: collection, depth, parent, name, type, files (below it)."""
    rows = docs.select("collection", "path", "title")
    if pattern:
        full = ("" if case_sensitive else "(?i)") + (pattern if is_regex else f"\\Q{pattern}\\E")
        rows = rows.filter(F.rlike("path", F.lit(full)) | F.rlike("title", F.lit(full)))
    parts = F.split("path", "/")
    nodes = rows.select("collection", parts.alias("parts"), F.posexplode(parts).alias("depth", "name"))
    nodes = nodes.select("collection", "depth", F.concat_ws("/", F.slice("parts", F.lit(1), F.col("depth"))).alias("parent"), "name", F.when(F.col("depth") == F.size("parts") - 1, "file").otherwise("directory").alias("type"))
    if max_depth is not None:
        nodes = nodes.filter(F.col("depth") < max_depth)
    return nodes.groupBy("collection", "depth", "parent", "name", "type").agg(F.count("*").alias("files"))


def nested(docs: DataFrame, *, max_depth: int | None = None, pattern: str | None = None, is_regex: bool = False, case_sensitive: bool = False, key: str | None = None) -> list[dict[str, Any]]:
    """The trees of the collections as nested nodes, directories before files, each without regard to case.

    A display on the driver: filter the documents first. Files have name, title, path and,
    with ``key``, doc_id.
    """
    rows = docs
    if pattern:
        full = ("" if case_sensitive else "(?i)") + (_checked(pattern) if is_regex else f"\\Q{pattern}\\E")
        rows = rows.filter(F.rlike("path", F.lit(full)) | F.rlike("title", F.lit(full)))
    trees: dict[str, dict] = {r.collection: {} for r in docs.select("collection").distinct().orderBy("collection").collect()}
    for r in rows.select("collection", "path", "title", *([key] if key else [])).orderBy("collection", "path").collect():
        parts = [p for p in r.path.replace("\\", "/").strip("/").split("/") if p]
        at = trees[r.collection]
        for p in parts[:-1]:
            at = at.setdefault(("directory", p), {})
        if parts:
            at["file", parts[-1]] = {"name": parts[-1], "type": "file", "title": r.title or parts[-1], "path": r.path} | ({"doc_id": r[key]} if key else {})

    def node(name: str, below: dict, depth: int) -> dict[str, Any]:
        shown = sorted(below.items(), key=lambda x: (x[0][0], x[0][1].lower())) if max_depth is None or depth < max_depth else []
        return {"name": name, "type": "directory", "children": [node(n, x, depth + 1) if kind == "directory" else x for (kind, n), x in shown]}

    return [{"collection": c, "tree": node(c or "", t, 0)} for c, t in trees.items()]


def collection_counts(docs: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    counts = docs.groupBy("collection").agg(F.count("*").alias("documents"))
    if configured is None:
        return counts
    return configured.select("collection").join(counts, "collection", "left").select("collection", F.coalesce("documents", F.lit(0)).alias("documents"))


def raw_document(docs: DataFrame, collection: str | None, path: str) -> DataFrame:
    """The document at ``path``; if none is, the first whose path contains it."""
    rows = docs.filter(F.col("collection") == collection) if collection else docs
    near = rows.filter(contains_literal(F.col("path"), path)).withColumn("exact", F.col("path") == path)
    return near.orderBy(F.col("exact").desc(), "collection", "path").limit(1).drop("exact")


#: After each line end, so that lines keep theirs.
_LINES = "(?<=\\n)|(?<=\\r)(?!\\n)|(?<=[\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029])"


def headings(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markdown headings outside code fences: key, line_num, level, text, char_offset. No shuffle."""
    state = "struct<code:boolean,line:int,at:int,heads:array<struct<line_num:int,level:int,text:string,char_offset:int>>>"

    def step(s: Column, line: Column) -> Column:
        code = s["code"] != F.rlike(line, F.lit("(?U)^\\s*```"))
        head = F.struct((s["line"] + 1).alias("line_num"), F.length(F.regexp_extract(line, "^(#+)", 1)).alias("level"), F.regexp_replace(F.regexp_extract(line, "(?dU)^#+\\s+(.*)", 1), "(?U)^\\s+|\\s+$", "").alias("text"), s["at"].alias("char_offset"))
        heads = F.when(~code & F.rlike(line, F.lit("(?U)^#+\\s")), F.array_append(s["heads"], head)).otherwise(s["heads"])
        return F.struct(code.alias("code"), (s["line"] + 1).alias("line"), (s["at"] + F.length(line)).alias("at"), heads.alias("heads")).cast(state)

    begin = F.struct(F.lit(False), F.lit(0), F.lit(0), F.array()).cast(state)
    heads = F.aggregate(F.split("body", _LINES), begin, step, lambda s: s["heads"])
    return docs.select(F.col(key), F.explode(heads).alias("h")).select(key, "h.*")


def outline(heads: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Headings with the chunks that they span, given chunk offsets (key, seq_id, start, chars).

    A heading starts in the last chunk whose offset isn't beyond its own, and ends before the
    next heading of its level or above. A document's headings and chunks meet in one row each.
    """
    own = heads.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_num", "level", "text", "char_offset"))).alias("heads"))
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq_id", "start", "chars"))).alias("parts"))
    rows = own.join(parts, key)
    before = lambda at: F.filter("parts", lambda p: p["start"] <= at)
    start = lambda at: F.coalesce(F.array_max(F.transform(before(at), lambda p: p["seq_id"])), F.lit(0))
    placed = F.transform("heads", lambda h: F.struct(h["line_num"].alias("line_num"), h["level"].alias("level"), h["text"].alias("text"), start(h["char_offset"]).alias("start_seq")))
    rows = rows.withColumn("heads", placed).withColumn("last", F.array_max(F.transform("parts", lambda p: p["seq_id"])))
    rows = rows.select(key, "heads", "parts", "last", F.explode("heads").alias("h"))
    after = F.filter("heads", lambda x: (x["line_num"] > F.col("h.line_num")) & (x["level"] <= F.col("h.level")))
    end = F.when(F.size(after) > 0, F.greatest(F.get(after, F.lit(0))["start_seq"] - 1, F.col("h.start_seq"))).otherwise(F.greatest("last", "h.start_seq"))
    rows = rows.withColumn("end_seq", end)
    inside = F.filter("parts", lambda p: p["seq_id"].between(F.col("h.start_seq"), F.col("end_seq")))
    chars = F.aggregate(inside, F.lit(0).cast("long"), lambda n, p: n + p["chars"])
    return rows.select(key, "h.line_num", "h.level", "h.text", "h.start_seq", "end_seq", chars.alias("char_count"))


def chunk_offsets(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, seq_id, start, chars) of chunks (key, seq_id, text) in their documents (key, body).

    A chunk's place is where its first 50 stripped characters come next; one that isn't found
    keeps the place of the chunk before it. A document's chunks meet in one row.
    """
    rows = docs.select(key, "body").join(chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq_id", "text"))).alias("parts")), key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, seq, start, chars = [], [], [], []
            for i, (body, parts) in enumerate(zip(batch.column("body").to_pylist(), batch.column("parts").to_pylist(), strict=True)):
                at = 0
                for p in parts:
                    text = p["text"] or ""
                    found = (body or "").find(text.strip()[:50], at) if text.strip() else -1
                    at = found if found >= 0 else at
                    owner.append(i), seq.append(p["seq_id"]), start.append(at), chars.append(len(text))
            keys = batch.column(key).take(pa.array(owner, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *(pa.array(x, pa.int32()) for x in (seq, start, chars))], [key, "seq_id", "start", "chars"])

    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, seq_id int, start int, chars int")


def document_outline(docs: DataFrame, chunks: DataFrame, collection: str | None, path: str) -> DataFrame:
    """The outline of the document at ``path`` (or of the first whose path contains it): collection, path, title,
    total_chunks, total_chars and its headings in order; no row if there is none.

    ``docs`` have collection, path, title, body; ``chunks`` collection, path, seq_id, text.
    """
    doc = raw_document(docs, collection, path).withColumn("doc", F.lit(1))
    own = chunks.join(F.broadcast(doc.select("collection", "path", "doc")), ["collection", "path"]).select("doc", "seq_id", "text")
    spans = outline(headings(doc, "doc"), chunk_offsets(doc, own, "doc"), "doc")
    one = F.struct("line_num", "level", "text", "start_seq", "end_seq", "char_count")
    heads = spans.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("headings"))
    sums = own.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    out = doc.join(sums, "doc", "left").join(heads, "doc", "left")
    return out.select("collection", "path", "title", F.coalesce("n", F.lit(0)).alias("total_chunks"), F.coalesce("chars", F.length("body").cast("long")).alias("total_chars"), F.coalesce("headings", F.array().cast(heads.schema["headings"].dataType)).alias("headings"))
