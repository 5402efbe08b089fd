"""Result formats as columns: lines of JSON, XML and plain or coloured text.

Rows are rendered one by one inside the plan, so a result of any size can be written;
only ``whole`` joins the lines of a small, limited result on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.parse import SCHEME
from lodestone.functions.text import escape_xml, strip_ansi
from lodestone.sources.formats import PROGRAM


def uri(collection: Column, path: Column) -> Column:
    """A document's address; without a collection its bare path."""
    return F.when(F.coalesce(collection, F.lit("")) == "", path).otherwise(F.concat(F.lit(SCHEME), collection, F.lit("/"), path))


def attributes(**values: Column) -> Column:
    """XML attributes in the given order, escaped; a null one is left out."""
    shown = [F.when(v.isNotNull(), F.concat(F.lit(f'{k}="'), escape_xml(v.cast("string")), F.lit('"'))) for k, v in values.items()]
    return F.concat_ws(" ", *shown)


def _place() -> dict[str, Column]:
    return {"document": uri(F.col("collection"), F.col("path")), "collection": F.col("collection"), "path": F.col("path")}


def results_xml(hits: DataFrame) -> DataFrame:
    """(query_id, rank, xml) of hits with query_id, rank, score, collection, path, seq_id, title, text."""
    seq, body = F.col("seq_id"), F.trim(strip_ansi(F.coalesce("text", F.lit(""))))
    place = F.concat_ws(":", F.when(F.coalesce("collection", F.lit("")) != "", F.col("collection")), F.col("path"))
    section = F.coalesce("headers", F.lit("")) if "headers" in hits.columns else F.lit("")
    known = attributes(rank=F.col("rank"), score=F.format_string("%.4f", F.col("score").cast("double")), **_place(), seq=seq, chars=F.length(body), title=F.col("title"), section=section, prev_seq=F.greatest(seq - 1, F.lit(0)), next_seq=seq + 1, read=F.concat(F.lit(f"{PROGRAM} read '"), place, F.lit(":"), seq.cast("string"), F.lit("'")), outline=F.concat(F.lit(f"{PROGRAM} outline '"), place, F.lit("'")))
    return hits.select("query_id", "rank", F.concat(F.lit("  <result "), known, F.lit(">\n"), body, F.lit("\n  </result>")).alias("xml"))


def grep_xml(matches: DataFrame) -> DataFrame:
    """(collection, path, xml): one element for each document, its matching lines in order."""
    line = F.concat(F.lit('    <match line="'), F.col("line_number").cast("string"), F.lit('">'), escape_xml(F.col("line_text")), F.lit("</match>"))
    found = matches.groupBy("collection", "path", "title").agg(F.array_sort(F.collect_list(F.struct("line_number", line.alias("xml")))).alias("lines"))
    head = attributes(uri=uri(F.col("collection"), F.col("path")), title=F.col("title"))
    return found.select("collection", "path", F.concat(F.lit("  <document "), head, F.lit(">\n"), F.array_join(F.transform("lines", lambda x: x["xml"]), "\n"), F.lit("\n  </document>")).alias("xml"))


def tree_xml(nodes: DataFrame) -> DataFrame:
    """(collection, depth, parent, name, xml) of tree nodes."""
    known = attributes(name=F.col("name"), type=F.col("type"), depth=F.col("depth"))
    return nodes.select("collection", "depth", "parent", "name", F.concat(F.lit("  <node "), known, F.lit(" />")).alias("xml"))


def as_json(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys, and each row as a JSON object; null fields are left out."""
    return rows.select(*keys, F.to_json(F.struct("*")).alias("json"))


def results_text(hits: DataFrame, *, colour: bool = False, width: int = 2000) -> DataFrame:
    """(query_id, rank, text) for a terminal: title and address, snippet, score."""
    mark = lambda code, c: F.concat(F.lit(f"\x1b[{code}m"), c, F.lit("\x1b[0m")) if colour else c
    head = F.concat(mark("32", F.concat(F.col("rank").cast("string"), F.lit("."))), F.lit(" "), mark("1", F.coalesce("title", F.lit(""))), F.lit(" ("), F.coalesce(uri(F.col("collection"), F.col("path")), F.lit("")), F.lit(")"))
    snippet = F.concat(F.lit("   "), F.translate(F.substring(F.coalesce("text", F.lit("")), 1, width), "\n", " "), F.lit("..."))
    return hits.select("query_id", "rank", F.concat_ws("\n", head, snippet, F.format_string("   Score: %.4f", F.col("score").cast("double"))).alias("text"))


def whole(rendered: DataFrame, element: str, **values: str) -> str:
    """A rendered and limited result as one XML text; the last column holds the lines."""
    lines = [r[-1] for r in rendered.collect()]
    quoted = [(k, str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")) for k, v in values.items()]
    head = "".join(f' {k}="{v}"' for k, v in quoted)
    return "\n".join([f'<{element}{head} total="{len(lines)}">', *lines, f"</{element}>"])
