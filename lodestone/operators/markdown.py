"""Markdown to blocks to chunks; per document, in Arrow batches.

The size of a run of blocks counts the separator after its last block unless the run
begins the document; chunk boundaries depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as a heading, link, table row and fence.
_HEADER = re.compile(r"^(#+)\s+(.*)")
_IMAGE, _LINK = re.compile(r"!\[([^\]]*)\]\([^)]*\)"), re.compile(r"(?<!!)\[([^\]]+)\]\([^)]*\)")
_TABLE_ROW, _FENCE = re.compile(r"^\s*\|.*\|"), re.compile(r"^\s*```")


@dataclass(frozen=True)
class Block:
    level: int
    header: str
    content: str
    line: int
    joiner: str = "\n\n"


def parse_blocks(text: str, strip_links: bool = True) -> list[Block]:
    """One block for each heading outside code fences, the text before it as level 0 "Preface"."""
    out, lines, code = [], [], False
    head = (0, "Preface", 1)
    for number, line in enumerate(text.splitlines(keepends=True), 1):
        if line.strip().startswith("```"):
            code = not code
        m = None if code else _HEADER.match(line)
        if m:
            if lines:
                out.append(Block(head[0], head[1], "".join(lines).strip(), head[2]))
            head, lines = (len(m[1]), m[2].strip(), number), []
        lines.append(line if code or not strip_links else _LINK.sub(r"\1", _IMAGE.sub(r"\1", line)))
    if lines:
        out.append(Block(head[0], head[1], "".join(lines).strip(), head[2]))
    return out


def _cut(text: str, at: int, room: int) -> tuple[int, str]:
    """Where to cut within ``room`` characters from ``at``, and the separator that is lost there."""
    for sep in ("\n\n", "\n"):
        if (i := text.rfind(sep, at, at + room)) > at:
            return i, sep
    if (i := max(text.rfind(s, at, at + room) for s in (". ", "? ", "! "))) > at:
        return i + 1, " "
    if (i := text.rfind(" ", at, at + room)) > at:
        return i, " "
    return at + room, ""


def split_block(block: Block, most: int) -> list[Block]:
    """Cuts a block above ``most`` characters at paragraphs, lines, sentences, words, or anywhere.

    Pieces are stripped, blank ones dropped; the last one goes on as the block does. A
    heading that leaves no room is a piece of its own.
    """
    if len(block.content) <= most:
        return [block]
    m = re.match(r"#+\s+.*\n*", block.content)
    lead = m[0] if m else ""
    body = block.content[len(lead) :].lstrip()
    out, at, name = [], 0, block.header
    if lead and len(lead) >= most:
        out.append(replace(block, content=lead.strip(), joiner="\n\n"))
        lead, name = "", f"{block.header} (cont.)"
    while at < len(body):
        room = most - len(lead)
        end, joiner = (len(body), block.joiner) if len(body) - at <= room else _cut(body, at, room)
        if piece := (lead + body[at:end]).strip():
            out.append(replace(block, content=piece, header=name, joiner=joiner))
        lead, name, at = "", f"{block.header} (cont.)", end + len(joiner)
    return [*out[:-1], replace(out[-1], joiner=block.joiner)] if out else []


def breadcrumbs(blocks: list[Block]) -> dict[int, list[str]]:
    """For the line that each block begins at, the headings it stands under and its own, in order of level.

    One pass keeps the open headings, levels rising. What stands above a heading of level 1
    is left out, but not above a block that itself has level 1: there the text before all
    headings shows as " Preface".
    """
    open_: list[Block] = []
    out: dict[int, list[str]] = {}
    for b in blocks:
        while open_ and open_[-1].level >= b.level:
            open_.pop()
        first = max((i for i, x in enumerate(open_) if x.level == 1), default=0)
        chain = [*open_[first:], b] if b.level else []
        out[b.line] = [f"{'#' * x.level} {x.header}" for x in sorted(chain, key=lambda x: str(x.level))]
        open_.append(b)
    return out


def partition(sizes: list[int], joiners: list[int], target: int, most: int) -> list[int]:
    """Cut points of the runs that minimise the squared distance from ``target``, none above ``most``.

    If no such runs reach the end, the cheapest last run measured without separators may;
    otherwise runs are filled greedily up to the target, without counting separators.
    """
    n = len(sizes)
    size, sep = [0, *accumulate(sizes)], [0, *accumulate(joiners)]

    def run(j: int, i: int) -> int:  # of blocks j to i - 1
        counted = max(0, min(i - j, i - 1))  # the first run leaves out its last separator
        return size[i] - size[j] + sep[j + counted] - sep[j]

    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for i in range(1, n + 1):
        for j in range(i - 1, -1, -1):
            length = run(j, i)
            if length > most:
                break
            cost = best[j] + (length - target) ** 2
            if cost < best[i]:
                best[i], back[i] = cost, j
    end, cuts = n, [n]
    if best[n] == float("inf"):
        cost, rest = min(((best[j] + (size[n] - size[j] - target) ** 2, -j) for j in range(n) if size[n] - size[j] <= most), default=(float("inf"), 0))
        if cost == float("inf"):
            return _greedy(sizes, target, most)
        rest = -rest
        end, cuts = rest, ([n, rest] if rest else [n])
    while back[end] > 0:
        end = back[end]
        cuts.append(end)
    return sorted(set(cuts))


def _greedy(sizes: list[int], target: int, most: int) -> list[int]:
    cuts, total = [], 0
    for i, s in enumerate(sizes):
        if total and total + s > most:
            cuts.append(i)
            total = 0
        total += s
        if total >= target:
            cuts.append(i + 1)
            total = 0
    return sorted({*cuts, len(sizes)} - {0})


def chunk_markdown(text: str, target: int = 1024, most: int = 2048, strip_links: bool = True) -> list[dict]:
    """Chunks of a document: seq_id, text, line, headers (breadcrumb), table and fence heads carried over."""
    blocks = parse_blocks(text, strip_links)
    pieces = [p for b in blocks for p in split_block(b, most)]
    if not pieces:
        return []
    above = breadcrumbs(blocks)
    out, a = [], 0
    for b in partition([len(p.content) for p in pieces], [len(p.joiner) for p in pieces], target, most):
        run = pieces[a:b]
        content = "".join(p.content + (p.joiner if k < len(run) - 1 else "") for k, p in enumerate(run))
        heads = [v for v in above[run[0].line] if not content.strip().startswith(v.strip())]
        out.append({"seq_id": len(out), "text": content, "line": run[0].line, "headers": " > ".join(filter(None, (re.sub(r"^\s*#+\s*", "", v).strip() for v in heads))), "table_head": None, "fence_head": None})
        a = b
    _carry(out)
    return out


def _table_head(text: str) -> str | None:
    lines = text.split("\n")
    return next((f"{x}\n{y}" for x, y in zip(lines, lines[1:], strict=False) if _TABLE_ROW.match(x) and _TABLE_ROW.match(y) and "---" in y), None)


def _carry(chunks: list[dict]) -> None:
    """Notes the table head or the opening fence that a chunk continues."""
    table, fence = None, None
    for k, c in enumerate(chunks):
        c["fence_head"] = fence
        if k and _TABLE_ROW.match(c["text"].lstrip()) and _TABLE_ROW.match(chunks[k - 1]["text"].rstrip().split("\n")[-1]):
            c["table_head"] = table
        table = _table_head(c["text"]) or table
        n = c["text"].count("```")
        if n % 2:
            fence = None if fence else next((x for x in c["text"].split("\n") if _FENCE.match(x)), "```")


#: Characters of documents whose chunks a task holds at once; a longer document is held whole.
HELD = 1 << 20
SCHEMA = "seq_id int, text string, line int, headers string, table_head string, fence_head string"
_KINDS = pa.schema([("seq_id", pa.int32()), ("text", pa.string()), ("line", pa.int32()), *((c, pa.string()) for c in ("headers", "table_head", "fence_head"))])


def chunk_batches(batches: Iterator[pa.RecordBatch], target: int = 1024, most: int = 2048, strip_links: bool = True) -> Iterator[pa.RecordBatch]:
    """Chunks of documents (key, body), given away when ``HELD`` characters were read."""
    for batch in batches:
        at, found, held = [], [], 0
        for i in range(batch.num_rows):
            if text := batch.column("body")[i].as_py():
                own = chunk_markdown(text, target, most, strip_links)
                at += [i] * len(own)
                found += own
                held += len(text)
            if found and (held >= HELD or i == batch.num_rows - 1):
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), *pa.RecordBatch.from_pylist(found, _KINDS).columns], ["key", *_KINDS.names])
                at, found, held = [], [], 0


def markdown_chunks(docs: DataFrame, key: str = "doc_id", *, target: int = 1024, most: int = 2048, strip_links: bool = True) -> DataFrame:
    """Chunks of ``body``, some documents at a time, no shuffle. Null and empty bodies have none."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.selectExpr(f"`{key}` AS key", "body").mapInArrow(lambda batches: chunk_batches(batches, target, most, strip_links), f"key {kind}, {SCHEMA}")
    return rows.withColumnRenamed("key", key)


@dataclass
class _Run:
    """Snippets that became one text: the places it spans, its headings."""

    first: int
    last: int
    heads: str
    text: str


def _joined(snippets: list[tuple[int, str, str]]) -> list[_Run]:
    """Drops what is contained, takes in what contains, joins at overlaps of 20 to 250 characters."""
    out: list[_Run] = []
    for seq, text, heads in snippets:
        if any(text in x.text for x in out):
            continue
        inside = [x for x in out if x.text in text]
        if inside:
            whole = _Run(min(seq, *(x.first for x in inside)), max(seq, *(x.last for x in inside)), inside[0].heads or heads, text)
            out = [whole if x is inside[0] else x for x in out if x is inside[0] or x not in inside]
            continue
        end = out[-1] if out else None
        k = next((k for k in range(min(len(text), len(end.text), 250), 19, -1) if end.text.endswith(text[:k])), 0) if end else 0
        if end and k:
            end.text, end.last = end.text + text[k:], max(end.last, seq)
        else:
            out.append(_Run(seq, seq, heads, text))
    return out


def _skipped(n: int) -> str:
    return f"(... {n} chunk{'s' if n > 1 else ''} skipped ...)"


def merge_snippets(snippets: list[tuple], title: str = "") -> list[str]:
    """The snippets (seq_id, text[, headings]) of a document in reading order, with marks for gaps.

    Snippets of one place count once. Negative places are fallbacks: used if nothing else is
    there, or appended if neither contained nor containing. A text gets a line of the headings
    that aren't shown yet, aren't the title and don't begin the text.
    """
    rows = [(s[0], s[1].strip(), (s[2] if len(s) > 2 else "") or "") for s in snippets if s[1] and s[1].strip()]
    placed = sorted({r[0]: r for r in reversed(rows) if r[0] >= 0}.values())
    loose = [r for r in rows if r[0] < 0]
    runs = _joined(placed or loose)
    for seq, text, heads in loose if placed else ():
        if not any(text in x.text or x.text in text for x in runs):
            runs.append(_Run(seq, seq, heads, text))
    plain = lambda x: re.sub(r"[^\w]", "", x.lower())
    bare = lambda x: re.sub(r"^\s*#+\s*", "", x).strip()
    shown, out = {plain(title)}, []
    before = -1 if placed else None
    for run in runs:
        if before is not None and run.first >= 0 and (before >= 0 or not out):
            if run.first > before + 1:
                out.append(_skipped(run.first - before - 1))
        elif before is not None:
            out.append("(... chunks skipped ...)")
        before = run.last
        new = [p for p in map(bare, run.heads.split(">")) if plain(p) and plain(p) not in shown]
        shown |= set(map(plain, new))
        if new and plain(new[-1]) == plain(bare(run.text.split("\n", 1)[0])):
            new.pop()
        out.append(f"## {' > '.join(new)}\n\n{run.text}" if new else run.text)
    return out


def merged_snippets(hits: DataFrame, keys: tuple[str, ...] = ("query_id", "collection", "path")) -> DataFrame:
    """(keys, title, snippets) of hits with seq_id, text, headers and title: each document's snippets merged.

    A document's hits are gathered in one row: cut the hits first, as ``group_by_document`` does.
    """
    rows = hits.groupBy(*keys).agg(F.first("title").alias("title"), F.array_sort(F.collect_list(F.struct("seq_id", "text", "headers"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = [merge_snippets([(x["seq_id"], x["text"], x["headers"]) for x in found], title or "") for found, title in zip(batch.column("found").to_pylist(), batch.column("title").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "title")), pa.array(merged, pa.list_(pa.string()))], [*keys, "title", "snippets"])

    kinds = ", ".join(f"`{k}` {hits.schema[k].dataType.simpleString()}" for k in (*keys, "title"))
    return rows.mapInArrow(run, f"{kinds}, snippets array<string>")
