"""Results as XML, JSON or terminal text, on the driver: for limited results, given as dictionaries.

``render`` forms the same elements as columns where a result is large. Hits have
collection, path, seq_id, title, text, score, rank and, where known, headers and the scores and
ranks of both lists (fts, vec) and of the fusion (rrf).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import groupby
from typing import Any

from lodestone.functions.parse import SCHEME, lexical_terms

#: The program that commands in results name.
PROGRAM = "lodestone"
#: Gaps of more chunks than this have no command to read them.
EXPAND = 3
#: Characters of a text that the terminal shows.
SNIPPET = 2000

Row = dict[str, Any]


@dataclass(frozen=True)
class About:
    """What a result says of its request: session, seen chunks, what was left out, and what was cut."""

    query: str = ""
    session: str | None = None
    seen: int | None = None
    excluded_chunks: int = 0
    excluded_docs: int = 0
    omitted: int = 0
    cap: int = 0
    resume: str = ""

    def attributes(self) -> Row:
        own = {"session_id": self.session, "seen_chunks": self.seen, "next_query_hint": f"--session {self.session}"} if self.session else {}
        left = {"excluded_chunks": self.excluded_chunks, "excluded_docs": self.excluded_docs} if self.excluded_chunks else {}
        return own | left

    def cut(self, what: str) -> list[str]:
        if self.omitted <= 0:
            return []
        return [element("truncation", {f"omitted_{what}": self.omitted, "reason": f"max_chunks_per_response limit ({self.cap}) reached", "resume": self.resume or None}, indent=1)]


# -- pieces ---------------------------------------------------------------------------------------


def bare(text: Any) -> str:
    return re.sub("\x1b\\[[0-9;]*[a-zA-Z]", "", str(text))


def escaped(value: Any) -> str:
    out = bare(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = out.replace(a, b)
    return out


def element(name: str, attributes: Row, body: str | list[str] | None = None, *, indent: int = 0, inline: bool = False) -> str:
    """One element; attributes that are None are left out. Bodies of several lines go between the tags."""
    head = "".join(f' {k}="{escaped(v)}"' for k, v in attributes.items() if v is not None)
    pad = "  " * indent
    if body is None:
        return f"{pad}<{name}{head} />"
    if inline:
        return f"{pad}<{name}{head}>{body}</{name}>"
    return "\n".join([f"{pad}<{name}{head}>", *([body] if isinstance(body, str) else body), f"{pad}</{name}>"])


def uri(row: Row) -> str:
    return f"{SCHEME}{row['collection']}/{row['path']}" if row.get("collection") else row["path"]


def _target(row: Row, seqs: Any = None) -> str:
    base = f"{row['collection']}:{row['path']}" if row.get("collection") else row["path"]
    return base if seqs is None else f"{base}:{seqs}"


def _command(verb: str, target: str) -> str:
    return f"{PROGRAM} {verb} '{target}'"


def _span(a: int, b: int) -> str:
    return f"{a}-{b}" if a != b else f"{a}"


def _place(row: Row) -> Row:
    return {"collection": row.get("collection") or None, "path": row.get("path") or None}


def _details(row: Row) -> Row:
    out: Row = {}
    for k in ("fts", "vec", "rrf"):
        if row.get(f"{k}_score") is not None:
            out |= {f"{k}_score": f"{row[f'{k}_score']:.4f}", f"{k}_rank": row.get(f"{k}_rank")}
    return out


def _gap(row: Row, a: int, b: int, indent: int) -> str:
    """Chunks a to b that aren't shown."""
    expand = _command("read", _target(row, _span(a, b))) if b - a < EXPAND else None
    return element("gap", {"omitted_chunks": b - a + 1, "from_seq": a, "to_seq": b, "expand": expand}, indent=indent)


def _by_document(rows: list[Row]) -> list[tuple[Row, list[Row]]]:
    """Documents in order of appearance, each with its rows."""
    out: dict[tuple, list[Row]] = {}
    for r in rows:
        out.setdefault((r.get("collection") or "", r["path"]), []).append(r)
    return [(x[0], x) for x in out.values()]


# -- XML ------------------------------------------------------------------------------------------


def results_xml(hits: list[Row], about: About = About(), *, verbose: bool = False) -> str:
    """Flat hits with what is before and after them and how to read on."""
    body = []
    for i, h in enumerate(hits, 1):
        text, seq = bare(h["text"]).strip(), h["seq_id"]
        known = {"rank": h.get("rank") or i, "score": f"{h['score']:.4f}", "document": uri(h), **_place(h), "seq": seq, "chars": len(text), "title": h.get("title"), "section": h.get("headers") or "", "prev_seq": max(0, seq - 1), "next_seq": seq + 1, "read": _command("read", _target(h, seq)), "outline": _command("outline", _target(h))}
        body.append(element("result", known | (_details(h) if verbose else {}), text, indent=1))
    return element("search_results", {"query": about.query, "total_matches": len(hits)} | about.attributes(), body + about.cut("chunks"))


def documents_xml(documents: list[Row], about: About = About()) -> str:
    """Hits by document (with ``chunks``) in reading order, with the gaps between them."""
    body = []
    for d in documents:
        parts, end = [], -1
        for c in sorted({c["seq_id"]: c for c in reversed(d["chunks"])}.values(), key=lambda c: c["seq_id"]):
            seq, text = c["seq_id"], bare(c.get("text") or "").strip()
            if seq > end + 1:
                parts.append(_gap(d, end + 1, seq - 1, 2))
            known = {"seq": seq, "rank": c.get("rank"), "score": f"{c['score']:.4f}" if c.get("score") is not None else None, "chars": len(text), "section": c.get("headers") or None, "read": _command("read", _target(d, seq)), "outline": _command("outline", _target(d))}
            parts.append(element("chunk", known, text, indent=2))
            end = seq
        body.append(element("document", {"uri": uri(d), **_place(d), "title": d.get("title")}, parts, indent=1))
    total = sum(len(d["chunks"]) for d in documents)
    return element("search_results", {"query": about.query if documents else "", "total_matches": total, "total_documents": len(documents)} | about.attributes(), body + about.cut("chunks"))


def discover_xml(hits: list[Row], about: About = About(), *, verbose: bool = False) -> str:
    """The best hit of each document and how to go on from it."""
    body = []
    for i, h in enumerate(hits, 1):
        text = bare(h["text"]).strip()
        again = f'{PROGRAM} search "{about.query}"' + (f" -c '{h['collection']}'" if h.get("collection") else "") + f" -p '{h['path']}'"
        known = {"rank": h.get("rank") or i, "score": f"{h['score']:.4f}", "uri": uri(h), **_place(h), "title": h.get("title"), "top_chunk_seq": h["seq_id"], "match_count": h.get("match_count", 1), "chars": len(text), "section": h.get("headers") or "", "read": _command("read", _target(h, h["seq_id"])), "outline": _command("outline", _target(h)), "search": again}
        body.append(element("document", known | (_details(h) if verbose else {}), text, indent=1))
    return element("discover_results", {"query": about.query, "total_documents": len(hits)} | about.attributes(), body + about.cut("documents"))


def outline_xml(outline: Row | None) -> str:
    if not outline:
        return "<outline>\n</outline>"
    heads = [element("heading", {"level": h["level"], "start_seq": h["start_seq"], "end_seq": h["end_seq"], "char_count": h["char_count"], "read": _command("read", _target(outline, _span(h["start_seq"], h["end_seq"])))}, escaped(h["text"]), indent=1, inline=True) for h in outline["headings"]]
    return element("outline", {"uri": uri(outline), **_place(outline), "title": outline.get("title"), "total_chunks": outline["total_chunks"], "total_chars": outline["total_chars"]}, heads)


def chunks_xml(chunks: list[Row], about: About = About()) -> str:
    """Chunks as they were asked for, by document, with the gaps between them."""
    out = []
    for d, own in _by_document(chunks):
        parts, end = [], None
        for c in sorted(own, key=lambda c: c["seq_id"]):
            if end is not None and c["seq_id"] > end + 1:
                parts.append(_gap(d, end + 1, c["seq_id"] - 1, 1))
            text = bare(c["text"]).strip()
            parts.append(element("chunk", {"seq": c["seq_id"], "chars": len(text), "section": c.get("headers") or None}, text, indent=1))
            end = c["seq_id"]
        out.append(element("document", {"uri": uri(d), **_place(d), "title": d.get("title")}, parts + about.cut("chunks")))
    return "\n".join(out) or "<document>\n</document>"


def tree_xml(trees: list[Row]) -> str:
    def nodes(children: list[Row], indent: int) -> list[str]:
        out = []
        for c in children:
            if c["type"] == "directory":
                out.append(element("directory", {"name": c["name"]}, nodes(c["children"], indent + 1) or None, indent=indent))
            else:
                out.append(element("file", {"name": c["name"], "title": c.get("title") or None, "path": c.get("path") or None, "doc_id": c.get("doc_id")}, indent=indent))
        return out

    many = len(trees) > 1
    each = [element("collection_tree", {"collection": t["collection"]}, nodes(t["tree"]["children"], 1 + many), indent=int(many)) for t in trees]
    return element("collections", {}, each) if many or not trees else each[0]


def grep_xml(matches: list[Row], pattern: str, *, is_regex: bool = False, case_sensitive: bool = False) -> str:
    docs = _by_document(matches)
    body = [element("document", {"uri": uri(d), "title": d.get("title")}, [element("match", {"line": m["line_number"]}, escaped(m["line_text"]), indent=2, inline=True) for m in own], indent=1) for d, own in docs]
    known = {"pattern": pattern, "is_regex": str(is_regex).lower(), "case_sensitive": str(case_sensitive).lower(), "total_matches": len(matches), "total_documents": len(docs) if matches else None}
    return element("grep_results", known, body)


# -- JSON -----------------------------------------------------------------------------------------

_FIELDS = ("path", "title", "text", "score", "source", "collection", "seq_id", "headers")


def results_json(hits: list[Row], about: About = About(), *, verbose: bool = False) -> str:
    """Flat or discovered hits; those have a match_count."""
    out = []
    for h in hits:
        row = {k: h.get(k, "hybrid" if k == "source" else "") for k in _FIELDS} | ({"match_count": h["match_count"]} if "match_count" in h else {})
        row |= {"session_id": about.session, "excluded_count": about.excluded_chunks} if about.session else {}
        if verbose or h.get("fts_rank") is not None or h.get("vec_rank") is not None:
            row |= {f"{k}_{x}": h.get(f"{k}_{x}") for k in ("fts", "vec", "rrf") for x in ("score", "rank")}
        out.append(row)
    return json.dumps(out, indent=2, ensure_ascii=False, default=str)


def plain_json(value: Any) -> str:
    """Outlines, chunks, trees, matches and documents as they are."""
    return json.dumps(value, indent=2, ensure_ascii=False, default=str)


# -- terminal -------------------------------------------------------------------------------------


class Terminal:
    """Text for a terminal; without ``colour`` it has no escape sequences."""

    _CODES = {"dim": "2", "bold": "1", "green": "32", "cyan": "36", "yellow": "33", "magenta": "35", "red": "31"}

    def __init__(self, colour: bool = True):
        self.colour = colour

    def mark(self, kind: str, text: Any) -> str:
        return f"\x1b[{self._CODES[kind]}m{text}\x1b[0m" if self.colour else str(text)

    def highlighted(self, text: str, query: str) -> str:
        terms = sorted(lexical_terms(query), key=lambda t: (-len(t), t)) if self.colour else []
        return re.sub("(" + "|".join(map(re.escape, terms)) + ")", lambda m: self.mark("yellow", m[0]), text, flags=re.I) if terms else text

    def _begin(self, about: About) -> list[str]:
        if not about.session:
            return []
        left = f" | Excluded {about.excluded_chunks} previously seen chunk(s) across {about.excluded_docs} document(s)" if about.excluded_chunks else ""
        return [self.mark("dim", f"[Session: {about.session}{left}]")]

    def _end(self, about: About, what: str) -> list[str]:
        more = f" Next page: {about.resume}" if about.resume else ""
        return [self.mark("yellow", f"[... Truncated {about.omitted} remaining {what} to protect context.{more} ...]")] if about.omitted > 0 else []

    def _ranks(self, row: Row) -> str:
        part = lambda k: f"rank {row[f'{k}_rank']} (score {row[f'{k}_score']:.4f})" if row.get(f"{k}_rank") is not None and row.get(f"{k}_score") is not None else "N/A"
        return f"FTS: {part('fts')} | Vector: {part('vec')} | RRF: {part('rrf')}"

    def _title(self, i: int, row: Row, extra: str = "") -> str:
        section = self.mark("cyan", f" [{row['headers']}]") if row.get("headers") else ""
        return f"{self.mark('green', f'{i}.')} {self.mark('bold', row.get('title') or '')}{section}{extra} {self.mark('dim', f'({uri(row)})')}"

    def results(self, hits: list[Row], about: About = About(), *, verbose: bool = False) -> str:
        out = self._begin(about) + ([self.mark("dim", f"Found {len(hits)} chunks:")] if hits else [self.mark("red", "No results found.")])
        for i, h in enumerate(hits, 1):
            out += [self._title(i, h), "   " + self.highlighted(h["text"][:SNIPPET].replace("\n", " ") + "...", about.query), "   " + self.mark("dim", f"Score: {h['score']:.4f} | Source: {h.get('source', 'hybrid')} | Rank: {h.get('rank', i)}")]
            out += [f"   {self._ranks(h)}"] if verbose else []
        return "\n".join(out + self._end(about, "result chunk(s)"))

    def documents(self, documents: list[Row], about: About = About(), *, verbose: bool = False) -> str:
        """Documents with ``snippets``, merged in reading order, and ``chunks``."""
        out = self._begin(about) + ([self.mark("dim", f"Found {len(documents)} documents:")] if documents else [self.mark("red", "No documents found.")])
        for i, d in enumerate(documents, 1):
            out += [self._title(i, d), "   " + self.mark("dim", f"Max Score: {d['score']:.4f}")]
            out += [f"   Chunk seq {c['seq_id']} -> Score: {c['score']:.4f} | {self._ranks(c)}" for c in d.get("chunks", ())] if verbose else []
            out.append("   " + self.mark("dim", "--- Matches ---"))
            for s in d.get("snippets", ()):
                gap = s.startswith("(...") and s.endswith("...)")
                out += [self.mark("dim", f"   {s}") if gap else self.highlighted("\n".join("   " + x for x in s.split("\n")), about.query), ""]
        return "\n".join(out + self._end(about, "result chunk(s)"))

    def discovered(self, hits: list[Row], about: About = About(), *, verbose: bool = False) -> str:
        out = self._begin(about) + ([self.mark("dim", f"Discovered {len(hits)} document{'s' * (len(hits) != 1)}:")] if hits else [self.mark("red", "No documents discovered.")])
        for i, h in enumerate(hits, 1):
            n, text = h.get("match_count", 1), h["text"]
            badge = self.mark("magenta", f" ({n} matches in doc)") if n > 1 else ""
            out += [self._title(i, h, badge), "   " + self.highlighted(text[:SNIPPET].replace("\n", " ").strip() + "..." * (len(text) > SNIPPET), about.query), "   " + self.mark("dim", f"Score: {h['score']:.4f} | Source: {h.get('source', 'hybrid')} | Top Chunk Seq: {h['seq_id']} | Matches: {n}")]
            out += [f"   {self._ranks(h)}"] if verbose else []
        return "\n".join(out + self._end(about, "document(s)"))

    def outline(self, outline: Row | None) -> str:
        if not outline:
            return self.mark("red", "No outline available.")
        out = [f"{self.mark('bold', outline.get('title') or '')} {self.mark('dim', f'({uri(outline)})')}", self.mark("dim", f"Total Chunks: {outline['total_chunks']} | Total Chars: {outline['total_chars']}")]
        for h in outline["headings"]:
            span = _span(h["start_seq"], h["end_seq"])
            out.append(f"{'  ' * (h['level'] - 1)}{self.mark('cyan', '#' * h['level'])} {self.mark('bold', h['text'])} {self.mark('yellow', f'[seq: {span}]')} {self.mark('dim', f'({h["char_count"]} chars)')}")
        return "\n".join(out)

    def chunks(self, chunks: list[Row], about: About = About(), *, window: int = 0) -> str:
        if not chunks:
            return self.mark("red", "No chunks found.")
        docs = groupby(chunks, key=lambda c: (c.get("collection"), c["path"]))
        n = len({(c.get("collection"), c["path"]) for c in chunks})
        out = [self.mark("dim", f"Retrieved {len(chunks)} chunk(s){f' across {n} documents' if n > 1 else ''} (window: ±{window})")]
        for _, own in docs:
            for k, c in enumerate(own):
                out += [f"{self.mark('bold', c.get('title') or '')} {self.mark('dim', f'({uri(c)})')}"] if k == 0 else []
                out += [self.mark("green", f"Chunk {c['seq_id']}") + (self.mark("cyan", f" [{c['headers']}]") if c.get("headers") else ""), c["text"], ""]
        return "\n".join(out + self._end(about, "chunk(s)"))

    def tree(self, trees: list[Row]) -> str:
        if not trees:
            return self.mark("red", "No collections or documents found.")

        def below(children: list[Row], lead: str) -> list[str]:
            out = []
            for i, c in enumerate(children):
                last = i == len(children) - 1
                branch = lead + ("└── " if last else "├── ")
                if c["type"] == "directory":
                    out += [branch + self.mark("cyan", c["name"] + "/"), *below(c["children"], lead + ("    " if last else "│   "))]
                else:
                    other = self.mark("dim", f" ({c['title']})") if c.get("title") and c["title"] != c["name"] else ""
                    out.append(branch + self.mark("green", c["name"]) + other)
            return out

        return "\n\n".join("\n".join([self.mark("cyan", f"{t['collection']}/"), *below(t["tree"]["children"], "")]) for t in trees)

    def grep(self, matches: list[Row]) -> str:
        if not matches:
            return self.mark("red", "No matching patterns found.")
        out = [self.mark("dim", f"Found {len(matches)} match{'es' * (len(matches) != 1)}:")]
        for d, own in _by_document(matches):
            title = d.get("title")
            out.append(self.mark("green", uri(d)) + (" " + self.mark("bold", title) if title and title != d["path"] else ""))
            for m in own:
                text = m["line_text"].replace(m["match_text"], self.mark("yellow", m["match_text"])) if m.get("match_text") else m["line_text"]
                out.append(f"  {self.mark('cyan', f'{m["line_number"]:4d}:')} {text}")
        return "\n".join(out)
