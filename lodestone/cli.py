"""The command line: ``python -m lodestone.cli``. The same commands serve batches and the tool and web servers."""

from __future__ import annotations

import argparse
import json
import shlex
import sys
from typing import Any

from pyspark.sql import SparkSession

from lodestone.engine import Engine, asked_by
from lodestone.functions.parse import batch_commands
from lodestone.settings import load
from lodestone.sources import formats as out
from lodestone.sources.formats import PROGRAM, SCHEME, Terminal

GUIDE = f"""How to research with {PROGRAM}

1. Find documents: {PROGRAM} discover "query" shows the best hit of each; collections and tree show what there is.
2. Search: {PROGRAM} search "query" shows hits by document; --deep reranks, --broad boosts the best documents and folders,
   --session ID leaves out what that session has seen.
3. Find your way: {PROGRAM} outline "collection:path" shows headings and the chunks that they span.
4. Read: {PROGRAM} read "collection:path:10-15" shows chunks; what is cut names the command to read on.

Targets: {SCHEME}collection/path[:chunks], collection:path[:chunks], path[:chunks], or numbers of chunks such as 22,40,25-27.
Several commands may be given at once, between <commands> and </commands>, one on a line, five at most."""


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog=PROGRAM, description="Search and inspect collections of documents")
    top.add_argument("-C", "--config", help="settings file")
    subs = top.add_subparsers(dest="command", required=True)
    shown = argparse.ArgumentParser(add_help=False)
    for flags, text in ((("--xml", "--llm"), "XML"), (("--json",), "JSON"), (("--plain",), "no colours")):
        shown.add_argument(*flags, action="store_true", help=text)
    shown.add_argument("-c", "--collection", help="only this collection")

    def add(name: str, about: str, *aliases: str) -> argparse.ArgumentParser:
        return subs.add_parser(name, aliases=list(aliases), help=about, parents=[shown])

    for name, aliases, about in (("discover", ("find", "disc"), "the best hit of each document"), ("search", ("query", "q"), "hits by document")):
        p = add(name, about, *aliases)
        p.add_argument("query", nargs="+")
        p.add_argument("-p", "--path", help="part of the path, or several with commas")
        p.add_argument("-t", "--title", help="part of the title")
        p.add_argument("--lex", help="match expression that takes the place of the query's")
        p.add_argument("-r", "--rerank", "--deep", dest="deep", action="store_true", help="rerank")
        p.add_argument("--rerank-only", action="store_true", help="order by the reranker alone")
        p.add_argument("-w", "--w2n", "--broad", dest="broad", action="store_true", help="boost the best documents and folders")
        for flag in ("--limit", "--max-chunks", "--fts-limit", "--vec-limit", "--rerank-candidates"):
            p.add_argument(flag, type=int)
        p.add_argument("--session")
        p.add_argument("--exclude-seen", action="store_true")
        p.add_argument("--include-seen", action="store_true")
        p.add_argument("--redact-pii", "--redact", dest="redact", action="store_true", help="hide mail addresses and phone numbers")
        p.add_argument("--flat", "--chunks", dest="flat", action="store_true", help="single chunks")
        p.add_argument("-v", "--verbose", action="store_true")
    p = add("outline", "headings and the chunks that they span")
    p.add_argument("target")
    p = add("grep", "lines that match a pattern")
    p.add_argument("pattern")
    p.add_argument("-p", "--path")
    p.add_argument("--limit", type=int, default=50)
    q = add("tree", "folders and files")
    q.add_argument("name", nargs="?")
    q.add_argument("-p", "--pattern")
    q.add_argument("--depth", type=int)
    for x in (p, q):
        x.add_argument("-r", "--regex", action="store_true")
        x.add_argument("-s", "--case-sensitive", action="store_true")
        x.add_argument("-i", "--ignore-case", action="store_true")
    p = add("read", "chunks", "chunk", "get", "view")
    p.add_argument("target")
    p.add_argument("--seq")
    p.add_argument("-w", "--window", type=int, default=0)
    p.add_argument("--max-chunks", type=int)
    add("collections", "configured collections", "colls")
    add("session", "what a session has asked and seen").add_argument("id")
    add("guide", "how to use this program")
    p = add("update", "bring the index up to date")
    p.add_argument("-f", "--force", action="store_true")
    p = add("batch", "commands in free text")
    p.add_argument("text")
    p = add("serve", "web requests")
    p.add_argument("--port", type=int, default=5000)
    add("tools", "a tool server over standard input and output")
    return top


def _case(a: argparse.Namespace) -> bool:
    return a.case_sensitive and not a.ignore_case


def execute(engine: Engine, a: argparse.Namespace) -> str:
    """One command's output. Raises ValueError for a request that can't be met, LookupError for what isn't there."""
    xml = a.xml or (engine.settings.xml and not a.json)
    term = Terminal(not a.plain)
    known = vars(a)
    match a.command:
        case "discover" | "find" | "disc" | "search" | "query" | "q":
            mode = "discover" if a.command in ("discover", "find", "disc") else "search"
            hits, about = engine.find(" ".join(a.query), mode=mode, candidates=a.rerank_candidates, **asked_by(known, "limit", "collection", "title", "path", "lex", "deep", "rerank_only", "broad", "session", "include_seen", "exclude_seen", "fts_limit", "vec_limit", "max_chunks", "redact"))
            if mode == "discover":
                return out.results_json(hits, about, verbose=a.verbose) if a.json else out.discover_xml(hits, about, verbose=a.verbose) if xml else term.discovered(hits, about, verbose=a.verbose)
            if a.flat:
                return out.results_json(hits, about, verbose=a.verbose) if a.json else out.results_xml(hits, about, verbose=a.verbose) if xml else term.results(hits, about, verbose=a.verbose)
            docs = engine.by_document(hits)
            return out.plain_json([d | {"session_id": about.session, "excluded_count": about.excluded_chunks} for d in docs]) if a.json else out.documents_xml(docs, about) if xml else term.documents(docs, about, verbose=a.verbose)
        case "outline":
            found = engine.outline(a.target, a.collection)
            if not found:
                raise LookupError(f"no document matches {a.target!r}")
            return out.plain_json(found) if a.json else out.outline_xml(found) if xml else term.outline(found)
        case "grep":
            rows = engine.grep(a.pattern, is_regex=a.regex, case_sensitive=_case(a), collection=a.collection, path=a.path, limit=a.limit)
            return out.plain_json(rows) if a.json else out.grep_xml(rows, a.pattern, is_regex=a.regex, case_sensitive=_case(a)) if xml else term.grep(rows)
        case "read" | "chunk" | "get" | "view":
            rows, about = engine.read(a.target, **asked_by(known, "seq", "window", "collection", "max_chunks"))
            if not rows:
                raise LookupError("no such chunk")
            return out.plain_json(rows) if a.json else out.chunks_xml(rows, about) if xml else term.chunks(rows, about, window=a.window)
        case "tree":
            name = a.name or a.collection
            trees = engine.tree(name, max_depth=a.depth, pattern=a.pattern, is_regex=a.regex, case_sensitive=_case(a))
            if name and not trees:
                raise LookupError(f"no collection {name!r}")
            return out.plain_json(trees[0] if name else trees) if a.json else out.tree_xml(trees) if xml else term.tree(trees)
        case "collections" | "colls":
            rows = engine.collections()
            return out.plain_json(rows) if a.json else "\n".join(f"{r['collection']}: {r['folder']} ({r['documents']} documents)" for r in rows)
        case "session":
            return out.plain_json(engine.session(a.id))
        case "guide":
            return out.element("guide", {}, out.escaped(GUIDE)) if xml else GUIDE
        case "update":
            return json.dumps(engine.update(a.collection, force=a.force))
        case "batch":
            return batch(engine, a.text)
    raise ValueError(f"{a.command} can't be run here")


def run_line(engine: Engine, line: str) -> tuple[bool, str]:
    """(whether it worked, output) of one command line, in XML."""
    words = shlex.split(line)
    if words and words[0] == PROGRAM:
        words = words[1:]
    try:
        a = _parser().parse_args(words)
        a.xml = not a.json
        return True, execute(engine, a)
    except SystemExit:
        return False, f"Error: {line!r} is no command; see {PROGRAM} guide"
    except (ValueError, LookupError) as e:
        return False, f"Error: {e}"


def batch(engine: Engine, text: str, most: int = 5) -> str:
    """The commands of a free text, one after the other, in one bundle."""
    parts = []
    for k, line in enumerate(batch_commands(text, PROGRAM, most), 1):
        fine, said = run_line(engine, line)
        parts.append(out.element("command_result", {"index": k, "command": line, "status": "success" if fine else "error"}, said, indent=1))
    return out.element("batch_results", {"total": len(parts)}, parts)


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    if a.command == "guide":
        print(GUIDE)
        return 0
    spark = SparkSession.builder.appName(PROGRAM).getOrCreate()
    engine: Any = Engine(spark, load(a.config))
    try:
        if a.command in ("serve", "tools"):
            from lodestone import server

            server.web(engine, a.port) if a.command == "serve" else server.tools(engine)
            return 0
        print(execute(engine, a))
        return 0
    except (ValueError, LookupError) as e:
        print(json.dumps({"error": str(e)}) if a.json else f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
