"""Web requests as JSON, and a tool server that takes one command a line; both over the engine."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any, TextIO
from urllib.parse import parse_qs, urlparse

from lodestone import cli
from lodestone.engine import Engine, asked_by

_FIND = ("limit", "collection", "title", "path", "lex", "deep", "rerank_only", "broad", "session", "include_seen", "exclude_seen", "fts_limit", "vec_limit", "candidates", "max_chunks", "redact")


def _need(values: dict[str, Any], name: str) -> Any:
    if not values.get(name):
        raise ValueError(f"{name} is missing")
    return values[name]


def _found(value: Any) -> Any:
    if not value:
        raise LookupError("not found")
    return value


def _hits(engine: Engine, q: dict[str, Any], mode: str) -> dict[str, Any]:
    hits, about = engine.find(_need(q, "query"), mode=mode, **asked_by(q, *_FIND))
    shown = engine.by_document(hits) if mode == "search" and not q.get("flat") else hits
    return {"results": shown, "session_id": about.session, "excluded_chunks": about.excluded_chunks, "omitted": about.omitted}


#: What each address does with its parameters.
ROUTES: dict[tuple[str, str], Callable[[Engine, dict[str, Any]], Any]] = {
    ("POST", "/api/discover"): lambda e, q: _hits(e, q, "discover"),
    ("POST", "/api/search"): lambda e, q: _hits(e, q, "search"),
    ("POST", "/api/grep"): lambda e, q: {"results": e.grep(_need(q, "pattern"), is_regex=bool(q.get("regex")), case_sensitive=bool(q.get("case_sensitive")), collection=q.get("collection"), path=q.get("path"), limit=int(q.get("limit") or 50))},
    ("POST", "/api/update"): lambda e, q: e.update(q.get("collection"), force=bool(q.get("force"))),
    ("POST", "/api/batch"): lambda e, q: {"output": cli.batch(e, _need(q, "commands"))},
    ("GET", "/api/outline"): lambda e, q: _found(e.outline(_need(q, "path"), q.get("collection"))),
    ("GET", "/api/chunk"): lambda e, q: {"chunks": _found(e.read(_need(q, "target"), window=int(q.get("window") or 0), **asked_by(q, "seq", "collection"))[0])},
    ("GET", "/api/document"): lambda e, q: _found(e.document(q.get("collection"), _need(q, "path"))),
    ("GET", "/api/session"): lambda e, q: e.session(_need(q, "id")),
    ("GET", "/api/collections"): lambda e, q: e.collections(),
    ("GET", "/api/collections/tree"): lambda e, q: e.tree(q.get("collection"), pattern=q.get("pattern"), is_regex=bool(q.get("regex")), max_depth=int(q["depth"]) if q.get("depth") else None),
    ("GET", "/api/guide"): lambda e, q: {"guide": cli.GUIDE},
}


def answer(engine: Engine, method: str, address: str, body: bytes = b"") -> tuple[int, Any]:
    """(status, JSON value) of a request."""
    at = urlparse(address)
    action = ROUTES.get((method, at.path))
    if not action:
        return 404, {"error": f"no {method} {at.path}"}
    try:
        given = {k: v[-1] for k, v in parse_qs(at.query).items()} | (json.loads(body) if body else {})
        return 200, action(engine, given)
    except LookupError as e:
        return 404, {"error": str(e)}
    except ValueError as e:
        return 400, {"error": str(e)}


def web(engine: Engine, port: int = 5000) -> None:
    """Serves requests of this machine until it is interrupted."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            status, value = answer(engine, self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
            data = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

    with ThreadingHTTPServer(("127.0.0.1", port), Handler) as server:
        server.serve_forever()


_TOOL = {"name": cli.PROGRAM, "description": cli.GUIDE, "inputSchema": {"type": "object", "properties": {"command": {"type": "string"}}, "required": ["command"]}}


def reply(engine: Engine, message: dict[str, Any]) -> dict[str, Any] | None:
    """The answer to one JSON-RPC message; None for notices."""
    if "id" not in message:
        return None
    method, given = message.get("method"), message.get("params") or {}
    if method == "initialize":
        result: dict[str, Any] = {"protocolVersion": given.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": cli.PROGRAM, "version": "1"}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [_TOOL]}
    elif method == "tools/call" and given.get("name") == cli.PROGRAM:
        fine, said = cli.run_line(engine, str((given.get("arguments") or {}).get("command", "")))
        result = {"content": [{"type": "text", "text": said}], "isError": not fine}
    else:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": -32601, "message": f"no method {method!r}"}}
    return {"jsonrpc": "2.0", "id": message["id"], "result": result}


def tools(engine: Engine, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
    """Answers JSON-RPC messages, one a line, until the input ends."""
    for line in source:
        if line.strip():
            said = reply(engine, json.loads(line))
            if said is not None:
                print(json.dumps(said), file=sink, flush=True)
