"""Pages and JSON-RPC tools over an :class:`~heaplake.facade.Analysis`, on the standard library's server."""

from __future__ import annotations

import html
import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from .facade import Analysis, hex_text, parse_id
from .functions import dims

_IDS = {"object_id", "class_id", "from_object_id", "element_class_id", "dominator_id", "class_key", "super_class_id", "class_loader_id", "instances_key"}


def _cell(name: str, v: Any) -> str:
    if name in _IDS and isinstance(v, int):
        page = {"class_id": "instances", "class_key": "instances", "instances_key": "instances"}.get(name, "object")
        return f'<a href="/{page}/{hex_text(v)}">{hex_text(v)}</a>'
    return html.escape("" if v is None else str(v))


def _table(df: DataFrame) -> str:
    """A page of rows; callers limit it."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{_cell(c, v)}</td>" for c, v in zip(df.columns, r)) + "</tr>" for r in df.collect())
    return f"<table><tr>{head}</tr>{body}</table>"


def _facts(facts: dict[str, Any]) -> str:
    def show(k: str, v: Any) -> str:
        if isinstance(v, list):
            return "<br>".join(html.escape(str(x)) for x in v)
        return _cell(k, v)

    return "<table>" + "".join(f"<tr><th>{html.escape(k)}</th><td>{show(k, v)}</td></tr>" for k, v in facts.items()) + "</table>"


class NotFound(Exception):
    pass


def page(analysis: Analysis, path: str, query: dict[str, str]) -> str:
    """The content of one page; raises NotFound or ValueError."""
    a = analysis
    at, limit = int(query.get("offset", 0)), int(query.get("limit", dims.PAGE))
    match [p for p in path.split("/") if p]:
        case []:
            return _facts(a.summary())
        case ["allClasses"]:
            return _table(a.classes(at, limit))
        case ["histogram"]:
            return _table(a.histogram(dims.MAX_TOP_N))
        case ["class", i]:
            return _facts(a.class_detail(parse_id(i)) or _missing(i))
        case ["instances", i]:
            return _table(a.instances(parse_id(i), at, limit))
        case ["object", i]:
            return _facts(a.object_detail(parse_id(i)) or _missing(i))
        case ["object", i, "raw-string"]:
            text = a.string(parse_id(i))
            return html.escape(text) if text is not None else _missing(i)
        case ["object", i, "raw-array"]:
            return html.escape(a.array_text(parse_id(i)))
        case ["object", i, "root-path"]:
            return _facts(a.root_path(parse_id(i)))
        case ["arrays", kind]:
            return _table(a.arrays(kind, at, limit))
        case ["roots"]:
            return _table(a.root_counts())
        case ["roots", kind]:
            return _table(a.roots_page(kind, at, limit))
        case ["threads"]:
            return _table(a.threads())
        case ["thread", serial]:
            return _table(a.stack(int(serial)))
        case ["retained"]:
            return _table(a.retained(int(query.get("limit", dims.TOP_N))))
        case ["diff"]:
            return _table(a.diff(dims.MAX_TOP_N))
        case ["diff", "object", i] if a.other is not None:
            return _facts((Analysis(a.other, title=a.title).object_detail(parse_id(i)) or _missing(i)) | {"address_reused": a.address_reused(parse_id(i))})
        case ["diff", ("removed" | "added" | "common") as entry]:
            key = parse_id(query["class"]) if "class" in query else None
            changed = query["changed"] == "1" if "changed" in query else None
            return _table(a.diff_rows(entry, key, changed, at, limit))
    raise NotFound(path)


def _missing(what: str) -> Any:
    raise NotFound(what)


# --- tools ---------------------------------------------------------------------------------------------------------

_NUMBER, _TEXT, _FLAG = {"type": "integer"}, {"type": "string"}, {"type": "boolean"}
#: tool → (what it answers, arguments, required ones)
TOOLS: dict[str, tuple[str, dict[str, dict], list[str]]] = {
    "heap_summary": ("Objects, references, threads and roots of the dump.", {}, []),
    "class_histogram": ("The classes with most instances.", {"top_n": _NUMBER}, []),
    "find_object": ("Type, fields and roots of an object.", {"id": _TEXT}, ["id"]),
    "find_class_by_name": ("Classes by part of their name, or all of it.", {"name": _TEXT, "exact": _FLAG}, ["name"]),
    "back_references": ("Objects that refer to an object.", {"id": _TEXT}, ["id"]),
    "gc_roots": ("Roots of all types or of one.", {"type": _TEXT}, []),
    "resolve_string": ("The text of a string object.", {"id": _TEXT}, ["id"]),
    "heap_diff": ("The classes that differ most between the two dumps.", {"top_n": _NUMBER}, []),
    "retained_histogram": ("The objects that keep most memory alive.", {"top_n": _NUMBER}, []),
    "dominator_info": ("Dominator, retained size and dominated objects of an object.", {"id": _TEXT}, ["id"]),
}


def _lines(df: DataFrame) -> str:
    rows = [df.columns, *[[hex_text(v) if c in _IDS and isinstance(v, int) else str(v) for c, v in zip(df.columns, r)] for r in df.collect()]]
    return "\n".join("\t".join(r) for r in rows)


def call_tool(a: Analysis, name: str, args: dict[str, Any]) -> str:
    if name not in TOOLS:
        return f"Unknown tool: {name}"
    missing = [k for k in TOOLS[name][2] if k not in args]
    if missing:
        raise ValueError(f"missing {', '.join(missing)}")
    n = int(args.get("top_n", dims.TOP_N))
    match name:
        case "heap_summary":
            return json.dumps(a.summary())
        case "class_histogram":
            return _lines(a.histogram(n))
        case "find_object":
            found = a.object_detail(parse_id(args["id"]))
            return json.dumps(found) if found else f"Object {args['id']} not found"
        case "find_class_by_name":
            return _lines(a.find_classes(args["name"], bool(args.get("exact", False))))
        case "back_references":
            return _lines(a.referrers(parse_id(args["id"])))
        case "gc_roots":
            return _lines(a.roots(args.get("type")).select("root_type", "rank", "object_id", "total"))
        case "resolve_string":
            text = a.string(parse_id(args["id"]))
            return f"Object {args['id']} is no string" if text is None else text
        case "heap_diff":
            return "There is no second dump" if a.other is None else _lines(a.diff(n))
        case "retained_histogram":
            return _lines(a.retained(n))
        case _:
            return json.dumps(a.dominator_info(parse_id(args["id"])))


def rpc(analysis: Analysis, request: Any) -> dict[str, Any] | None:
    """The reply to one JSON-RPC request; None for notifications."""
    given = request if isinstance(request, dict) else {}
    i, method, params = given.get("id"), given.get("method"), given.get("params") or {}

    def fail(code: int, message: str) -> dict[str, Any]:
        return {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": message}}

    if given.get("jsonrpc") != "2.0":
        return fail(-32600, "Invalid request")
    if method == "initialize":
        result: Any = {"protocolVersion": "2025-03-26", "capabilities": {"tools": {}}, "serverInfo": {"name": "heaplake", "version": "0.1.0"}}
    elif method in ("initialized", "notifications/initialized"):
        return None if i is None else {"jsonrpc": "2.0", "id": i, "result": {}}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
    elif method == "tools/call":
        if not isinstance(params.get("name"), str):
            return fail(-32602, "Missing tool name")
        try:
            text = call_tool(analysis, params["name"], params.get("arguments") or {})
        except Exception as e:  # noqa: BLE001 - a tool's failure is the reply
            return fail(-32603, f"Tool error: {str(e)[:500]}")
        result = {"content": [{"type": "text", "text": text}]}
    else:
        return fail(-32601, f"Unknown method: {method}")
    return {"jsonrpc": "2.0", "id": i, "result": result}


def handler(analysis: Analysis) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def reply(self, code: int, body: str, kind: str) -> None:
            data = body.encode()
            self.send_response(code)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            parts = urlsplit(self.path)
            try:
                content = page(analysis, parts.path, {k: v[0] for k, v in parse_qs(parts.query).items()})
                self.reply(200, f"<!doctype html><title>{html.escape(analysis.title)}</title>{content}", "text/html")
            except NotFound as e:
                self.reply(404, f"Not found: {html.escape(str(e))}", "text/html")
            except ValueError as e:
                self.reply(400, html.escape(str(e)), "text/html")

        def do_POST(self) -> None:
            if urlsplit(self.path).path != "/mcp":
                self.reply(404, "{}", "application/json")
                return
            try:
                request = json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))))
            except ValueError:
                request = None
            answer = rpc(analysis, request)
            self.reply(202 if answer is None else 200, "" if answer is None else json.dumps(answer), "application/json")

        def log_message(self, *_: Any) -> None:
            pass

    return Handler


def serve(analysis: Analysis, port: int = 7000) -> None:
    ThreadingHTTPServer(("127.0.0.1", port), handler(analysis)).serve_forever()
