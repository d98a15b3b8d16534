"""A thin HTTP adapter: GET /, /version, /predicates, /query/<predicate>; POST /query."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from .engine import Engine
from .plans.validate import InvalidQuery

VERSION = "0.1.0"


def _failure(status: int, code: str, message: str) -> tuple[int, dict]:
    return status, {"error": {"code": code, "message": message}}


def _int(text: str | None) -> int | None:
    return int(text) if text is not None and text.isdigit() else None


def get(engine: Engine, target: str) -> tuple[int, dict]:
    """Status and body of a GET."""
    url = urlsplit(target)
    given = {k: v[0] for k, v in parse_qs(url.query).items()}
    if url.path == "/":
        return 200, {"status": "OK"}
    if url.path == "/version":
        return 200, {"version": VERSION, "name": "quillfact"}
    if url.path == "/predicates":
        if given.get("detailed") in ("true", "1"):
            names = [n.strip() for n in given["names"].split(",") if n.strip()] if "names" in given else None
            return 200, engine.describe(given.get("q"), names)
        return 200, engine.list_predicates(_int(given.get("samples")))
    if url.path.startswith("/query/"):
        try:
            return 200, engine.facts(unquote(url.path[7:]))
        except InvalidQuery as e:
            return _failure(400, "invalid_request", str(e))
    return _failure(404, "not_found", "No such route.")


def post(engine: Engine, target: str, body: bytes) -> tuple[int, dict]:
    """Status and body of a POST."""
    if urlsplit(target).path != "/query":
        return _failure(404, "not_found", "No such route.")
    try:
        asked = json.loads(body)
    except ValueError:
        return _failure(400, "malformed_request", "The request body is not valid JSON.")
    if not isinstance(asked, dict):
        return _failure(400, "malformed_request", "Expected a JSON object")
    if not isinstance(asked.get("query"), str):
        return _failure(400, "malformed_request", "Missing 'query' field")
    whole = {k: asked[k] for k in ("offset", "limit") if type(asked.get(k)) is int}
    words = {k: asked[k] for k in ("language", "action") if isinstance(asked.get(k), str)}
    out = engine.run_query(asked["query"], **words, **whole)
    return out.http_status, {"error": out.body} if out.status == "failed" else out.body


def serve(engine: Engine, port: int = 8080, host: str = "0.0.0.0") -> ThreadingHTTPServer:
    """A server, not yet running: call ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: dict) -> None:
            data = json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._answer(*get(engine, self.path))

        def do_POST(self):
            self._answer(*post(engine, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0))))

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer((host, port), Handler)
