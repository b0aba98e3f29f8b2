"""A small HTTP service over flows, on the standard library alone."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from indexflow import flow as flows

PAGE = 1000


def _key(query: dict[str, list[str]], f: flows.Flow, source: str) -> str:
    """The source key, as stored, of the parts given as key=..."""
    from indexflow.codec import key_from_parts
    from indexflow.types import key_type

    b = f.builder()
    names, fields = b.source_keys(source), b.sources[source][1]
    value = key_from_parts(query.get("key", []), key_type([(n, fields.get(n)) for n in names]))
    values = [value] if len(names) == 1 else [value[n] for n in names]
    return json.dumps(dict(zip(names, values, strict=True)), ensure_ascii=False, separators=(",", ":"), default=str)


def list_flows(query: dict) -> Any:
    return flows.flow_names()


def get_spec(query: dict, name: str) -> Any:
    return flows.flow_by_name(name).spec()


def get_schema(query: dict, name: str) -> Any:
    return flows.flow_by_name(name).schema()


def get_keys(query: dict, name: str) -> Any:
    """Keys of a source in order, a page at a time: ``after`` is the last key of the page before."""
    keys = flows.flow_by_name(name).source_keys(query["field"][0])
    column = keys.columns[0]
    if "after" in query:
        keys = keys.where(F.col(column) > query["after"][0])
    return [json.loads(r[0]) for r in keys.orderBy(column).limit(PAGE).collect()]


def get_data(query: dict, name: str) -> Any:
    f, source = flows.flow_by_name(name), query["field"][0]
    return f.evaluate_row(source, _key(query, f, source))


def get_row_status(query: dict, name: str) -> Any:
    f, source = flows.flow_by_name(name), query["field"][0]
    row = f.row_status(source).where(F.col("__skey") == _key(query, f, source)).first()
    return None if row is None else row.asDict()


def post_update(query: dict, name: str) -> Any:
    return {n: vars(s) for n, s in flows.flow_by_name(name).update().sources.items()}


ROUTES: list[tuple[str, str, Callable[..., Any]]] = [
    ("GET", r"/api/flows", list_flows),
    ("GET", r"/api/flows/(\w+)", get_spec),
    ("GET", r"/api/flows/(\w+)/schema", get_schema),
    ("GET", r"/api/flows/(\w+)/keys", get_keys),
    ("GET", r"/api/flows/(\w+)/data", get_data),
    ("GET", r"/api/flows/(\w+)/rowStatus", get_row_status),
    ("POST", r"/api/flows/(\w+)/update", post_update),
]


def respond(method: str, target: str) -> tuple[int, Any]:
    """Status and body of a request."""
    url = urlparse(target)
    for verb, pattern, handler in ROUTES:
        m = re.fullmatch(pattern, url.path.rstrip("/"))
        if m and verb == method:
            try:
                return 200, handler(parse_qs(url.query), *m.groups())
            except KeyError as bad:
                return 404, {"error": f"not found: {bad}"}
            except ValueError as bad:
                return 400, {"error": str(bad)}
    return 404, {"error": "no such route"}


class Handler(BaseHTTPRequestHandler):
    cors_origins: tuple[str, ...] = ()

    def _answer(self, method: str) -> None:
        status, body = respond(method, self.path)
        data = json.dumps(body, default=str).encode()
        self.send_response(status)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        if (origin := self.headers.get("Origin")) in self.cors_origins:
            self.send_header("Access-Control-Allow-Origin", origin)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self) -> None:  # noqa: N802
        self._answer("GET")

    def do_POST(self) -> None:  # noqa: N802
        self._answer("POST")

    def log_message(self, *_: Any) -> None:
        return None


def serve(host: str = "127.0.0.1", port: int = 49344, cors_origins: tuple[str, ...] = ()) -> ThreadingHTTPServer:
    """A server that is ready for serve_forever()."""
    return ThreadingHTTPServer((host, port), type("Routes", (Handler,), {"cors_origins": cors_origins}))
