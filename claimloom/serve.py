"""A small SPARQL endpoint over HTTP: query by GET or POST, JSON results, CORS open."""

from __future__ import annotations

import json
import shutil
import tempfile
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame

from .config import Config
from .plans.parser import parse
from .plans.sparql import Compiler, bindings
from .sources.rdf import ntriples


def parts(triples: DataFrame, text: str, prefixes: dict[str, str]) -> tuple[str, Iterator[str]]:
    """(content type, the body in parts) of a query; the rows come a partition at a time, all of them."""
    q = parse(text, prefixes)
    if q.form == "SELECT":
        found = bindings(triples, text, prefixes)
        return "application/sparql-results+json", _results(found.names, found.frame)
    frame = Compiler(triples).run(q)
    if q.form == "ASK":
        return "application/sparql-results+json", iter([json.dumps({"head": {}, "boolean": bool(frame.first()[0])})])
    return "application/n-triples", (r[0] + "\n" for r in ntriples(frame).toLocalIterator())


def _results(names: list[str], frame: DataFrame) -> Iterator[str]:
    yield f'{{"head": {json.dumps({"vars": names})}, "results": {{"bindings": ['
    for k, r in enumerate(frame.toLocalIterator()):
        row = {}
        for n in names:
            t = r[n]
            if t is not None:
                cell = {"type": {"iri": "uri", "bnode": "bnode"}.get(t["kind"], "literal"), "value": t["v"]}
                cell |= {"xml:lang": t["lang"]} if t["lang"] else {"datatype": t["dt"]} if t["dt"] else {}
                row[n] = cell
        yield (", " if k else "") + json.dumps(row)
    yield "]}}"


def answer(triples: DataFrame, text: str, prefixes: dict[str, str]) -> tuple[str, str]:
    """(content type, body) of a query, with all its rows."""
    kind, body = parts(triples, text, prefixes)
    return kind, "".join(body)


def server(triples: DataFrame, config: Config, host: str = "127.0.0.1", port: int = 8000, title: str = "Claim graph", example: str = "") -> ThreadingHTTPServer:
    prefixes = {"": config.namespace} | config.prefixes
    example = example or "SELECT DISTINCT ?type WHERE { ?s a ?type } LIMIT 10"

    class Handler(BaseHTTPRequestHandler):
        def _head(self, code: int, kind: str, size: int) -> None:
            self.send_response(code)
            for k, v in (("Content-Type", f"{kind}; charset=utf-8"), ("Content-Length", str(size)), ("Access-Control-Allow-Origin", "*"), ("Access-Control-Allow-Headers", "*")):
                self.send_header(k, v)
            self.end_headers()

        def _send(self, code: int, kind: str, body: str) -> None:
            data = body.encode()
            self._head(code, kind, len(data))
            self.wfile.write(data)

        def _run(self, text: str | None) -> None:
            if not text:
                self._send(200, "application/json", json.dumps({"title": title, "example": example, "prefixes": prefixes}))
                return
            try:
                kind, body = parts(triples, text, prefixes)
                with tempfile.TemporaryFile() as f:  # whole before it is sent, and not in memory
                    for part in body:
                        f.write(part.encode())
                    self._head(200, kind, f.tell())
                    f.seek(0)
                    shutil.copyfileobj(f, self.wfile)
            except ValueError as e:
                self._send(400, "text/plain", str(e))

        def do_GET(self) -> None:
            self._run(parse_qs(urlparse(self.path).query).get("query", [None])[0])

        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0)).decode()
            form = "x-www-form-urlencoded" in (self.headers.get("Content-Type") or "")
            self._run(parse_qs(body).get("query", [None])[0] if form else body)

        def do_OPTIONS(self) -> None:
            self._send(204, "text/plain", "")

        def log_message(self, *_) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


