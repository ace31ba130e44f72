"""A thin HTTP shim over the in-process services."""

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from logweir.service.console import CONSOLE
from logweir.service.query import ApiError, QueryRequest
from logweir.sources.push import BadEvent, push


def make_server(queries, jobs, data_dir: str, metrics, ready=lambda: True, port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *_):
            pass

        def _send(self, status, body=b"", kind="application/json", headers=None):
            data = body if isinstance(body, bytes) else json.dumps(body).encode()
            self.send_response(status)
            for k, v in {"Content-Type": kind, "Content-Length": str(len(data)), **(headers or {})}.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def _guard(self, work):
            try:
                work()
            except ApiError as e:
                self._send(e.status, e.body, headers=e.headers)
            except (BadEvent, KeyError, ValueError) as e:
                self._send(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001
                self._send(500, {"error": str(e)})

        def _body(self):
            return json.loads(self.rfile.read(int(self.headers.get("Content-Length", 0))) or b"{}")

        def _query(self):
            lines = queries.run(QueryRequest.of(self._body()))
            self.send_response(200)
            self.send_header("Content-Type", "application/x-ndjson")
            self.end_headers()
            for line in lines:
                self.wfile.write(line.encode() + b"\n")

        def do_POST(self):
            if self.path == "/query":
                self._guard(self._query)
            elif self.path == "/jobs":
                self._guard(lambda: self._send(202, {"job_id": jobs.submit(QueryRequest.of(self._body()), self.client_address[0])}))
            elif self.path == "/ingest":
                self._guard(lambda: (push(queries.spark, self._body(), data_dir, queries.catalog, metrics), self._send(204)))
            else:
                self._send(404, {"error": "not found"})

        def do_GET(self):
            url = urlparse(self.path)
            parts, args = url.path.strip("/").split("/"), {k: v[0] for k, v in parse_qs(url.query).items()}
            if url.path == "/health":
                self._send(200, {"status": "ok"})
            elif url.path == "/ready":
                self._send(200 if ready() else 503, {"ready": bool(ready())})
            elif url.path == "/metrics":
                self._send(200, metrics.expose().encode(), "text/plain; version=0.0.4")
            elif parts[0] == "jobs" and len(parts) == 2:
                self._guard(lambda: self._send(200, jobs.get(parts[1])))
            elif parts[0] == "jobs" and len(parts) == 3 and parts[2] == "results":
                self._guard(lambda: self._send(200, jobs.results(parts[1], int(args.get("page", 0)), int(args.get("page_size", 100)))))
            else:  # a page of the console, which does its own routing
                self._send(200, CONSOLE.encode(), "text/html; charset=utf-8")

        def do_DELETE(self):
            parts = self.path.strip("/").split("/")
            self._guard(lambda: (jobs.delete(parts[1]), self._send(204)) if parts[0] == "jobs" and len(parts) == 2 else self._send(404, {"error": "not found"}))

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
