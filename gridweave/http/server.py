"""GET schema, POST query and POST members under /api/v1/cube, with the standard library's server.

A body that can't be parsed gives 400, a fault of the cube 500, both with {"error": text}. Requests run in
threads of their own; Spark runs their jobs side by side.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

from ..catalogue import Relation
from ..engine import Cube
from ..errors import CubeError, ParseError, UnsupportedRelation
from ..query import MemberRef, Query

PREFIX = "/api/v1/cube"


class BadRequest(Exception):
    pass


def schema(cube: Cube, _: bytes) -> object:
    return cube.schema().to_json()


def query(cube: Cube, body: bytes) -> object:
    return cube.query(_parsed(body, Query.from_json)).to_json()


def members(cube: Cube, body: bytes) -> object:
    def request(data: dict):
        return data["dim"], data["hierarchy"], MemberRef.from_json(data["at"]), Relation.from_json(data["relation"])

    return [m.to_json() for m in cube.members(*_parsed(body, request))]


def _parsed(body: bytes, parse):
    try:
        return parse(json.loads(body))
    except (ParseError, UnsupportedRelation, ValueError, KeyError, TypeError, AttributeError) as e:
        raise BadRequest(f"{type(e).__name__}: {e}") from None


ROUTES = {("GET", f"{PREFIX}/schema"): schema, ("POST", f"{PREFIX}/query"): query, ("POST", f"{PREFIX}/members"): members}


def handle(cube: Cube, method: str, path: str, body: bytes) -> tuple[int, object]:
    route = ROUTES.get((method, path))
    if route is None:
        known = any(p == path for _, p in ROUTES)
        return (405 if known else 404), {"error": f"no {method} {path}"}
    try:
        return 200, route(cube, body)
    except BadRequest as e:
        return 400, {"error": str(e)}
    except CubeError as e:
        return 500, {"error": f"{e.kind}: {e}"}


def _handler(cube: Cube):
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, data = handle(cube, self.command, self.path, body)
            except Exception as e:  # noqa: BLE001  the connection must get an answer
                status, data = 500, {"error": f"{type(e).__name__}: {e}"}
            raw = json.dumps(data).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer  # noqa: N815

        def log_message(self, *_) -> None:
            pass

    return Handler


class Server:
    """Serves a cube from a thread until closed; port 0 takes any free one."""

    def __init__(self, cube: Cube, host: str = "127.0.0.1", port: int = 0):
        self.http = ThreadingHTTPServer((host, port), _handler(cube))
        self.url = f"http://{host}:{self.http.server_address[1]}"
        self.thread = Thread(target=self.http.serve_forever, daemon=True)
        self.thread.start()

    def close(self) -> None:
        self.http.shutdown()
        self.http.server_close()

    def __enter__(self) -> Server:
        return self

    def __exit__(self, *_) -> None:
        self.close()
