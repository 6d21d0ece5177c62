"""A cube that is served elsewhere."""

from __future__ import annotations

import json
from urllib.error import HTTPError, URLError
from urllib.parse import urlsplit
from urllib.request import Request, urlopen

from ..catalogue import Relation
from ..errors import CubeError, ParseError
from ..query import MemberRef, Query
from ..results import results_from_json
from ..schema import Schema
from .server import PREFIX


class RemoteError(CubeError):
    """What can go wrong between client and server."""


class InvalidUrl(RemoteError):
    template = "not a server's address: {url!r}"


class TransportFailed(RemoteError):
    template = "no answer from {url}: {reason}"


class StatusFailed(RemoteError):
    template = "{url} answered {status}: {body}"


class DecodeFailed(RemoteError):
    template = "the answer of {url} can't be read: {reason}"


class RemoteCube:
    """The same three methods over the wire; the schema is fetched once."""

    def __init__(self, url: str, timeout: float = 60.0):
        parts = urlsplit(url)
        if parts.scheme not in ("http", "https") or not parts.netloc:
            raise InvalidUrl(url=url)
        self.base, self.timeout = url.rstrip("/") + PREFIX, timeout
        self._schema: Schema | None = None

    @classmethod
    def connect(cls, url: str, timeout: float = 60.0) -> RemoteCube:
        """A client that has its schema already."""
        out = cls(url, timeout)
        out.schema()
        return out

    def _call(self, path: str, read, body: dict | None = None):
        url = f"{self.base}/{path}"
        raw = None if body is None else json.dumps(body).encode()
        request = Request(url, raw, {"Content-Type": "application/json"})
        try:
            with urlopen(request, timeout=self.timeout) as answer:
                text = answer.read()
        except HTTPError as e:
            raise StatusFailed(url=url, status=e.code, body=e.read().decode(errors="replace")) from None
        except (URLError, OSError) as e:
            raise TransportFailed(url=url, reason=e) from None
        try:
            return read(json.loads(text))
        except (ParseError, ValueError, KeyError, TypeError) as e:
            raise DecodeFailed(url=url, reason=e) from None

    def schema(self) -> Schema:
        if self._schema is None:
            self._schema = self._call("schema", Schema.from_json)
        return self._schema

    def query(self, query: Query):
        return self._call("query", results_from_json, query.to_json())

    def members(self, dim: str, hierarchy: str, at: MemberRef, relation: Relation) -> list[MemberRef]:
        body = {"dim": dim, "hierarchy": hierarchy, "at": at.to_json(), "relation": relation.to_json()}
        return self._call("members", lambda data: [MemberRef.from_json(m) for m in data], body)
