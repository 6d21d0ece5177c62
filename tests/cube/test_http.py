"""The server's answers and the client as a cube."""

import json
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pytest

from gridweave.catalogue import Relation
from gridweave.engine import Cube, SparkCube
from gridweave.http.client import DecodeFailed, InvalidUrl, RemoteCube, StatusFailed, TransportFailed
from gridweave.http.server import PREFIX, Server, handle
from gridweave.query import Axes, Members, Query, Tuple

from .fixtures import facts, month, place, plan, schema

ASK = Query(Axes.pivot(Members("Geography", "Default", "Country"), Members("Time", "Fiscal", "Year")), Tuple.of(plan("Actual")), ("amount", "Price"))


@pytest.fixture(scope="module")
def cube(spark):
    return SparkCube(facts(spark), schema())


@pytest.fixture(scope="module")
def server(cube):
    with Server(cube) as s:
        yield s


def test_remote_is_the_cube(cube, server):
    remote = RemoteCube.connect(server.url)
    assert isinstance(remote, Cube)
    assert remote.schema() == cube.schema() and remote.schema() is remote.schema()
    assert remote.query(ASK) == cube.query(ASK)
    for relation in (Relation("children"), Relation("descendants", 2), Relation("siblings"), Relation("leaves"), Relation("parent")):
        assert remote.members("Geography", "Default", place("North"), relation) == cube.members("Geography", "Default", place("North"), relation)


def test_statuses(cube, server):
    assert handle(cube, "GET", f"{PREFIX}/schema", b"")[0] == 200
    assert handle(cube, "GET", f"{PREFIX}/query", b"")[0] == 405
    assert handle(cube, "GET", "/", b"")[0] == 404
    for path, body in (("query", b"{"), ("query", b"[]"), ("members", b'{"dim": "Geography"}'), ("members", json.dumps({"dim": "Geography", "hierarchy": "Default", "at": place("North").to_json(), "relation": {"kind": "cousins"}}).encode())):
        assert handle(cube, "POST", f"{PREFIX}/{path}", body)[0] == 400
    wrong = Query(Axes.scalar(), Tuple.of(place("East")))
    status, data = handle(cube, "POST", f"{PREFIX}/query", json.dumps(wrong.to_json()).encode())
    assert status == 500 and "ResolveUnknownMember" in data["error"]
    with pytest.raises(HTTPError):
        urlopen(Request(f"{server.url}/nothing"))


def test_client_errors(server):
    for url in ("", "ftp://x", "http://"):
        with pytest.raises(InvalidUrl):
            RemoteCube(url)
    with pytest.raises(TransportFailed):
        RemoteCube("http://127.0.0.1:9", 2).schema()
    with pytest.raises(StatusFailed):
        RemoteCube(server.url).members("Time", "Fiscal", place("North"), Relation("children"))
    client = RemoteCube(server.url)
    with pytest.raises(DecodeFailed):
        client._call("schema", lambda _: month())


def test_relation_json():
    assert Relation("descendants", 2).to_json() == {"kind": "descendants", "depth": 2}
    assert Relation.from_json({"kind": "descendants", "depth": 2}) == Relation("descendants", 2)
