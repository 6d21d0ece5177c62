"""Results: cells that are valid, missing or in error, in one of four shapes."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import MalformedJson
from .query import MemberRef, Tuple

NO_FACTS, UNBOUND_SCENARIO, NOT_APPLICABLE = "no_facts", "unbound_scenario", "not_applicable"


@dataclass(frozen=True)
class Cell:
    state: str
    value: float | None = None
    unit: str | None = None
    format: str | None = None
    reason: str | None = None
    message: str | None = None

    @classmethod
    def valid(cls, value: float, unit: str | None = None, format: str | None = None) -> Cell:
        return cls("valid", float(value), unit, format)

    @classmethod
    def missing(cls, reason: str = NO_FACTS) -> Cell:
        return cls("missing", reason=reason)

    @classmethod
    def error(cls, message: str) -> Cell:
        return cls("error", message=message)

    def score(self) -> float:
        """What ordering compares: the value, or minus infinity."""
        return self.value if self.state == "valid" else float("-inf")

    def to_json(self) -> dict:
        if self.state == "valid":
            return {"state": "valid", "value": self.value, "unit": self.unit, "format": self.format}
        if self.state == "missing":
            return {"state": "missing", "reason": {"kind": self.reason}}
        return {"state": "error", "message": self.message}

    @classmethod
    def from_json(cls, data: dict) -> Cell:
        if data["state"] == "valid":
            return cls.valid(data["value"], data.get("unit"), data.get("format"))
        if data["state"] == "missing":
            return cls.missing(data["reason"]["kind"])
        return cls.error(data["message"])


@dataclass(frozen=True)
class Scalar:
    tuple: Tuple
    values: list[Cell]

    def to_json(self) -> dict:
        return {"scalar": {"tuple": self.tuple.to_json(), "values": [c.to_json() for c in self.values]}}


@dataclass(frozen=True)
class Row:
    label: str
    values: list[Cell]


@dataclass(frozen=True)
class Series:
    x: list[MemberRef]
    rows: list[Row]

    def to_json(self) -> dict:
        rows = [{"label": r.label, "values": [c.to_json() for c in r.values]} for r in self.rows]
        return {"series": {"x": [m.to_json() for m in self.x], "rows": rows}}


@dataclass(frozen=True)
class Pivot:
    row_headers: list[Tuple]
    col_headers: list[Tuple]
    cells: list[list[Cell]]

    def to_json(self) -> dict:
        return {
            "pivot": {
                "row_headers": [t.to_json() for t in self.row_headers],
                "col_headers": [t.to_json() for t in self.col_headers],
                "cells": [[c.to_json() for c in row] for row in self.cells],
            }
        }


@dataclass
class Rollup:
    root: MemberRef
    value: Cell
    children: list[Rollup] = field(default_factory=list)

    def _json(self) -> dict:
        return {"root": self.root.to_json(), "value": self.value.to_json(), "children": [c._json() for c in self.children]}

    def to_json(self) -> dict:
        return {"rollup": self._json()}

    @classmethod
    def _from(cls, data: dict) -> Rollup:
        return cls(MemberRef.from_json(data["root"]), Cell.from_json(data["value"]), [cls._from(c) for c in data["children"]])


def results_from_json(data: dict):
    if not isinstance(data, dict) or len(data) != 1:
        raise MalformedJson(what="results", why="not one shape")
    (shape, body), cells = next(iter(data.items())), lambda xs: [Cell.from_json(c) for c in xs]
    if shape == "scalar":
        return Scalar(Tuple.from_json(body["tuple"]), cells(body["values"]))
    if shape == "series":
        return Series([MemberRef.from_json(m) for m in body["x"]], [Row(r["label"], cells(r["values"])) for r in body["rows"]])
    if shape == "pivot":
        headers = ([Tuple.from_json(t) for t in body[k]] for k in ("row_headers", "col_headers"))
        return Pivot(*headers, [cells(row) for row in body["cells"]])
    if shape == "rollup":
        return Rollup._from(body)
    raise MalformedJson(what="results", why=f"shape {shape!r}")
