"""Queries: coordinates, the set algebra of axes, predicates, axis shapes and options."""

from __future__ import annotations

from dataclasses import dataclass, field

from .errors import EmptyExplicit, EmptyPath, MalformedJson, RepeatedDimension
from .names import name


def tagged(data, tag: str, what: str) -> str:
    if not isinstance(data, dict) or tag not in data:
        raise MalformedJson(what=what, why=f"no {tag!r}")
    return data[tag]


def path(*segments: str) -> tuple[str, ...]:
    """Member names from the top level down; at least one."""
    if not segments:
        raise EmptyPath()
    return tuple(name(s) for s in segments)


@dataclass(frozen=True)
class MemberRef:
    """A member by dimension, hierarchy and path."""

    dim: str
    hierarchy: str
    path: tuple[str, ...]

    def __post_init__(self):
        name(self.dim), name(self.hierarchy)
        object.__setattr__(self, "path", path(*self.path))

    @classmethod
    def of(cls, dim: str, hierarchy: str, *segments: str) -> MemberRef:
        return cls(dim, hierarchy, segments)

    @classmethod
    def scenario(cls, *segments: str) -> MemberRef:
        return cls("Scenario", "Default", segments)

    @classmethod
    def time(cls, *segments: str) -> MemberRef:
        return cls("Time", "Fiscal", segments)

    @classmethod
    def world(cls, *segments: str) -> MemberRef:
        return cls("Geography", "World", segments)

    def children(self) -> Set:
        return Explicit((self,)).children()

    def descendants_to(self, level: str) -> Set:
        return Explicit((self,)).descendants_to(level)

    def range_to(self, end: MemberRef) -> Set:
        return Range(self.dim, self.hierarchy, self, end)

    def to_json(self) -> dict:
        return {"dim": self.dim, "hierarchy": self.hierarchy, "path": list(self.path)}

    @classmethod
    def from_json(cls, data: dict) -> MemberRef:
        try:
            return cls(data["dim"], data["hierarchy"], tuple(data["path"]))
        except (KeyError, TypeError) as e:
            raise MalformedJson(what="member", why=str(e)) from None


@dataclass(frozen=True)
class Tuple:
    """Members of different dimensions, in order; may be empty."""

    members: tuple[MemberRef, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "members", tuple(self.members))
        seen: set[str] = set()
        for m in self.members:
            if m.dim in seen:
                raise RepeatedDimension(dim=m.dim)
            seen.add(m.dim)

    @classmethod
    def of(cls, *members: MemberRef) -> Tuple:
        return cls(members)

    def member(self, dim: str) -> MemberRef | None:
        return next((m for m in self.members if m.dim == dim), None)

    def to_json(self) -> list:
        return [m.to_json() for m in self.members]

    @classmethod
    def from_json(cls, data: list) -> Tuple:
        return cls(tuple(MemberRef.from_json(m) for m in data))

    def __str__(self) -> str:
        return " × ".join("/".join(m.path) for m in self.members)


# --- sets


class Set:
    """An ordered list of tuples, by formula."""

    def children(self) -> Set:
        return Children(self)

    def descendants_to(self, level: str) -> Set:
        return Descendants(self, level)

    def filter(self, pred: Predicate) -> Set:
        return Filter(self, pred)

    def top(self, n: int, by: str) -> Set:
        return TopN(self, n, by)

    def cross(self, other: Set) -> Set:
        return CrossJoin(self, other)

    def union(self, other: Set) -> Set:
        return Union(self, other)


@dataclass(frozen=True)
class Members(Set):
    dim: str
    hierarchy: str
    level: str

    def to_json(self) -> dict:
        return {"op": "members", "dim": self.dim, "hierarchy": self.hierarchy, "level": self.level}


@dataclass(frozen=True)
class Range(Set):
    dim: str
    hierarchy: str
    start: MemberRef
    end: MemberRef

    def to_json(self) -> dict:
        return {"op": "range", "dim": self.dim, "hierarchy": self.hierarchy, "from": self.start.to_json(), "to": self.end.to_json()}


@dataclass(frozen=True)
class Named(Set):
    name: str

    def to_json(self) -> dict:
        return {"op": "named", "name": self.name}


@dataclass(frozen=True)
class Explicit(Set):
    members: tuple[MemberRef, ...]

    def to_json(self) -> dict:
        return {"op": "explicit", "members": [m.to_json() for m in self.members]}


def explicit(*members: MemberRef) -> Explicit:
    if not members:
        raise EmptyExplicit()
    return Explicit(tuple(members))


@dataclass(frozen=True)
class Children(Set):
    of: Set

    def to_json(self) -> dict:
        return {"op": "children", "of": self.of.to_json()}


@dataclass(frozen=True)
class Descendants(Set):
    of: Set
    to_level: str

    def to_json(self) -> dict:
        return {"op": "descendants", "of": self.of.to_json(), "to_level": self.to_level}


@dataclass(frozen=True)
class CrossJoin(Set):
    left: Set
    right: Set

    def to_json(self) -> dict:
        return {"op": "cross_join", "left": self.left.to_json(), "right": self.right.to_json()}


@dataclass(frozen=True)
class Union(Set):
    left: Set
    right: Set

    def to_json(self) -> dict:
        return {"op": "union", "left": self.left.to_json(), "right": self.right.to_json()}


@dataclass(frozen=True)
class Filter(Set):
    set: Set
    pred: Predicate

    def to_json(self) -> dict:
        return {"op": "filter", "set": self.set.to_json(), "pred": self.pred.to_json()}


@dataclass(frozen=True)
class TopN(Set):
    set: Set
    n: int
    by: str

    def __post_init__(self):
        _positive(self.n, "n")

    def to_json(self) -> dict:
        return {"op": "top_n", "set": self.set.to_json(), "n": self.n, "by": self.by}


def _positive(n, what: str) -> None:
    if not isinstance(n, int) or isinstance(n, bool) or n < 1:
        raise MalformedJson(what=what, why=f"{n!r} is not a positive integer")


def set_from_json(data: dict) -> Set:
    op = tagged(data, "op", "set")
    sub = lambda key: set_from_json(data[key])
    try:
        if op == "members":
            return Members(name(data["dim"]), name(data["hierarchy"]), name(data["level"]))
        if op == "range":
            return Range(name(data["dim"]), name(data["hierarchy"]), MemberRef.from_json(data["from"]), MemberRef.from_json(data["to"]))
        if op == "named":
            return Named(name(data["name"]))
        if op == "explicit":
            return Explicit(tuple(MemberRef.from_json(m) for m in data["members"]))
        if op == "children":
            return Children(sub("of"))
        if op == "descendants":
            return Descendants(sub("of"), name(data["to_level"]))
        if op == "cross_join":
            return CrossJoin(sub("left"), sub("right"))
        if op == "union":
            return Union(sub("left"), sub("right"))
        if op == "filter":
            return Filter(sub("set"), predicate_from_json(data["pred"]))
        if op == "top_n":
            return TopN(sub("set"), data["n"], name(data["by"]))
    except KeyError as e:
        raise MalformedJson(what="set", why=f"no {e}") from None
    raise MalformedJson(what="set", why=f"op {op!r}")


# --- predicates


@dataclass(frozen=True)
class Predicate:
    """eq, gt, lt compare a metric with a value; in, not_in a dimension's member with a path prefix."""

    op: str
    metric: str | None = None
    value: float | None = None
    dim: str | None = None
    path_prefix: tuple[str, ...] | None = None

    @classmethod
    def eq(cls, metric: str, value: float) -> Predicate:
        return cls("eq", metric, float(value))

    @classmethod
    def gt(cls, metric: str, value: float) -> Predicate:
        return cls("gt", metric, float(value))

    @classmethod
    def lt(cls, metric: str, value: float) -> Predicate:
        return cls("lt", metric, float(value))

    @classmethod
    def is_in(cls, dim: str, *prefix: str) -> Predicate:
        return cls("in", dim=dim, path_prefix=path(*prefix))

    @classmethod
    def not_in(cls, dim: str, *prefix: str) -> Predicate:
        return cls("not_in", dim=dim, path_prefix=path(*prefix))

    def to_json(self) -> dict:
        if self.op in ("in", "not_in"):
            return {"op": self.op, "dim": self.dim, "path_prefix": list(self.path_prefix)}
        return {"op": self.op, "metric": self.metric, "value": self.value}


def predicate_from_json(data: dict) -> Predicate:
    op = tagged(data, "op", "predicate")
    if op in ("eq", "gt", "lt"):
        return Predicate(op, name(data["metric"]), float(data["value"]))
    if op in ("in", "not_in"):
        return Predicate(op, dim=name(data["dim"]), path_prefix=path(*data["path_prefix"]))
    raise MalformedJson(what="predicate", why=f"op {op!r}")


# --- axes, options, query


@dataclass(frozen=True)
class Axes:
    shape: str
    rows: Set | None = None
    columns: Set | None = None
    pages: Set | None = None

    @classmethod
    def scalar(cls) -> Axes:
        return cls("scalar")

    @classmethod
    def series(cls, rows: Set) -> Axes:
        return cls("series", rows)

    @classmethod
    def pivot(cls, rows: Set, columns: Set) -> Axes:
        return cls("pivot", rows, columns)

    @classmethod
    def paged(cls, rows: Set, columns: Set, pages: Set) -> Axes:
        return cls("pages", rows, columns, pages)

    def transpose(self) -> Axes:
        """Rows and columns change places; scalar and series stay as they are, pages stay pages."""
        if self.columns is None:
            return self
        return Axes(self.shape, self.columns, self.rows, self.pages)

    def to_json(self) -> dict:
        sets = {k: getattr(self, k) for k in ("rows", "columns", "pages")}
        return {"shape": self.shape} | {k: s.to_json() for k, s in sets.items() if s is not None}

    @classmethod
    def from_json(cls, data: dict) -> Axes:
        shape = tagged(data, "shape", "axes")
        need = {"scalar": (), "series": ("rows",), "pivot": ("rows", "columns"), "pages": ("rows", "columns", "pages")}.get(shape)
        if need is None:
            raise MalformedJson(what="axes", why=f"shape {shape!r}")
        try:
            return cls(shape, **{k: set_from_json(data[k]) for k in need})
        except KeyError as e:
            raise MalformedJson(what="axes", why=f"no {e}") from None


@dataclass(frozen=True)
class OrderBy:
    metric: str
    direction: str = "asc"

    def __post_init__(self):
        if self.direction not in ("asc", "desc"):
            raise MalformedJson(what="order", why=f"direction {self.direction!r}")

    def to_json(self) -> dict:
        return {"metric": self.metric, "direction": self.direction}


@dataclass(frozen=True)
class Options:
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None
    non_empty: bool = False

    def __post_init__(self):
        object.__setattr__(self, "order", tuple(self.order))
        if self.limit is not None:
            _positive(self.limit, "limit")

    def to_json(self) -> dict:
        return {"order": [o.to_json() for o in self.order], "limit": self.limit, "non_empty": self.non_empty}

    @classmethod
    def from_json(cls, data: dict) -> Options:
        return cls(tuple(OrderBy(name(o["metric"]), o["direction"]) for o in data["order"]), data.get("limit"), data["non_empty"])


@dataclass(frozen=True)
class Query:
    axes: Axes
    slicer: Tuple = field(default_factory=Tuple)
    metrics: tuple[str, ...] = ()
    options: Options = field(default_factory=Options)

    def __post_init__(self):
        object.__setattr__(self, "metrics", tuple(self.metrics))

    def to_json(self) -> dict:
        return {"axes": self.axes.to_json(), "slicer": self.slicer.to_json(), "metrics": list(self.metrics), "options": self.options.to_json()}

    @classmethod
    def from_json(cls, data: dict) -> Query:
        try:
            return cls(Axes.from_json(data["axes"]), Tuple.from_json(data["slicer"]), tuple(name(m) for m in data["metrics"]), Options.from_json(data["options"]))
        except (KeyError, TypeError) as e:
            raise MalformedJson(what="query", why=str(e)) from None
