"""The declared shape of a cube: dimensions with hierarchies of levels, measures, metrics and named sets."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from .errors import (
    DuplicateDimension,
    DuplicateMeasure,
    DuplicateMetric,
    DuplicateNamedSet,
    EmptyNonAdditiveDims,
    MalformedJson,
    MissingDimension,
    MissingMeasure,
    NameCollision,
    UnresolvedMetricRef,
)
from .names import MonthDay, name, unit
from .query import Set, Tuple, set_from_json, tagged

#: Roll-up rules without parameters.
SIMPLE = ("sum", "avg", "min", "max", "count", "distinct_count")
#: How a semi-additive measure folds its sums per key.
FOLDS = ("first", "last", "avg", "min", "max")


@dataclass(frozen=True)
class Level:
    name: str
    key: str

    def __post_init__(self):
        name(self.name), name(self.key)

    def to_json(self) -> dict:
        return {"name": self.name, "key": self.key}


@dataclass(frozen=True)
class Hierarchy:
    name: str
    levels: tuple[Level, ...] = ()

    def __post_init__(self):
        name(self.name)
        object.__setattr__(self, "levels", tuple(self.levels))

    def level_index(self, level: str) -> int | None:
        return next((i for i, x in enumerate(self.levels) if x.name == level), None)

    def to_json(self) -> dict:
        return {"name": self.name, "levels": [x.to_json() for x in self.levels]}

    @classmethod
    def from_json(cls, data: dict) -> Hierarchy:
        return cls(data["name"], tuple(Level(x["name"], x["key"]) for x in data["levels"]))


@dataclass(frozen=True)
class Calendar:
    """Names a calendar of a time dimension; the start of its fiscal year is carried, not evaluated."""

    name: str
    fiscal_start: MonthDay | None = None

    def to_json(self) -> dict:
        return {"name": self.name, "fiscal_start": self.fiscal_start and self.fiscal_start.to_json()}

    @classmethod
    def from_json(cls, data: dict) -> Calendar:
        start = data.get("fiscal_start")
        return cls(name(data["name"]), start and MonthDay.from_json(start))


@dataclass(frozen=True)
class Dimension:
    name: str
    hierarchies: tuple[Hierarchy, ...] = ()
    kind: str = "regular"
    calendars: tuple[Calendar, ...] = ()

    def __post_init__(self):
        name(self.name)
        if self.kind not in ("regular", "time", "scenario"):
            raise MalformedJson(what="dimension", why=f"kind {self.kind!r}")
        object.__setattr__(self, "hierarchies", tuple(self.hierarchies))
        object.__setattr__(self, "calendars", tuple(self.calendars))

    @classmethod
    def regular(cls, name: str, *hierarchies: Hierarchy) -> Dimension:
        return cls(name, hierarchies)

    @classmethod
    def time(cls, name: str, *hierarchies: Hierarchy, calendars: tuple[Calendar, ...] = ()) -> Dimension:
        return cls(name, hierarchies, "time", calendars)

    @classmethod
    def scenario(cls, name: str, *hierarchies: Hierarchy) -> Dimension:
        return cls(name, hierarchies, "scenario")

    def hierarchy(self, hierarchy: str) -> Hierarchy | None:
        return next((h for h in self.hierarchies if h.name == hierarchy), None)

    def to_json(self) -> dict:
        kind: dict[str, Any] = {"kind": self.kind}
        if self.kind == "time":
            kind["calendars"] = [c.to_json() for c in self.calendars]
        return {"name": self.name, "hierarchies": [h.to_json() for h in self.hierarchies], "kind": kind}

    @classmethod
    def from_json(cls, data: dict) -> Dimension:
        kind = data["kind"]
        calendars = tuple(Calendar.from_json(c) for c in kind.get("calendars", ()))
        return cls(data["name"], tuple(Hierarchy.from_json(h) for h in data["hierarchies"]), kind["kind"], calendars)


@dataclass(frozen=True)
class Aggregation:
    """A roll-up rule; `over` and `non_additive_dims` belong to semi_additive alone."""

    kind: str
    non_additive_dims: tuple[str, ...] = ()
    over: str | None = None

    def __post_init__(self):
        ok = self.kind in SIMPLE and self.over is None or self.kind == "semi_additive" and self.over in FOLDS
        if not ok:
            raise MalformedJson(what="aggregation", why=f"{self.kind!r} over {self.over!r}")
        object.__setattr__(self, "non_additive_dims", tuple(self.non_additive_dims))

    @classmethod
    def semi_additive(cls, dims, over: str) -> Aggregation:
        if not tuple(dims):
            raise EmptyNonAdditiveDims()
        return cls("semi_additive", tuple(dims), over)

    def to_json(self) -> dict:
        if self.kind == "semi_additive":
            return {"kind": self.kind, "non_additive_dims": list(self.non_additive_dims), "over": self.over}
        return {"kind": self.kind}

    @classmethod
    def from_json(cls, data: dict) -> Aggregation:
        return cls(data["kind"], tuple(data.get("non_additive_dims", ())), data.get("over"))


@dataclass(frozen=True)
class Measure:
    """A fact column of the measure's name and its roll-up rule."""

    name: str
    aggregation: Aggregation
    unit: str | None = None

    def __post_init__(self):
        name(self.name)
        if isinstance(self.aggregation, str):
            object.__setattr__(self, "aggregation", Aggregation(self.aggregation))
        if self.unit is not None:
            unit(self.unit)

    def to_json(self) -> dict:
        return {"name": self.name, "aggregation": self.aggregation.to_json(), "unit": self.unit}

    @classmethod
    def from_json(cls, data: dict) -> Measure:
        return cls(data["name"], Aggregation.from_json(data["aggregation"]), data.get("unit"))


# --- metric expressions


class Expr:
    """A metric's formula. Python's operators build binary nodes; numbers become constants."""

    def __add__(self, other):
        return Binary("add", self, as_expr(other))

    def __sub__(self, other):
        return Binary("sub", self, as_expr(other))

    def __mul__(self, other):
        return Binary("mul", self, as_expr(other))

    def __truediv__(self, other):
        return Binary("div", self, as_expr(other))


def as_expr(value) -> Expr:
    return value if isinstance(value, Expr) else Const(float(value))


@dataclass(frozen=True)
class Ref(Expr):
    name: str

    def to_json(self) -> dict:
        return {"op": "ref", "name": self.name}


@dataclass(frozen=True)
class Const(Expr):
    value: float

    def to_json(self) -> dict:
        return {"op": "const", "value": self.value}


@dataclass(frozen=True)
class Binary(Expr):
    bin_op: str
    l: Expr  # noqa: E741
    r: Expr

    def __post_init__(self):
        if self.bin_op not in ("add", "sub", "mul", "div"):
            raise MalformedJson(what="expression", why=f"bin_op {self.bin_op!r}")

    def to_json(self) -> dict:
        return {"op": "binary", "bin_op": self.bin_op, "l": self.l.to_json(), "r": self.r.to_json()}


@dataclass(frozen=True)
class Lag(Expr):
    """`of`, n members earlier in its level on dimension `dim` (n < 0: later)."""

    of: Expr
    dim: str
    n: int

    def to_json(self) -> dict:
        return {"op": "lag", "of": self.of.to_json(), "dim": self.dim, "n": self.n}


@dataclass(frozen=True)
class PeriodsToDate(Expr):
    """The sum of `of` from the start of the period of `level` to the current time member."""

    of: Expr
    level: str

    def to_json(self) -> dict:
        return {"op": "periods_to_date", "of": self.of.to_json(), "level": self.level}


@dataclass(frozen=True)
class At(Expr):
    """`of` where the members of `at` replace those of their dimensions."""

    of: Expr
    at: Tuple

    def to_json(self) -> dict:
        return {"op": "at", "of": self.of.to_json(), "at": self.at.to_json()}


def expr_from_json(data: dict) -> Expr:
    op = tagged(data, "op", "expression")
    sub = lambda key: expr_from_json(data[key])
    if op == "ref":
        return Ref(name(data["name"]))
    if op == "const":
        return Const(float(data["value"]))
    if op == "binary":
        return Binary(data["bin_op"], sub("l"), sub("r"))
    if op == "lag":
        return Lag(sub("of"), name(data["dim"]), int(data["n"]))
    if op == "periods_to_date":
        return PeriodsToDate(sub("of"), name(data["level"]))
    if op == "at":
        return At(sub("of"), Tuple.from_json(data["at"]))
    raise MalformedJson(what="expression", why=f"op {op!r}")


def refs(expr: Expr):
    if isinstance(expr, Ref):
        yield expr.name
    elif isinstance(expr, Binary):
        yield from refs(expr.l)
        yield from refs(expr.r)
    elif not isinstance(expr, Const):
        yield from refs(expr.of)


@dataclass(frozen=True)
class Metric:
    name: str
    expr: Expr
    unit: str | None = None
    format: str | None = None

    def __post_init__(self):
        name(self.name)
        if self.unit is not None:
            unit(self.unit)

    def to_json(self) -> dict:
        return {"name": self.name, "expr": self.expr.to_json(), "unit": self.unit, "format": self.format}

    @classmethod
    def from_json(cls, data: dict) -> Metric:
        return cls(data["name"], expr_from_json(data["expr"]), data.get("unit"), data.get("format"))


@dataclass(frozen=True)
class NamedSet:
    name: str
    set: Set

    def __post_init__(self):
        name(self.name)

    def to_json(self) -> dict:
        return {"name": self.name, "set": self.set.to_json()}


@dataclass(frozen=True)
class Schema:
    dimensions: tuple[Dimension, ...]
    measures: tuple[Measure, ...]
    metrics: tuple[Metric, ...] = ()
    named_sets: tuple[NamedSet, ...] = ()

    def __post_init__(self):
        for attr in ("dimensions", "measures", "metrics", "named_sets"):
            object.__setattr__(self, attr, tuple(getattr(self, attr)))

    @classmethod
    def builder(cls) -> Builder:
        return Builder()

    def dimension(self, dim: str) -> Dimension | None:
        return next((d for d in self.dimensions if d.name == dim), None)

    def measure(self, measure: str) -> Measure | None:
        return next((m for m in self.measures if m.name == measure), None)

    def metric(self, metric: str) -> Metric | None:
        return next((m for m in self.metrics if m.name == metric), None)

    def to_json(self) -> dict:
        return {key: [x.to_json() for x in getattr(self, key)] for key in ("dimensions", "measures", "metrics", "named_sets")}

    @classmethod
    def from_json(cls, data: dict) -> Schema:
        """The schema as written: build()'s checks are the builder's own."""
        return cls(
            tuple(Dimension.from_json(x) for x in data["dimensions"]),
            tuple(Measure.from_json(x) for x in data["measures"]),
            tuple(Metric.from_json(x) for x in data["metrics"]),
            tuple(NamedSet(x["name"], set_from_json(x["set"])) for x in data.get("named_sets", ())),
        )


@dataclass
class Builder:
    """Collects the parts of a schema in order - dimensions, measures, the rest - and checks them together."""

    dimensions: list[Dimension] = field(default_factory=list)
    measures: list[Measure] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)
    named_sets: list[NamedSet] = field(default_factory=list)

    def dimension(self, *dims: Dimension) -> Builder:
        self.dimensions += dims
        return self

    def measure(self, *measures: Measure) -> Builder:
        if not self.dimensions:
            raise MissingDimension()
        self.measures += measures
        return self

    def metric(self, *metrics: Metric) -> Builder:
        self._need_measure()
        self.metrics += metrics
        return self

    def named_set(self, *sets: NamedSet) -> Builder:
        self._need_measure()
        self.named_sets += sets
        return self

    def _need_measure(self) -> None:
        if not self.dimensions:
            raise MissingDimension()
        if not self.measures:
            raise MissingMeasure()

    def build(self) -> Schema:
        self._need_measure()
        for error, items in (
            (DuplicateDimension, self.dimensions),
            (DuplicateMeasure, self.measures),
            (DuplicateMetric, self.metrics),
            (DuplicateNamedSet, self.named_sets),
        ):
            seen: set[str] = set()
            for item in items:
                if item.name in seen:
                    raise error(name=item.name)
                seen.add(item.name)
        measures, metrics = {m.name for m in self.measures}, {m.name for m in self.metrics}
        for metric in self.metrics:
            if metric.name in measures:
                raise NameCollision(name=metric.name, one="measure", two="metric")
        for item in self.named_sets:
            if item.name in measures | metrics:
                raise NameCollision(name=item.name, one="named set", two="measure" if item.name in measures else "metric")
        for metric in self.metrics:
            for ref in refs(metric.expr):
                if ref not in measures | metrics:
                    raise UnresolvedMetricRef(metric=metric.name, name=ref)
        return Schema(tuple(self.dimensions), tuple(self.measures), tuple(self.metrics), tuple(self.named_sets))
