"""SparkCube: a schema over a fact DataFrame, and the queries it answers."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .catalogue import MOST_MEMBERS, Catalogue, Relation
from .errors import EvalSetCompositionIllFormed, LevelDtypeMismatch, MeasureDtypeMismatch, MissingLevelColumn, MissingMeasureColumn, ResolveUnknownLevel, UnknownHierarchy
from .operators.metrics import MOST_CELLS, Evaluator, intersect
from .operators.sets import tuples_of
from .plans.resolve import Resolver
from .query import Descendants, MemberRef, Query, Tuple
from .results import Cell, Pivot, Rollup, Row, Scalar, Series
from .schema import Schema

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMBERS = (*_INTEGERS, T.FloatType, T.DoubleType)


@runtime_checkable
class Cube(Protocol):
    """What a cube offers, wherever it is computed."""

    def schema(self) -> Schema: ...

    def query(self, query: Query) -> Scalar | Series | Pivot | Rollup: ...

    def members(self, dim: str, hierarchy: str, at: MemberRef, relation: Relation) -> list[MemberRef]: ...


def validate(facts: DataFrame, schema: Schema) -> None:
    """Every measure and level has its column, of a suitable type; measures first, the first fault is raised."""
    types = {f.name: f.dataType for f in facts.schema.fields}
    for m in schema.measures:
        if m.name not in types:
            raise MissingMeasureColumn(measure=m.name, column=m.name)
        kind, dtype = m.aggregation.kind, types[m.name]
        allowed = {"count": T.DataType, "distinct_count": (*_NUMBERS, T.StringType)}.get(kind, _NUMBERS)
        if not isinstance(dtype, allowed):
            raise MeasureDtypeMismatch(measure=m.name, column=m.name, dtype=dtype.simpleString(), aggregation=kind)
    for d in schema.dimensions:
        for h in d.hierarchies:
            for level in h.levels:
                if level.key not in types:
                    raise MissingLevelColumn(dim=d.name, hierarchy=h.name, level=level.name, column=level.key)
                if not isinstance(types[level.key], (*_INTEGERS, T.StringType)):
                    raise LevelDtypeMismatch(dim=d.name, level=level.name, column=level.key, dtype=types[level.key].simpleString())


class SparkCube:
    """A cube over any DataFrame. The facts stay where they are; queries send aggregates of them to the driver.

    Members and results live on the driver, so their numbers are bounded: more of them raise an error.
    """

    def __init__(self, facts: DataFrame, schema: Schema, most_members: int = MOST_MEMBERS, most_cells: int = MOST_CELLS):
        validate(facts, schema)
        self.facts, self._schema = facts, schema
        self.catalogue = Catalogue(facts, schema, most_members)
        self.evaluator = Evaluator(facts, schema, self.catalogue, most_cells)

    def schema(self) -> Schema:
        return self._schema

    # --- members

    def members(self, dim: str, hierarchy: str, at: MemberRef, relation: Relation) -> list[MemberRef]:
        return self.catalogue.navigate(dim, hierarchy, at, relation)

    def level_members(self, dim: str, hierarchy: str, level: str) -> list[MemberRef]:
        own = self._schema.dimension(dim)
        own = own and own.hierarchy(hierarchy)
        if own is None:
            raise UnknownHierarchy(dim=dim, hierarchy=hierarchy)
        index = own.level_index(level)
        if index is None:
            raise ResolveUnknownLevel(dim=dim, hierarchy=hierarchy, level=level)
        return [MemberRef(dim, hierarchy, p) for p in self.catalogue.tree(dim, hierarchy).levels[index]]

    # --- queries

    def query(self, query: Query) -> Scalar | Series | Pivot | Rollup:
        axes = Resolver(self._schema, self.catalogue).query(query)
        listed = lambda axis: tuples_of(axes[axis], self.evaluator)
        shape = query.axes.shape
        if shape == "scalar":
            return Scalar(query.slicer, self.evaluator.cells([(m, query.slicer) for m in query.metrics]))
        if shape == "series":
            return self._series(query, listed("rows"))
        rows = listed("rows")
        if shape == "pivot":
            root = single_root(rows) if isinstance(axes["rows"], Descendants) else None
            if root is not None:
                return self._rollup(query, rows, root)
            return self._pivot(query, rows, listed("columns"))
        columns, pages = listed("columns"), listed("pages")
        self.evaluator.allow(len(columns) * len(pages))
        wide = [both for p in pages for c in columns if (both := intersect(c, p)) is not None]
        return self._pivot(query, rows, wide)

    def _series(self, query: Query, rows: list[Tuple]) -> Series:
        self.evaluator.allow(len(rows) * len(query.metrics))
        x = [_first(t) for t in rows]
        at = [intersect(query.slicer, t) for t in rows]
        cells = self.evaluator.cells([(m, t) for m in query.metrics for t in at])
        n = len(rows)
        by_metric = [cells[k * n : (k + 1) * n] for k in range(len(query.metrics))]
        keep = _arranged(query, n, lambda i: [c[i] for c in by_metric], lambda k, i: by_metric[k][i])
        return Series([x[i] for i in keep], [Row(m, [c[i] for i in keep]) for m, c in zip(query.metrics, by_metric, strict=True)])

    def _pivot(self, query: Query, rows: list[Tuple], columns: list[Tuple]) -> Pivot:
        self.evaluator.allow(len(rows) * len(columns) * max(1, len(query.metrics)))
        asked = []
        for r in rows:
            base = intersect(query.slicer, r)
            for c in columns:
                at = None if base is None else intersect(base, c)
                asked += [(m, at) for m in query.metrics]
        cells = self.evaluator.cells(asked)
        width = len(columns) * len(query.metrics)
        grid = [cells[i * width : (i + 1) * width] for i in range(len(rows))]
        headers = [c for c in columns for _ in range(max(1, len(query.metrics)))]
        keep = _arranged(query, len(rows), lambda i: grid[i], lambda k, i: grid[i][k] if grid[i] else Cell.missing())
        return Pivot([rows[i] for i in keep], headers, [grid[i] for i in keep])

    def _rollup(self, query: Query, rows: list[Tuple], root: MemberRef) -> Rollup:
        if not query.metrics:
            raise EvalSetCompositionIllFormed(reason="a roll-up needs a metric")
        nodes = [root, *(t.members[0] for t in rows)]
        cells = self.evaluator.cells([(query.metrics[0], intersect(query.slicer, Tuple((m,)))) for m in nodes])
        tree = {root.path: Rollup(root, cells[0])}
        for m, cell in zip(nodes[1:], cells[1:], strict=True):
            for depth in range(len(root.path) + 1, len(m.path) + 1):
                path = m.path[:depth]
                if path not in tree:
                    tree[path] = Rollup(MemberRef(m.dim, m.hierarchy, path), Cell.missing())
                    tree[path[:-1]].children.append(tree[path])
            tree[m.path].value = cell
        return tree[root.path]

    # --- results as rows

    def query_df(self, query: Query) -> DataFrame:
        """query()'s result as a table: one row per cell, with explicit positions; paths joined by "/", tuples by " × "."""
        return self._local(list(tidy(self.query(query), query)), TIDY)

    def _local(self, rows: list[tuple], columns: str) -> DataFrame:
        """Rows of the driver as a local relation, with no job to read them."""
        fields = [x.split() for x in columns.split(", ")]
        data = list(zip(*rows, strict=True)) or [()] * len(fields)
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return self.facts.sparkSession.createDataFrame(pa.table([pa.array(c, types[t]) for c, (_, t) in zip(data, fields, strict=True)], names=[n for n, _ in fields]))

    def members_df(self, members: list[MemberRef]) -> DataFrame:
        rows = [(i, m.dim, m.hierarchy, "/".join(m.path)) for i, m in enumerate(members)]
        return self._local(rows, "ord long, dim string, hierarchy string, member string")


TIDY = "row_ord long, col_ord long, row string, col string, metric string, state string, value double, reason string"


def tidy(result, query: Query):
    def line(i, j, row, col, metric, c: Cell):
        return (i, j, row, col, metric, c.state, c.value, c.reason)

    n = max(1, len(query.metrics))
    if isinstance(result, Scalar):
        for k, (m, c) in enumerate(zip(query.metrics, result.values, strict=True)):
            yield line(0, k, str(result.tuple), "", m, c)
    elif isinstance(result, Series):
        for k, r in enumerate(result.rows):
            for i, (m, c) in enumerate(zip(result.x, r.values, strict=True)):
                yield line(i, k, "/".join(m.path), "", r.label, c)
    elif isinstance(result, Pivot):
        for i, (row, cells) in enumerate(zip(result.row_headers, result.cells, strict=True)):
            for j, c in enumerate(cells):
                yield line(i, j, str(row), str(result.col_headers[j]), query.metrics[j % n], c)
    else:
        stack, i = [result], 0
        while stack:
            node = stack.pop()
            yield line(i, len(node.root.path), "/".join(node.root.path), "", query.metrics[0], node.value)
            i += 1
            stack += reversed(node.children)


def _first(t: Tuple) -> MemberRef:
    if not t.members:
        raise EvalSetCompositionIllFormed(reason="a row without members")
    return t.members[0]


def single_root(rows: list[Tuple]) -> MemberRef | None:
    """The top-level member under which all rows lie, if they are single members of one hierarchy."""
    heads = {(m.dim, m.hierarchy, m.path[0]) for t in rows if len(t.members) == 1 for m in t.members}
    if len(heads) != 1 or any(len(t.members) != 1 for t in rows):
        return None
    dim, hierarchy, head = heads.pop()
    return MemberRef(dim, hierarchy, (head,))


def _arranged(query: Query, n: int, row, cell) -> list[int]:
    """Positions of the rows that the options keep: non-empty ones, ordered by the first order-by, then cut."""
    keep = list(range(n))
    options = query.options
    if options.non_empty:
        keep = [i for i in keep if any(c.state != "missing" for c in row(i))]
    if options.order and options.order[0].metric in query.metrics:
        k, sign = query.metrics.index(options.order[0].metric), -1 if options.order[0].direction == "desc" else 1
        keep.sort(key=lambda i: sign * cell(k, i).score())
    return keep if options.limit is None else keep[: options.limit]


