"""Constructors, rejections and JSON round trips."""

import json

import pytest

from gridweave import errors as E
from gridweave.names import MonthDay, name, unit
from gridweave.query import Axes, Explicit, MemberRef, Members, Options, OrderBy, Predicate, Query, Range, TopN, Tuple, explicit, set_from_json
from gridweave.results import Cell, Pivot, Rollup, Row, Scalar, Series, results_from_json
from gridweave.schema import Aggregation, At, Const, Dimension, Lag, Measure, Metric, PeriodsToDate, Ref, Schema, expr_from_json

from .fixtures import GEO, PLAN, month, place, plan, schema


@pytest.mark.parametrize("bad", ["", "  ", " a", "a ", "a\tb", "\x00", None, 3])
def test_names_are_checked(bad):
    with pytest.raises(E.InvalidName):
        name(bad)


def test_units_and_days():
    assert unit("EUR / h") == "EUR / h"
    with pytest.raises(E.InvalidUnit):
        unit(" EUR")
    assert MonthDay.from_json({"month": 4, "day": 30}).to_json() == {"month": 4, "day": 30}
    for m, d in ((2, 29), (4, 31), (13, 1), (1, 0)):
        with pytest.raises(E.InvalidMonthDay):
            MonthDay(m, d)


def test_paths_and_tuples():
    with pytest.raises(E.EmptyPath):
        MemberRef.of("Time", "Fiscal")
    with pytest.raises(E.RepeatedDimension):
        Tuple.of(place("North"), place("South"))
    with pytest.raises(E.EmptyExplicit):
        explicit()
    with pytest.raises(E.MalformedJson):
        TopN(Members("A", "B", "C"), 0, "m")
    with pytest.raises(E.MalformedJson):
        Options(limit=0)


def test_builder_order_and_checks():
    with pytest.raises(E.MissingDimension):
        Schema.builder().measure(Measure("m", Aggregation("sum")))
    with pytest.raises(E.MissingMeasure):
        Schema.builder().dimension(GEO).metric(Metric("x", Const(1.0)))
    with pytest.raises(E.MissingMeasure):
        Schema.builder().dimension(GEO).build()
    one = lambda: Schema.builder().dimension(GEO).measure(Measure("m", Aggregation("sum")))
    with pytest.raises(E.DuplicateDimension):
        Schema.builder().dimension(GEO, GEO).measure(Measure("m", Aggregation("sum"))).build()
    with pytest.raises(E.DuplicateMeasure):
        one().measure(Measure("m", Aggregation("avg"))).build()
    with pytest.raises(E.NameCollision):
        one().metric(Metric("m", Const(1.0))).build()
    with pytest.raises(E.UnresolvedMetricRef):
        one().metric(Metric("x", Ref("nothing"))).build()
    with pytest.raises(E.EmptyNonAdditiveDims):
        Aggregation.semi_additive([], "last")
    assert one().metric(Metric("x", Ref("x"))).build()  # a cycle shows when it is evaluated


def test_schema_round_trip():
    own = schema()
    assert Schema.from_json(json.loads(json.dumps(own.to_json()))) == own
    data = own.to_json()
    del data["named_sets"]
    assert Schema.from_json(data).named_sets == ()
    assert Dimension.time("T").to_json()["kind"] == {"kind": "time", "calendars": []}


def test_expression_round_trip():
    e = (Ref("a") - Lag(Ref("a"), "Time", 12)) / Const(2.0) + PeriodsToDate(At(Ref("b"), Tuple.of(plan("Actual"))), "Year")
    assert expr_from_json(json.loads(json.dumps(e.to_json()))) == e
    assert (Ref("a") * 2).to_json() == {"op": "binary", "bin_op": "mul", "l": {"op": "ref", "name": "a"}, "r": {"op": "const", "value": 2.0}}


def test_query_round_trip():
    rows = Members("Geography", "Default", "Country").filter(Predicate.gt("amount", 3)).top(2, "amount")
    columns = Explicit((plan("Actual"),)).cross(Range("Time", "Fiscal", month("2025"), month("2026")))
    for axes in (Axes.scalar(), Axes.series(rows), Axes.pivot(rows, columns), Axes.paged(rows.union(place("North").children()), columns, place("North").descendants_to("Country"))):
        q = Query(axes, Tuple.of(plan("Plan")), ("amount",), Options((OrderBy("amount", "desc"),), 3, True))
        assert Query.from_json(json.loads(json.dumps(q.to_json()))) == q
    with pytest.raises(E.MalformedJson):
        set_from_json({"op": "intersect"})
    with pytest.raises(E.MalformedJson):
        Query.from_json({"axes": {"shape": "cube"}, "slicer": [], "metrics": [], "options": {"order": [], "non_empty": False}})
    assert Axes.pivot(rows, columns).transpose() == Axes.pivot(columns, rows)
    assert Axes.series(rows).transpose() == Axes.series(rows)


def test_results_round_trip():
    cells = [Cell.valid(1.5, "EUR"), Cell.missing(), Cell.error("divide by zero")]
    t = Tuple.of(plan("Actual"))
    for r in (
        Scalar(t, cells),
        Series([plan("Actual")], [Row("a", cells[:1])]),
        Pivot([t], [t, t, t], [cells]),
        Rollup(place("North"), cells[0], [Rollup(place("North", "US"), cells[1])]),
    ):
        assert results_from_json(json.loads(json.dumps(r.to_json()))) == r
    assert PLAN.kind == "scenario"
