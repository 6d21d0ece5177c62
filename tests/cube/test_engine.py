"""Construction, navigation, sets, measures, formulas, shapes and options on hand-made facts."""

import math

import pytest

from gridweave import errors as E
from gridweave.catalogue import Relation
from gridweave.engine import Cube, SparkCube
from gridweave.query import Axes, Explicit, MemberRef, Members, Named, Options, OrderBy, Predicate, Query, Range, Tuple
from gridweave.results import Cell, Pivot, Rollup, Series
from gridweave.schema import Aggregation, Dimension, Measure, Metric, Ref, Schema

from .fixtures import COLUMNS, GEO, ROWS, TIME, facts, hierarchy, month, place, plan, schema

COUNTRIES, REGIONS, MONTHS, YEARS = (Members(d, h, x) for d, h, x in (("Geography", "Default", "Country"), ("Geography", "Default", "Region"), ("Time", "Fiscal", "Month"), ("Time", "Fiscal", "Year")))
ACTUAL = Tuple.of(plan("Actual"))


@pytest.fixture(scope="module")
def cube(spark):
    return SparkCube(facts(spark), schema())


def ask(cube, axes, *metrics, slicer=Tuple(), **options):
    return cube.query(Query(axes, slicer, metrics, Options(**options)))


def scalar(cube, metric, *members):
    return ask(cube, Axes.scalar(), metric, slicer=Tuple.of(*members)).values[0]


def paths(result):
    return ["/".join(m.path) for m in result.x]


def series(cube, rows, metric="amount", **kw):
    return ask(cube, Axes.series(rows), metric, **kw)


# --- construction


def test_protocol(cube):
    assert isinstance(cube, Cube)


def test_the_driver_holds_what_is_allowed(spark):
    SparkCube(facts(spark), schema(), most_members=16)  # 5 and 3 places, 6 times, 2 plans
    with pytest.raises(E.TooManyMembers):
        SparkCube(facts(spark), schema(), most_members=15)
    small = SparkCube(facts(spark), schema(), most_cells=8)
    assert len(ask(small, Axes.pivot(REGIONS, MONTHS), "amount").cells) == 2
    assert len(series(small, YEARS.cross(REGIONS)).x) == 4
    for axes, metrics in [
        (Axes.pivot(REGIONS, MONTHS), ("amount", "units")),
        (Axes.series(COUNTRIES.cross(MONTHS)), ("amount",)),
        (Axes.series(MONTHS), ("amount", "units", "Price")),
        (Axes.paged(YEARS, COUNTRIES, MONTHS), ("amount",)),
    ]:
        with pytest.raises(E.EvalTooManyCells):
            ask(small, axes, *metrics)


@pytest.mark.parametrize(
    ("columns", "error"),
    [
        (COLUMNS.replace("amount", "other"), E.MissingMeasureColumn),
        (COLUMNS.replace("country", "other"), E.MissingLevelColumn),
        (COLUMNS.replace("amount double", "amount decimal(10,2)"), E.MeasureDtypeMismatch),
        (COLUMNS.replace("country string", "country double"), E.LevelDtypeMismatch),
    ],
)
def test_columns_are_checked(spark, columns, error):
    with pytest.raises(error):
        SparkCube(spark.createDataFrame([], columns), schema())


def test_malformed_member(spark):
    with pytest.raises(E.MalformedMemberValue):
        SparkCube(spark.createDataFrame([("", *ROWS[0][1:])], COLUMNS), schema())


def test_empty_facts(spark):
    own = SparkCube(spark.createDataFrame([], COLUMNS), schema())
    assert own.level_members("Geography", "Default", "Region") == []
    assert scalar(own, "amount") == Cell.missing()
    assert paths(series(own, COUNTRIES)) == []


# --- navigation


def test_navigation(cube):
    nav = lambda at, kind, depth=0: ["/".join(m.path) for m in cube.members("Geography", "Default", at, Relation(kind, depth))]
    assert nav(place("North"), "children") == ["North/CA", "North/US"]
    assert nav(place("North"), "descendants", 1) == ["North/CA", "North/US"]
    assert nav(place("North"), "descendants", 0) == []
    assert nav(place("North"), "siblings") == ["South"]
    assert nav(place("North", "US"), "siblings") == ["North/CA"]
    assert nav(place("North", "US"), "parent") == ["North"]
    assert nav(place("North"), "parent") == []
    assert nav(place("South"), "leaves") == ["South/BR"]
    assert nav(place("South", "BR"), "leaves") == []
    with pytest.raises(E.UnknownHierarchy):
        cube.members("Geography", "None", place("North"), Relation("children"))
    with pytest.raises(E.MemberRefHierarchyMismatch):
        cube.members("Time", "Fiscal", place("North"), Relation("children"))
    with pytest.raises(E.UnknownMember):
        cube.members("Geography", "Default", place("East"), Relation("children"))
    assert [m.path for m in cube.level_members("Time", "Fiscal", "Year")] == [("2025",), ("2026",)]


def test_integer_keys_sort_as_text(spark):
    df = spark.createDataFrame([(2, 1.0), (10, 2.0), (None, 4.0)], "k int, v double")
    own = SparkCube(df, Schema.builder().dimension(Dimension.regular("D", hierarchy("H", ("L", "k")))).measure(Measure("v", Aggregation("sum"))).build())
    r = series(own, Members("D", "H", "L"), "v")
    assert paths(r) == ["10", "2"] and [c.value for c in r.rows[0].values] == [2.0, 1.0]
    assert scalar(own, "v").value == 7.0  # rows without a key still count above


# --- resolve errors


@pytest.mark.parametrize(
    ("axes", "metrics", "slicer", "error"),
    [
        (Axes.scalar(), ["nothing"], Tuple(), E.ResolveUnresolvedRef),
        (Axes.series(Members("X", "Y", "Z")), [], Tuple(), E.ResolveUnknownDimension),
        (Axes.series(Members("Time", "Y", "Z")), [], Tuple(), E.ResolveUnknownHierarchy),
        (Axes.series(Members("Time", "Fiscal", "Z")), [], Tuple(), E.ResolveUnknownLevel),
        (Axes.scalar(), [], Tuple.of(place("East")), E.ResolveUnknownMember),
        (Axes.scalar(), ["LagPlace"], Tuple(), E.ResolveLagDimNotTime),
        (Axes.series(Named("None")), [], Tuple(), E.ResolveUnknownNamedSet),
        (Axes.series(Named("Cycle")), [], Tuple(), E.ResolveNamedSetCycle),
        (Axes.series(REGIONS.cross(COUNTRIES)), [], Tuple(), E.ResolveCrossJoinDimsOverlap),
        (Axes.series(REGIONS.union(MONTHS)), [], Tuple(), E.ResolveUnionDimsMismatch),
        (Axes.series(COUNTRIES.descendants_to("Region")), [], Tuple(), E.ResolveDescendantsLevelNotBelow),
        (Axes.series(Range("Geography", "Default", place("North"), place("North", "US"))), [], Tuple(), E.ResolveRangeMembersAtDifferentLevels),
        (Axes.series(Range("Time", "Fiscal", place("North"), place("South"))), [], Tuple(), E.ResolveSetCompositionIllFormed),
        (Axes.series(REGIONS.cross(MONTHS).children()), [], Tuple(), E.ResolveSetCompositionIllFormed),
        (Axes.series(REGIONS.union(COUNTRIES).children()), [], Tuple(), E.ResolveSetCompositionIllFormed),
        (Axes.series(Explicit(()).children()), [], Tuple(), E.ResolveSetCompositionIllFormed),
        (Axes.series(Range("Time", "Fiscal", month("2026"), month("2025"))), [], Tuple(), E.EvalRangeInverted),
        (Axes.scalar(), ["Loop"], Tuple(), E.EvalMetricCycle),
    ],
)
def test_faults(cube, axes, metrics, slicer, error):
    with pytest.raises(error):
        cube.query(Query(axes, slicer, tuple(metrics)))


def test_period_level_outside_time(spark):
    from gridweave.schema import PeriodsToDate

    own = schema()
    bad = Schema(own.dimensions, own.measures, (*own.metrics, Metric("Bad", PeriodsToDate(Ref("amount"), "Region"))))
    with pytest.raises(E.ResolvePeriodsToDateLevelNotInTime):
        scalar(SparkCube(facts(spark), bad), "Bad")


# --- sets


def test_sets(cube):
    names = lambda s, **kw: paths(series(cube, s, **kw))
    assert names(COUNTRIES) == ["North/CA", "North/US", "South/BR"]
    assert names(Explicit((place("South"), place("North"))).children()) == ["South/BR", "North/CA", "North/US"]
    assert names(REGIONS.descendants_to("Country")) == ["North/CA", "North/US", "South/BR"]
    assert names(month("2025").descendants_to("Month")) == ["2025/2025-01", "2025/2025-02"]
    assert names(Range("Time", "Fiscal", month("2025", "2025-02"), month("2026", "2026-01"))) == ["2025/2025-02", "2026/2026-01"]
    assert names(Named("Regions")) == ["North", "South"]
    assert names(Explicit((place("South"), place("North"), place("South")))) == ["South", "North", "South"]
    assert names(Explicit((place("South"),)).union(REGIONS)) == ["South", "North"]
    assert names(REGIONS.union(COUNTRIES)) == ["North", "South", "North/CA", "North/US", "South/BR"]
    assert names(REGIONS.cross(YEARS)) == ["North", "North", "South", "South"]
    assert names(Explicit(())) == []
    assert names(COUNTRIES.filter(Predicate.gt("amount", 10))) == ["North/US", "South/BR"]  # 70, 16
    assert names(COUNTRIES.filter(Predicate.lt("amount", 10))) == ["North/CA"]
    assert names(COUNTRIES.filter(Predicate.eq("amount", 5))) == ["North/CA"]
    assert names(COUNTRIES.filter(Predicate.is_in("Geography", "North"))) == ["North/CA", "North/US"]
    assert names(COUNTRIES.filter(Predicate.not_in("Geography", "North"))) == ["South/BR"]
    assert names(COUNTRIES.filter(Predicate.is_in("Time", "2025"))) == []
    assert names(COUNTRIES.filter(Predicate.not_in("Time", "2025"))) == ["North/CA", "North/US", "South/BR"]
    assert names(COUNTRIES.filter(Predicate.gt("Price", 0))) == ["North/US", "South/BR"]  # CA: divided by zero
    assert names(COUNTRIES.top(2, "amount")) == ["North/US", "South/BR"]
    assert names(COUNTRIES.top(2, "Answer")) == ["North/CA", "North/US"]  # ties keep their order
    # sets are scored without the slicer
    assert names(COUNTRIES.top(1, "amount"), slicer=Tuple.of(month("2025"))) == ["North/US"]


def test_union_of_crosses_by_member_order(cube):
    one = Explicit((place("North"),)).cross(Explicit((plan("Actual"),)))
    two = Explicit((plan("Actual"),)).cross(Explicit((place("North"),)))
    assert len(series(cube, one.union(two)).x) == 2


# --- measures


def measured(spark, rows, columns, *measures, dims=(GEO, TIME)):
    keep = {n.split()[0] for n in columns.split(", ")}
    own = [Dimension(d.name, tuple(h for h in d.hierarchies if all(x.key in keep for x in h.levels)), d.kind) for d in dims]
    own = [d for d in own if d.hierarchies]
    return SparkCube(spark.createDataFrame(rows, columns), Schema.builder().dimension(*own).measure(*measures).build())


def test_plain_rules(spark):
    rows = [("a", 1.0, 1.0, 1.0, "x"), ("a", 3.0, 3.0, 3.0, "y"), ("a", None, None, None, "y"), ("b", None, None, None, None)]
    own = measured(
        spark, rows, "region string, s double, mean double, low double, id string",
        Measure("s", Aggregation("sum")), Measure("mean", Aggregation("avg")), Measure("low", Aggregation("min")), Measure("id", Aggregation("distinct_count")),
        dims=(Dimension.regular("Geography", hierarchy("Default", ("Region", "region"))),),
    )
    got = {m: [c.value if c.state == "valid" else c.state for c in series(own, REGIONS, m).rows[0].values] for m in ("s", "mean", "low", "id")}
    assert got == {"s": [4.0, 0.0], "mean": [2.0, "missing"], "low": [1.0, "missing"], "id": [2.0, 0.0]}


def test_count_counts_rows_and_misses_none(spark):
    dims = (Dimension.regular("Geography", hierarchy("Default", ("Region", "region"))), Dimension.regular("Kind", hierarchy("Default", ("Kind", "kind"))))
    own = measured(spark, [("a", "k", None), ("b", "l", "x")], "region string, kind string, n string", Measure("n", Aggregation("count")), dims=dims)
    r = ask(own, Axes.pivot(REGIONS, Members("Kind", "Default", "Kind")), "n")
    assert [[c.value for c in row] for row in r.cells] == [[1.0, None], [None, 1.0]]
    assert r.cells[0][1] == Cell.missing()


def test_not_a_number(spark):
    dims = (Dimension.regular("Geography", hierarchy("Default", ("Region", "region"))),)
    nan, inf = math.nan, math.inf
    own = measured(
        spark, [("a", nan, nan), ("a", 1.0, 1.0), ("b", nan, nan), ("c", inf, inf)], "region string, s double, top double", Measure("s", Aggregation("sum")), Measure("top", Aggregation("max")), dims=dims
    )
    assert [c.state for c in series(own, REGIONS, "s").rows[0].values] == ["error", "error", "valid"]
    assert [(c.state, c.value) for c in series(own, REGIONS, "top").rows[0].values] == [("valid", 1.0), ("error", None), ("valid", inf)]


def stock(spark, over, dims=("Time",), rows=None):
    rows = rows or [("2026", "2026-01", "x", 100.0), ("2026", "2026-02", "x", 120.0), ("2026", "2026-03", "y", 80.0)]
    own = [TIME, Dimension.regular("Site", hierarchy("Default", ("Site", "site")))]
    schema = Schema.builder().dimension(*own).measure(Measure("stock", Aggregation.semi_additive(dims, over))).build()
    return SparkCube(spark.createDataFrame(rows, "year string, month string, site string, stock double"), schema)


@pytest.mark.parametrize(("over", "value"), [("first", 100.0), ("last", 80.0), ("avg", 100.0), ("min", 80.0), ("max", 120.0)])
def test_semi_additive(spark, over, value):
    own = stock(spark, over)
    assert scalar(own, "stock").value == value
    assert scalar(own, "stock", month("2026", "2026-02")).value == 120.0
    assert scalar(own, "stock", month("2026")).value == 300.0  # pinned at any level: a plain sum


def test_semi_additive_composite_and_nulls(spark):
    rows = [("2026", "2026-01", "x", 1.0), ("2026", "2026-02", "x", 2.0), ("2026", "2026-02", "y", 25.0), ("2026", None, "z", 9.0), ("2026", "2026-03", None, None)]
    assert scalar(stock(spark, "last", ("Time", "Site"), rows), "stock").value == 0.0  # a null is 0, a missing key is ""
    assert scalar(stock(spark, "first", ("Time", "Site"), rows), "stock").value == 9.0
    with pytest.raises(E.EvalAggregateFailed):
        scalar(stock(spark, "last", ("Nowhere",)), "stock")


# --- formulas


def test_formulas(cube):
    assert scalar(cube, "amount") == Cell.valid(92.0, "EUR")
    assert scalar(cube, "Revenue") == Cell.valid(92.0, "EUR", "0.00")
    assert scalar(cube, "Price", place("North", "CA")) == Cell.error("divide by zero")
    assert scalar(cube, "Price") == Cell.valid(9.2)  # arithmetic drops the unit
    assert scalar(cube, "Answer", place("North")) == Cell.valid(42.0)
    assert scalar(cube, "Infinite") == Cell.error("non-finite constant")
    assert scalar(cube, "Previous", month("2026", "2026-01"), plan("Actual")).value == 25.0  # across the year
    assert scalar(cube, "Previous", month("2025", "2025-01")) == Cell.missing()
    assert scalar(cube, "Previous") == Cell.missing("not_applicable")
    assert scalar(cube, "LagConst", month("2025", "2025-01")) == Cell.missing()
    assert scalar(cube, "Same").value == 92.0
    assert scalar(cube, "YTD", month("2026", "2026-02"), plan("Actual")).value == 48.0
    assert scalar(cube, "YTD", month("2026", "2026-01"), place("North", "CA")) == Cell.valid(0.0)  # nothing there: 0
    assert scalar(cube, "YTD") == Cell.missing("not_applicable")
    assert scalar(cube, "YTDofYTD", month("2025", "2025-02")).value == 45.0  # 10 + (10 + 25)
    assert scalar(cube, "Variance", place("South"), month("2026", "2026-01")).value == -2.0
    assert scalar(cube, "Variance", place("North")) == Cell.missing()
    assert scalar(cube, "ViaRef", place("South")).value == 75.0  # a lag behind a reference is not checked


# --- shapes


def test_one_action_per_query(cube, spark):
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one", "one query")
    ask(cube, Axes.pivot(COUNTRIES, MONTHS), "amount", "Price", "YTD")
    jobs = seen.getJobIdsForGroup("one")
    spark.sparkContext.setJobGroup("other", "")
    assert len(jobs) <= 4  # one collect, adaptive stages counted as jobs


def test_pivot_and_autoexists(cube):
    r = ask(cube, Axes.pivot(COUNTRIES, REGIONS), "amount", "Answer")
    assert isinstance(r, Pivot) and len(r.col_headers) == 4
    assert [[c.value for c in row] for row in r.cells] == [[5.0, 42.0, None, None], [70.0, 42.0, None, None], [None, None, 16.0, 42.0]]
    r = series(cube, COUNTRIES, "Answer", slicer=Tuple.of(place("North")))
    assert [c.state for c in r.rows[0].values] == ["valid", "valid", "missing"]  # a coordinate that can't be has no facts
    flat = MemberRef.of("Geography", "Flat", "US")
    assert series(cube, COUNTRIES, slicer=Tuple.of(flat)).rows[0].values == [Cell.missing()] * 3


def test_pages(cube):
    r = ask(cube, Axes.paged(REGIONS, MONTHS, YEARS), "amount")
    assert [str(t) for t in r.col_headers] == ["2025/2025-01", "2025/2025-02", "2026/2026-01", "2026/2026-02"]
    r = ask(cube, Axes.paged(REGIONS, YEARS, Members("Scenario", "Default", "Plan")), "amount")
    assert [str(t) for t in r.col_headers] == ["2025 × Actual", "2026 × Actual", "2025 × Plan", "2026 × Plan"]


def test_rollup(cube):
    r = ask(cube, Axes.pivot(place("North").descendants_to("Country"), YEARS), "amount")
    assert isinstance(r, Rollup) and r.value.value == 75.0
    assert [(c.root.path[-1], c.value.value) for c in r.children] == [("CA", 5.0), ("US", 70.0)]
    assert isinstance(ask(cube, Axes.pivot(REGIONS.descendants_to("Country"), YEARS), "amount"), Pivot)
    assert isinstance(ask(cube, Axes.pivot(place("North").descendants_to("Country").top(9, "amount"), YEARS), "amount"), Pivot)
    with pytest.raises(E.EvalSetCompositionIllFormed):
        ask(cube, Axes.pivot(place("North").descendants_to("Country"), YEARS))


def test_options(cube):
    kw = {"slicer": Tuple.of(plan("Plan"))}
    assert paths(series(cube, COUNTRIES, non_empty=True, **kw)) == ["South/BR"]
    order = lambda d, m="amount": (OrderBy(m, d),)
    assert paths(series(cube, COUNTRIES, order=order("desc"))) == ["North/US", "South/BR", "North/CA"]
    assert paths(series(cube, COUNTRIES, order=order("asc"), **kw)) == ["North/CA", "North/US", "South/BR"]  # missing first
    assert paths(series(cube, COUNTRIES, order=order("desc", "units"))) == ["North/CA", "North/US", "South/BR"]  # not asked for
    assert paths(series(cube, COUNTRIES, order=order("desc"), limit=1)) == ["North/US"]
    r = ask(cube, Axes.pivot(COUNTRIES, MONTHS), "amount", order=order("desc"), limit=2)
    assert [str(t) for t in r.row_headers] == ["North/US", "North/CA"]
    assert isinstance(ask(cube, Axes.series(COUNTRIES), non_empty=True), Series)
    assert paths(ask(cube, Axes.series(COUNTRIES), non_empty=True)) == []  # no metric: nothing that isn't empty


def test_tidy_rows(cube):
    rows = cube.query_df(Query(Axes.pivot(REGIONS, YEARS), ACTUAL, ("amount", "Answer"))).collect()
    assert len(rows) == 8 and {r["metric"] for r in rows} == {"amount", "Answer"}
    tree = cube.query_df(Query(Axes.pivot(place("North").descendants_to("Country"), YEARS), ACTUAL, ("amount",))).collect()
    assert [(r["row"], r["col_ord"]) for r in tree] == [("North", 1), ("North/CA", 2), ("North/US", 2)]
