"""Small fact tables and schemas with results worked out by hand."""

from gridweave.query import MemberRef, Tuple
from gridweave.schema import Aggregation, At, Const, Dimension, Hierarchy, Lag, Level, Measure, Metric, NamedSet, PeriodsToDate, Ref, Schema
from gridweave.query import Members, Named


def hierarchy(name, *levels):
    return Hierarchy(name, tuple(Level(*x) for x in levels))


GEO = Dimension.regular("Geography", hierarchy("Default", ("Region", "region"), ("Country", "country")), hierarchy("Flat", ("Country", "country")))
TIME = Dimension.time("Time", hierarchy("Fiscal", ("Year", "year"), ("Month", "month")))
PLAN = Dimension.scenario("Scenario", hierarchy("Default", ("Plan", "plan")))


def place(*p):
    return MemberRef.of("Geography", "Default", *p)


def month(*p):
    return MemberRef.of("Time", "Fiscal", *p)


def plan(p):
    return MemberRef.of("Scenario", "Default", p)


#: region, country, year, month, plan, amount, units
ROWS = [
    ("North", "US", "2025", "2025-01", "Actual", 10.0, 1.0),
    ("North", "US", "2025", "2025-02", "Actual", 20.0, 2.0),
    ("North", "CA", "2025", "2025-02", "Actual", 5.0, 0.0),
    ("North", "US", "2026", "2026-01", "Actual", 40.0, 4.0),
    ("South", "BR", "2026", "2026-01", "Actual", 7.0, 1.0),
    ("South", "BR", "2026", "2026-01", "Plan", 9.0, 1.0),
    ("South", None, "2026", "2026-02", "Actual", 1.0, 1.0),
]
COLUMNS = "region string, country string, year string, month string, plan string, amount double, units double"


def schema() -> Schema:
    amount = Ref("amount")
    return (
        Schema.builder()
        .dimension(GEO, TIME, PLAN)
        .measure(Measure("amount", Aggregation("sum"), "EUR"), Measure("units", Aggregation("sum")))
        .metric(
            Metric("Revenue", amount, format="0.00"),
            Metric("Price", amount / Ref("units")),
            Metric("Answer", Const(42.0)),
            Metric("Infinite", Const(float("inf"))),
            Metric("Previous", Lag(amount, "Time", 1)),
            Metric("Same", Lag(amount, "Time", 0)),
            Metric("LagConst", Lag(Const(1.0), "Time", 1)),
            Metric("YTD", PeriodsToDate(amount, "Year")),
            Metric("YTDofYTD", PeriodsToDate(Ref("YTD"), "Year")),
            Metric("Variance", At(amount, Tuple.of(plan("Actual"))) - At(amount, Tuple.of(plan("Plan")))),
            Metric("Loop", Ref("Loop") + Const(1.0)),
            Metric("LagPlace", Lag(amount, "Geography", 1)),
            Metric("ViaRef", Ref("LagPlace") * Const(1.0)),
        )
        .named_set(NamedSet("Regions", Members("Geography", "Default", "Region")), NamedSet("Cycle", Named("Cycle")))
        .build()
    )


def facts(spark):
    return spark.createDataFrame(ROWS, COLUMNS)
