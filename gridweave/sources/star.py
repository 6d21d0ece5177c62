"""The two cubes over the test tables: sales (orders by place, product, time and status) and stock (events over time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..query import Descendants, Explicit, MemberRef, Members, Tuple
from ..schema import Aggregation, At, Calendar, Const, Dimension, Hierarchy, Lag, Level, Measure, Metric, NamedSet, PeriodsToDate, Ref, Schema


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with the attributes of its order, customer, place and part, one column per level and measure.

    Only foreign keys are joined, all inner; unused columns and joins' sides are pruned by the optimizer,
    which also decides by size which sides are broadcast.
    """
    t = {n: _read(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "nation", "region", "part")}
    joined = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
    )
    date = F.col("o_orderdate")
    return joined.select(
        F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("p_type").alias("ptype"), F.col("p_brand").alias("brand"),
        F.date_format(date, "yyyy").alias("year"),
        F.concat(F.date_format(date, "yyyy"), F.lit("-Q"), F.quarter(date).cast("string")).alias("quarter"),
        F.date_format(date, "yyyy-MM").alias("month"),
        F.col("l_linestatus").alias("scenario"),
        F.col("l_extendedprice").alias("revenue"), F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("avg_price"), F.col("l_extendedprice").alias("min_price"), F.col("l_extendedprice").alias("max_price"),
        F.col("l_orderkey").alias("orders"), F.col("l_orderkey").alias("lines"),
    )


def stock_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("value")
    return _read(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), F.col("event_type").alias("channel"),
        *(value.alias(f"stock_{fold}") for fold in ("first", "last", "avg", "min", "max")), value.alias("stock_both"),
    )


def _hierarchy(name: str, *levels: tuple[str, str]) -> Hierarchy:
    return Hierarchy(name, tuple(Level(*x) for x in levels))


def sales_schema() -> Schema:
    revenue = Ref("revenue")
    at = lambda s: At(revenue, Tuple.of(MemberRef.of("Scenario", "Default", s)))
    previous = Lag(revenue, "Time", 1)
    return (
        Schema.builder()
        .dimension(
            Dimension.regular("Geography", _hierarchy("Default", ("Region", "region"), ("Nation", "nation"))),
            Dimension.regular("Product", _hierarchy("Default", ("Type", "ptype"), ("Brand", "brand"))),
            Dimension.time("Time", _hierarchy("Calendar", ("Year", "year"), ("Quarter", "quarter"), ("Month", "month")), calendars=(Calendar("Gregorian"),)),
            Dimension.scenario("Scenario", _hierarchy("Default", ("Status", "scenario"))),
        )
        .measure(
            Measure("revenue", Aggregation("sum"), "USD"),
            Measure("quantity", Aggregation("sum")),
            Measure("avg_price", Aggregation("avg"), "USD"),
            Measure("min_price", Aggregation("min"), "USD"),
            Measure("max_price", Aggregation("max"), "USD"),
            Measure("orders", Aggregation("distinct_count")),
            Measure("lines", Aggregation("count")),
        )
        .metric(
            Metric("Revenue", revenue, format="#,##0.00"),
            Metric("Answer", Const(42.0)),
            Metric("Plus", revenue + Ref("quantity")),
            Metric("Minus", revenue - Ref("quantity")),
            Metric("Times", revenue * Const(0.5)),
            Metric("UnitPrice", revenue / Ref("quantity")),
            Metric("DivZero", revenue / Const(0.0)),
            Metric("Overflow", revenue * Const(1e300) * Const(1e300)),
            Metric("Chained", Ref("UnitPrice") * Const(2.0)),
            Metric("Previous", previous),
            Metric("Next", Lag(revenue, "Time", -1)),
            Metric("MoM", (revenue - previous) / previous),
            Metric("YoY", (revenue - Lag(revenue, "Time", 12)) / Lag(revenue, "Time", 12)),
            Metric("YTD", PeriodsToDate(revenue, "Year")),
            Metric("QTD", PeriodsToDate(revenue, "Quarter")),
            Metric("Variance", at("F") - at("O")),
        )
        .named_set(
            NamedSet("AllRegions", Members("Geography", "Default", "Region")),
            NamedSet("Nations", Descendants(Members("Geography", "Default", "Region"), "Nation")),
            NamedSet("Open", Explicit((MemberRef.of("Scenario", "Default", "O"),))),
        )
        .build()
    )


def stock_schema() -> Schema:
    semi = Aggregation.semi_additive
    return (
        Schema.builder()
        .dimension(
            Dimension.time("Time", _hierarchy("Clock", ("Day", "day"), ("Hour", "hour"))),
            Dimension.regular("Channel", _hierarchy("Default", ("Channel", "channel"))),
        )
        .measure(*(Measure(f"stock_{fold}", semi(["Time"], fold)) for fold in ("first", "last", "avg", "min", "max")))
        .measure(Measure("stock_both", semi(["Time", "Channel"], "last")))
        .build()
    )
