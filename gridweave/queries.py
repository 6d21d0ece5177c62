"""One query per cube operator over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalogue import Relation, hierarchies, member_paths
from .engine import SparkCube
from .query import Axes, Explicit, MemberRef, Members, Named, Options, OrderBy, Predicate, Query, Range, Tuple
from .schema import Aggregation, Dimension, Hierarchy, Level, Measure, Schema
from .sources.star import sales_facts, sales_schema, stock_facts, stock_schema
from .sources.tables import read_csv, shared_path, with_lookup

_CUBES: dict[tuple, SparkCube] = {}

#: Digits that both sides round to: sums of doubles depend on their order in the last ones.
DIGITS = 4


def cube(spark: SparkSession, sf_dir: str, kind: str = "sales") -> SparkCube:
    """The cube of a folder, kept for the session: its catalogue is built once."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _CUBES:
        facts, schema = (sales_facts, sales_schema) if kind == "sales" else (stock_facts, stock_schema)
        _CUBES[key] = SparkCube(facts(spark, sf_dir), schema())
    return _CUBES[key]


def _place(*p: str) -> MemberRef:
    return MemberRef.of("Geography", "Default", *p)


def _time(*p: str) -> MemberRef:
    return MemberRef.of("Time", "Calendar", *p)


def _status(s: str) -> MemberRef:
    return MemberRef.of("Scenario", "Default", s)


REGIONS, NATIONS = Members("Geography", "Default", "Region"), Members("Geography", "Default", "Nation")
YEARS, QUARTERS, MONTHS = (Members("Time", "Calendar", x) for x in ("Year", "Quarter", "Month"))
STATUSES, TYPES = Members("Scenario", "Default", "Status"), Members("Product", "Default", "Type")
NOTHING = Tuple()
F_ONLY = Tuple.of(_status("F"))
ASIA, AFRICA = _place("ASIA"), _place("AFRICA")
#: A slice with months that have no facts.
THIN = Tuple.of(_status("F"), _place("AFRICA", "NATION_0"))

_SALES = """sales AS (
  SELECT r_name AS region, n_name AS nation, p_type AS ptype, p_brand AS brand, strftime(o_orderdate, '%Y') AS yr,
         strftime(o_orderdate, '%Y') || '-Q' || quarter(o_orderdate) AS qtr, strftime(o_orderdate, '%Y-%m') AS mon,
         l_linestatus AS scenario, l_extendedprice AS revenue, l_quantity AS quantity, l_orderkey AS orders
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey)"""
_STOCK = """stock AS (
  SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H') AS hr, event_type AS channel, coalesce(value, 0) AS value FROM events)"""
_CELL = f"""SELECT row_ord::BIGINT AS row_ord, col_ord::BIGINT AS col_ord, "row", col, metric,
  CASE WHEN v IS NULL THEN 'missing' ELSE 'valid' END AS state, round(v::DOUBLE, {DIGITS}) AS value,
  CASE WHEN v IS NULL THEN coalesce(why, 'no_facts') END AS reason FROM cells"""


def _sql(cells: str, more: str = "", base: str = _SALES, final: str = _CELL) -> str:
    return f"WITH {base}{', ' + more if more else ''}, cells AS ({cells})\n{final}"


def _cells(row: str = "''", v: str = "sum(revenue)", metric: str = "revenue", where: str = "TRUE", row_ord: str = "0", col: str = "''", col_ord: str = "0", source: str = "sales", why: str = "NULL") -> str:
    return f"SELECT {row_ord} AS row_ord, {col_ord} AS col_ord, {row} AS \"row\", {col} AS col, '{metric}' AS metric, {v} AS v, {why}::VARCHAR AS why FROM {source} WHERE {where}"


# the members of a level in order, with their place in the order: from all facts, whatever is sliced
_LEVELS = {
    "region": "r AS (SELECT region AS label, region, row_number() OVER (ORDER BY region) - 1 AS ord FROM (SELECT DISTINCT region FROM sales))",
    "nation": "r AS (SELECT region || '/' || nation AS label, region, nation, row_number() OVER (ORDER BY region, nation) - 1 AS ord FROM (SELECT DISTINCT region, nation FROM sales))",
    "yr": "r AS (SELECT yr AS label, yr, row_number() OVER (ORDER BY yr) - 1 AS ord FROM (SELECT DISTINCT yr FROM sales))",
    "mon": "r AS (SELECT yr || '/' || qtr || '/' || mon AS label, yr, qtr, mon, row_number() OVER (ORDER BY yr, qtr, mon) - 1 AS ord FROM (SELECT DISTINCT yr, qtr, mon FROM sales))",
}


def _by(level: str, v: str = "sum(revenue)", metric: str = "revenue", where: str = "TRUE", keep: str = "TRUE", order: str = "ord", limit: str = "", shown: str = "v") -> str:
    """SQL of a series over a level; `keep`, `order` and `limit` arrange its rows, `shown` is the cell's value."""
    a = f"a AS (SELECT {level}, {v} AS v FROM sales WHERE {where} GROUP BY {level})"
    x = f"x AS (SELECT ord, label, r.{level}, v FROM r LEFT JOIN a ON r.{level} = a.{level})"
    k = f"k AS (SELECT label, v, row_number() OVER (ORDER BY {order}) - 1 AS n FROM x WHERE {keep})"
    cells = f"SELECT n AS row_ord, 0 AS col_ord, label AS \"row\", '' AS col, '{metric}' AS metric, {shown} AS v, NULL::VARCHAR AS why FROM k {limit}"
    return _sql(cells, ", ".join((_LEVELS[level], a, x, k)))


def _months(shown: str, metric: str, where: str = "scenario = 'F' AND nation = 'NATION_0'", why: str = "NULL") -> str:
    """SQL of a series over all months of window expressions on the sliced revenue v."""
    a = f"a AS (SELECT mon, sum(revenue) AS v FROM sales WHERE {where} GROUP BY mon)"
    x = "x AS (SELECT ord, label, yr, qtr, v FROM r LEFT JOIN a USING (mon))"
    cells = f"SELECT ord AS row_ord, 0 AS col_ord, label AS \"row\", '' AS col, '{metric}' AS metric, {shown} AS v, {why}::VARCHAR AS why FROM x"
    return _sql(cells, ", ".join((_LEVELS["mon"], a, x)))


def _nav(paths: str, order: str = "m") -> str:
    return f"WITH {_SALES}, p AS ({paths}) SELECT row_number() OVER (ORDER BY {order}) - 1 AS ord, dim, hierarchy, m AS member FROM p"


def _q(axes: Axes, *metrics: str, slicer: Tuple = NOTHING, **options) -> Query:
    return Query(axes, slicer, metrics, Options(**options))


_GRID = """SELECT r.ord AS row_ord, c.ord AS col_ord, r.label AS "row", c.label AS col, 'revenue' AS metric, v, NULL::VARCHAR AS why"""
_YEARS_AS_C = "c AS (SELECT yr AS label, yr, row_number() OVER (ORDER BY yr) - 1 AS ord FROM (SELECT DISTINCT yr FROM sales))"
_ERROR = """SELECT row_ord::BIGINT AS row_ord, col_ord::BIGINT AS col_ord, "row", col, metric, 'error' AS state, NULL::DOUBLE AS value, NULL::VARCHAR AS reason FROM cells"""
_THIN = "scenario = 'F' AND nation = 'NATION_0'"
_FRAME = "ROWS UNBOUNDED PRECEDING"

#: name -> (query, SQL), over the sales cube.
SALES: dict[str, tuple[Query, str]] = {
    "scalar_sum": (_q(Axes.scalar(), "revenue", slicer=Tuple.of(_time("1995"), _status("F"))), _sql(_cells(row="'1995 × F'", where="yr = '1995' AND scenario = 'F'"))),
    "scalar_multi_metric": (
        _q(Axes.scalar(), "revenue", "quantity", "UnitPrice"),
        _sql(" UNION ALL ".join((_cells(), _cells(v="sum(quantity)", metric="quantity", col_ord="1"), _cells(v="sum(revenue) / sum(quantity)", metric="UnitPrice", col_ord="2")))),
    ),
    "agg_avg": (_q(Axes.series(NATIONS), "avg_price"), _by("nation", "avg(revenue)", "avg_price")),
    "agg_min": (_q(Axes.series(NATIONS), "min_price"), _by("nation", "min(revenue)", "min_price")),
    "agg_max": (_q(Axes.series(NATIONS), "max_price"), _by("nation", "max(revenue)", "max_price")),
    "agg_count": (_q(Axes.series(NATIONS), "lines"), _by("nation", "count(*)", "lines")),
    "agg_distinct_count": (_q(Axes.series(NATIONS), "orders"), _by("nation", "count(DISTINCT orders)", "orders")),
    "set_members": (_q(Axes.series(NATIONS), "revenue", slicer=F_ONLY), _by("nation", where="scenario = 'F'")),
    "set_children": (_q(Axes.series(Explicit((ASIA, AFRICA)).children()), "revenue"), _by("nation", keep="label LIKE 'ASIA/%' OR label LIKE 'AFRICA/%'", order="label LIKE 'AFRICA/%', ord")),
    "set_descendants": (
        _q(Axes.series(_time("1995").descendants_to("Month")), "revenue"),
        _sql(
            "SELECT row_number() OVER (ORDER BY qtr, coalesce(mon, '')) - 1 AS row_ord, 0 AS col_ord, '1995/' || qtr || coalesce('/' || mon, '') AS \"row\", '' AS col, 'revenue' AS metric, v, NULL::VARCHAR AS why "
            "FROM (SELECT qtr, mon, sum(revenue) AS v FROM sales WHERE yr = '1995' GROUP BY GROUPING SETS ((qtr), (qtr, mon)))"
        ),
    ),
    "set_range": (
        _q(Axes.series(Range("Time", "Calendar", _time("1995", "1995-Q4", "1995-11"), _time("1996", "1996-Q1", "1996-02"))), "revenue"),
        _by("mon", keep="mon BETWEEN '1995-11' AND '1996-02'"),
    ),
    "set_named": (_q(Axes.series(Named("AllRegions")), "revenue"), _by("region")),
    "set_explicit": (
        _q(Axes.series(Explicit((ASIA, AFRICA, ASIA))), "revenue"),
        _sql("SELECT row_ord, 0 AS col_ord, region AS \"row\", '' AS col, 'revenue' AS metric, (SELECT sum(revenue) FROM sales WHERE sales.region = t.region) AS v, NULL::VARCHAR AS why FROM (VALUES (0, 'ASIA'), (1, 'AFRICA'), (2, 'ASIA')) t(row_ord, region)"),
    ),
    "set_cross_join": (
        _q(Axes.pivot(REGIONS.cross(STATUSES), Explicit((_time("1995"),))), "revenue"),
        _sql(
            "SELECT row_number() OVER (ORDER BY a.region, b.scenario) - 1 AS row_ord, 0 AS col_ord, a.region || ' × ' || b.scenario AS \"row\", '1995' AS col, 'revenue' AS metric, (SELECT sum(revenue) FROM sales s WHERE s.region = a.region AND s.scenario = b.scenario AND yr = '1995') AS v, NULL::VARCHAR AS why "
            "FROM (SELECT DISTINCT region FROM sales) a, (SELECT DISTINCT scenario FROM sales) b"
        ),
    ),
    "set_union": (_q(Axes.series(ASIA.children().union(NATIONS)), "revenue"), _by("nation", order="label NOT LIKE 'ASIA/%', ord")),
    "set_filter_eq": (_q(Axes.series(REGIONS.filter(Predicate.eq("Answer", 42))), "revenue"), _by("region")),
    "set_filter_gt": (_q(Axes.series(NATIONS.filter(Predicate.gt("UnitPrice", 2090))), "revenue", slicer=F_ONLY), _sql(
        "SELECT row_number() OVER (ORDER BY ord) - 1 AS row_ord, 0 AS col_ord, label AS \"row\", '' AS col, 'revenue' AS metric, (SELECT sum(revenue) FROM sales WHERE sales.nation = r.nation AND scenario = 'F') AS v, NULL::VARCHAR AS why FROM r WHERE (SELECT sum(revenue) / sum(quantity) FROM sales WHERE sales.nation = r.nation) > 2090", _LEVELS["nation"])),
    "set_filter_lt": (_q(Axes.series(NATIONS.filter(Predicate.lt("quantity", 60000))), "quantity"), _by("nation", "sum(quantity)", "quantity", keep="v < 60000")),
    "set_filter_in": (_q(Axes.series(NATIONS.filter(Predicate.is_in("Geography", "ASIA"))), "revenue"), _by("nation", keep="label LIKE 'ASIA/%'")),
    "set_filter_not_in": (_q(Axes.series(NATIONS.filter(Predicate.not_in("Geography", "ASIA"))), "revenue"), _by("nation", keep="label NOT LIKE 'ASIA/%'")),
    "set_top_n": (_q(Axes.series(NATIONS.top(7, "UnitPrice")), "UnitPrice"), _by("nation", "sum(revenue) / sum(quantity)", "UnitPrice", order="v DESC, ord", limit="WHERE n < 7")),
    "expr_const": (_q(Axes.series(REGIONS), "Answer"), _by("region", "42", "Answer")),
    "expr_add": (_q(Axes.series(NATIONS), "Plus"), _by("nation", "sum(revenue) + sum(quantity)", "Plus")),
    "expr_sub": (_q(Axes.series(NATIONS), "Minus"), _by("nation", "sum(revenue) - sum(quantity)", "Minus")),
    "expr_mul": (_q(Axes.series(NATIONS), "Times"), _by("nation", "sum(revenue) * 0.5", "Times")),
    "expr_div": (_q(Axes.series(NATIONS), "UnitPrice"), _by("nation", "sum(revenue) / sum(quantity)", "UnitPrice")),
    "expr_div_zero": (_q(Axes.series(REGIONS), "DivZero"), _by("region", metric="DivZero").replace(_CELL, _ERROR)),
    "expr_non_finite": (_q(Axes.series(REGIONS), "Overflow"), _by("region", metric="Overflow").replace(_CELL, _ERROR)),
    "expr_ref_chain": (_q(Axes.series(NATIONS), "Chained"), _by("nation", "sum(revenue) / sum(quantity) * 2", "Chained")),
    "expr_lag": (_q(Axes.series(MONTHS), "Previous", slicer=THIN), _months("lag(v, 1) OVER (ORDER BY ord)", "Previous")),
    "expr_lead": (_q(Axes.series(MONTHS), "Next", slicer=THIN), _months("lead(v, 1) OVER (ORDER BY ord)", "Next")),
    "expr_yoy": (_q(Axes.series(MONTHS), "YoY"), _months("v / lag(v, 12) OVER (ORDER BY ord) - 1", "YoY", where="TRUE")),
    "expr_ptd_year": (_q(Axes.series(MONTHS), "YTD", slicer=THIN), _months(f"coalesce(sum(v) OVER (PARTITION BY yr ORDER BY ord {_FRAME}), 0)", "YTD")),
    "expr_ptd_quarter": (_q(Axes.series(MONTHS), "QTD", slicer=THIN), _months(f"coalesce(sum(v) OVER (PARTITION BY qtr ORDER BY ord {_FRAME}), 0)", "QTD")),
    "expr_at_variance": (
        _q(Axes.series(YEARS), "Variance"),
        _by("yr", "sum(revenue) FILTER (scenario = 'F') - sum(revenue) FILTER (scenario = 'O')", "Variance"),
    ),
    "axes_series": (_q(Axes.series(MONTHS), "revenue", slicer=THIN), _months("v", "revenue")),
    "axes_pivot": (
        _q(Axes.pivot(NATIONS, MONTHS), "revenue", slicer=F_ONLY),
        _sql(
            f"{_GRID} FROM r CROSS JOIN c LEFT JOIN (SELECT nation, mon, sum(revenue) AS v FROM sales WHERE scenario = 'F' GROUP BY ALL) a ON a.nation = r.nation AND a.mon = c.mon",
            f"{_LEVELS['nation']}, {_LEVELS['mon'].replace('r AS', 'c AS', 1)}",
        ),
    ),
    "axes_pivot_multi_metric": (
        _q(Axes.pivot(REGIONS, YEARS), "revenue", "quantity"),
        _sql(
            "SELECT r.ord AS row_ord, 2 * c.ord + k AS col_ord, r.label AS \"row\", c.label AS col, CASE k WHEN 0 THEN 'revenue' ELSE 'quantity' END AS metric, CASE k WHEN 0 THEN v0 ELSE v1 END AS v, NULL::VARCHAR AS why "
            "FROM r CROSS JOIN c CROSS JOIN (VALUES (0), (1)) t(k) LEFT JOIN (SELECT region, yr, sum(revenue) AS v0, sum(quantity) AS v1 FROM sales GROUP BY ALL) a ON a.region = r.region AND a.yr = c.yr",
            f"{_LEVELS['region']}, {_YEARS_AS_C}",
        ),
    ),
    "axes_pages": (
        _q(Axes.paged(REGIONS, YEARS, STATUSES), "revenue"),
        _sql(
            "SELECT r.ord AS row_ord, row_number() OVER (PARTITION BY r.ord ORDER BY p.scenario, c.ord) - 1 AS col_ord, r.label AS \"row\", c.label || ' × ' || p.scenario AS col, 'revenue' AS metric, v, NULL::VARCHAR AS why "
            "FROM r CROSS JOIN c CROSS JOIN (SELECT DISTINCT scenario FROM sales) p LEFT JOIN (SELECT region, yr, scenario, sum(revenue) AS v FROM sales GROUP BY ALL) a ON a.region = r.region AND a.yr = c.yr AND a.scenario = p.scenario",
            f"{_LEVELS['region']}, {_YEARS_AS_C}",
        ),
    ),
    "axes_transpose": (
        _q(Axes.pivot(YEARS, REGIONS).transpose(), "revenue"),
        _sql(f"{_GRID} FROM r CROSS JOIN c LEFT JOIN (SELECT region, yr, sum(revenue) AS v FROM sales GROUP BY ALL) a ON a.region = r.region AND a.yr = c.yr", f"{_LEVELS['region']}, {_YEARS_AS_C}"),
    ),
    "autoexists_same_dim": (
        _q(Axes.pivot(NATIONS, REGIONS), "revenue"),
        _sql(
            f"{_GRID} FROM r CROSS JOIN c LEFT JOIN (SELECT region, nation, sum(revenue) AS v FROM sales GROUP BY ALL) a ON a.nation = r.nation AND a.region = c.region",
            f"{_LEVELS['nation']}, {_LEVELS['region'].replace('r AS', 'c AS', 1)}",
        ),
    ),
    "autoexists_slicer": (_q(Axes.series(NATIONS), "revenue", slicer=Tuple.of(ASIA)), _by("nation", where="region = 'ASIA'")),
    "rollup_tree": (
        _q(Axes.pivot(_time("1995").descendants_to("Month"), REGIONS), "revenue", slicer=F_ONLY),
        _sql(
            "SELECT row_number() OVER (ORDER BY coalesce(qtr, ''), coalesce(mon, '')) - 1 AS row_ord, 1 + (qtr IS NOT NULL)::INT + (mon IS NOT NULL)::INT AS col_ord, '1995' || coalesce('/' || qtr, '') || coalesce('/' || mon, '') AS \"row\", '' AS col, 'revenue' AS metric, sum(revenue) FILTER (scenario = 'F') AS v, NULL::VARCHAR AS why "
            "FROM sales WHERE yr = '1995' GROUP BY GROUPING SETS ((), (qtr), (qtr, mon))"
        ),
    ),
    "opt_non_empty": (_q(Axes.series(MONTHS), "revenue", slicer=THIN, non_empty=True), _by("mon", where=_THIN, keep="v IS NOT NULL")),
    "opt_order_desc": (_q(Axes.series(NATIONS), "revenue", order=(OrderBy("revenue", "desc"),)), _by("nation", order="v DESC NULLS LAST, ord")),
    "opt_order_asc": (_q(Axes.series(MONTHS), "revenue", slicer=THIN, order=(OrderBy("revenue", "asc"),)), _by("mon", where=_THIN, order="v ASC NULLS FIRST, ord")),
    "opt_limit": (_q(Axes.series(NATIONS), "revenue", order=(OrderBy("revenue", "desc"),), limit=5), _by("nation", order="v DESC NULLS LAST, ord", limit="WHERE n < 5")),
}

_TIME_PATHS = "SELECT DISTINCT 'Time' AS dim, 'Calendar' AS hierarchy, {m} AS m FROM sales WHERE {w}"
_PLACE_PATHS = "SELECT DISTINCT 'Geography' AS dim, 'Default' AS hierarchy, {m} AS m FROM sales WHERE {w}"

#: name -> (relation, member, SQL), over the sales cube.
NAVIGATION: dict[str, tuple[Relation, MemberRef, str]] = {
    "nav_children": (Relation("children"), ASIA, _nav(_PLACE_PATHS.format(m="'ASIA/' || nation", w="region = 'ASIA'"))),
    "nav_descendants": (
        Relation("descendants", 2),
        _time("1995"),
        _nav(_TIME_PATHS.format(m="'1995/' || qtr", w="yr = '1995'") + " UNION ALL " + _TIME_PATHS.format(m="'1995/' || qtr || '/' || mon", w="yr = '1995'")),
    ),
    "nav_siblings": (Relation("siblings"), ASIA, _nav(_PLACE_PATHS.format(m="region", w="region <> 'ASIA'"))),
    "nav_parent": (Relation("parent"), _time("1995", "1995-Q2", "1995-05"), _nav("SELECT 'Time' AS dim, 'Calendar' AS hierarchy, '1995/1995-Q2' AS m")),
    "nav_leaves": (Relation("leaves"), _time("1995"), _nav(_TIME_PATHS.format(m="'1995/' || qtr || '/' || mon", w="yr = '1995'"))),
}

_HOURS = "SELECT channel, {keys}, sum(value) AS s FROM stock WHERE {where} GROUP BY ALL"


def _stock(fold: str, value: str, where: str = "TRUE", keys: str = "hr") -> str:
    cells = (
        f"SELECT row_number() OVER (ORDER BY channel) - 1 AS row_ord, 0 AS col_ord, channel AS \"row\", '' AS col, '{fold}' AS metric, v, NULL::VARCHAR AS why "
        f"FROM (SELECT channel, {value} AS v FROM ({_HOURS.format(keys=keys, where=where)}) GROUP BY channel)"
    )
    return _sql(cells, base=_STOCK)


_CHANNELS = Members("Channel", "Default", "Channel")
_DAY = "strftime((SELECT min(ts) FROM events), '%Y-%m-%d')"

#: name -> (query or a function of the cube giving one, SQL), over the stock cube.
STOCK: dict[str, tuple[Query | Callable, str]] = {
    "semi_first": (_q(Axes.series(_CHANNELS), "stock_first"), _stock("stock_first", "min_by(s, hr)")),
    "semi_last": (_q(Axes.series(_CHANNELS), "stock_last"), _stock("stock_last", "max_by(s, hr)")),
    "semi_min": (_q(Axes.series(_CHANNELS), "stock_min"), _stock("stock_min", "min(s)")),
    "semi_max": (_q(Axes.series(_CHANNELS), "stock_max"), _stock("stock_max", "max(s)")),
    "semi_avg": (_q(Axes.series(_CHANNELS), "stock_avg"), _stock("stock_avg", "avg(s)")),
    "semi_bound_sum": (
        lambda own: _q(Axes.pivot(_CHANNELS, Explicit((own.level_members("Time", "Clock", "Day")[0],))), "stock_last"),
        _stock("stock_last", "sum(s)", where=f"day = {_DAY}").replace("'' AS col", f"{_DAY} AS col"),
    ),
    "semi_multi_dim": (
        _q(Axes.scalar(), "stock_both"),
        _sql("SELECT 0 AS row_ord, 0 AS col_ord, '' AS \"row\", '' AS col, 'stock_both' AS metric, max_by(s, hr || '|' || channel) AS v, NULL::VARCHAR AS why FROM (SELECT hr, channel, sum(value) AS s FROM stock GROUP BY ALL)", base=_STOCK),
    ),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", DIGITS))


def _cube_query(kind: str, query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = cube(spark, sf_dir, kind)
        return _rounded(own.query_df(query(own) if callable(query) else query))

    return run


def _navigation(relation: Relation, at: MemberRef) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = cube(spark, sf_dir)
        return own.members_df(own.members(at.dim, at.hierarchy, at, relation))

    return run


def _level_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cube(spark, sf_dir)
    return own.members_df(own.level_members("Geography", "Default", "Nation"))


#: Continent-like groups of regions, for a level that the facts don't have.
ZONES = {"AFRICA": "South", "AMERICA": "West", "ASIA": "East"}


def _derived_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cube whose top level is looked up from another column."""
    facts = with_lookup(sales_facts(spark, sf_dir).select("region", "revenue"), "zone", "region", ZONES)
    return _rounded(SparkCube(facts, _zone_schema()).query_df(_q(Axes.series(Members("Place", "Default", "Zone")), "revenue")))


def _zone_schema() -> Schema:
    levels = (("Zone", "zone"), ("Region", "region"))
    return Schema.builder().dimension(Dimension.regular("Place", Hierarchy("Default", tuple(Level(*x) for x in levels)))).measure(Measure("revenue", Aggregation("sum"))).build()


def _csv(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    """A cube over a CSV file with a header, its types given, inferred, or inferred from a share of the rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = sales_facts(spark, sf_dir).groupBy("region", "scenario").agg(F.sum("revenue").alias("revenue"))
        path = shared_path(spark, "facts.csv")
        with_lookup(rows, "zone", "region", ZONES).write.mode("overwrite").option("header", True).csv(path)
        how = {"given": {"schema": "region string, scenario string, revenue double, zone string"}, "inferred": {}, "sampled": {"sample": 0.5}}[kind]
        return _rounded(SparkCube(read_csv(spark, path, **how), _zone_schema()).query_df(_q(Axes.series(Members("Place", "Default", "Region")), "revenue")))

    return run


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members of all hierarchies, as the catalogue's scan finds them."""
    own = cube(spark, sf_dir)
    names = F.array(*(F.lit(d.name) for d, _ in hierarchies(own.schema())))
    return member_paths(own.facts, own.schema()).select(F.element_at(names, F.col("h") + 1).alias("dim"), F.array_join("path", "/").alias("member"))


def _exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether paths are members: one that is, one that isn't, and one under another parent."""
    own = cube(spark, sf_dir)
    asked = [ASIA, _place("ATLANTIS"), _place("ASIA", own.level_members("Geography", "Default", "Nation")[0].path[1])]
    return own._local([("/".join(m.path), float(own.catalogue.exists(m))) for m in asked], "member string, found double")


_ZONED = _SALES + """, zoned AS (SELECT *, CASE region WHEN 'AFRICA' THEN 'South' WHEN 'AMERICA' THEN 'West' WHEN 'ASIA' THEN 'East' ELSE 'Other' END AS zone FROM sales)"""
_BY_ZONE = "SELECT row_number() OVER (ORDER BY label) - 1 AS row_ord, 0 AS col_ord, label AS \"row\", '' AS col, 'revenue' AS metric, v, NULL::VARCHAR AS why FROM (SELECT {k} AS label, sum(revenue) AS v FROM zoned GROUP BY ALL)"
_PLAIN_SQL = {
    "source_derived_level": _sql(_BY_ZONE.format(k="zone"), base=_ZONED),
    **{f"source_csv_{kind}": _sql(_BY_ZONE.format(k="zone || '/' || region"), base=_ZONED) for kind in ("given", "inferred", "sampled")},
    "catalogue_members": f"WITH {_SALES} "
    + " UNION ALL ".join(
        f"SELECT DISTINCT '{dim}' AS dim, {member} AS member FROM sales"
        for dim, members in (("Geography", ("region", "region || '/' || nation")), ("Product", ("ptype", "ptype || '/' || brand")), ("Time", ("yr", "yr || '/' || qtr", "yr || '/' || qtr || '/' || mon")), ("Scenario", ("scenario",)))
        for member in members
    ),
    "catalogue_exists": f"WITH {_SALES}, first AS (SELECT nation, region FROM sales ORDER BY region, nation LIMIT 1) "
    "SELECT 'ASIA' AS member, (count(*) > 0)::DOUBLE AS found FROM sales WHERE region = 'ASIA' UNION ALL SELECT 'ATLANTIS', 0::DOUBLE "
    "UNION ALL SELECT 'ASIA/' || nation, (SELECT (count(*) > 0)::DOUBLE FROM sales s WHERE s.region = 'ASIA' AND s.nation = first.nation) FROM first",
}
_PLAIN = {"source_derived_level": _derived_level, "catalogue_members": _catalogue, "catalogue_exists": _exists, **{f"source_csv_{kind}": _csv(kind) for kind in ("given", "inferred", "sampled")}}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {n: _cube_query("sales", q) for n, (q, _) in SALES.items()}
    | {n: _cube_query("stock", q) for n, (q, _) in STOCK.items()}
    | {n: _navigation(r, at) for n, (r, at, _) in NAVIGATION.items()}
    | {"nav_level_members": _level_members}
    | _PLAIN
)
SQL: dict[str, str] = (
    {n: s for n, (_, s) in SALES.items()}
    | {n: s for n, (_, s) in STOCK.items()}
    | {n: s for n, (_, _, s) in NAVIGATION.items()}
    | {"nav_level_members": _nav(_PLACE_PATHS.format(m="region || '/' || nation", w="TRUE"))}
    | _PLAIN_SQL
)
