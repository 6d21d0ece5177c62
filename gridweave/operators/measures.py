"""Measures at many coordinates in one pass over the facts.

A coordinate pins level columns to values. Coordinates that pin the same columns share a grain; all
grains a query needs become the GROUPING SETS of one aggregation, so the facts are read once, combined
before the shuffle, and only the coordinates asked for are kept. Columns that every coordinate pins are
filtered before aggregation, by literals that reach the file scan. Semi-additive measures take a second,
small aggregation over the sums per key of their non-additive dimensions.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EvalAggregateFailed, EvalColumnMissing
from ..results import Cell
from ..schema import Measure, Schema

#: A column pinned to at most so many values is filtered by literals; beyond, the coordinates' join does it.
MOST_LITERALS = 500
#: Coordinates (about 100 bytes each) up to which their table is broadcast.
MOST_BROADCAST = 200_000

#: A coordinate: (dimension, hierarchy, path) of each bound member, in any order.
Coordinate = tuple[tuple[str, str, tuple[str, ...]], ...]


class Batch:
    """The (measure, coordinate) pairs that a query asks for."""

    def __init__(self, facts: DataFrame, schema: Schema):
        self.facts, self.schema = facts, schema
        self.wanted: dict[tuple[str, Coordinate], tuple | None] = {}
        self.found: dict[tuple[str, Coordinate], Cell] = {}

    def ask(self, measure: Measure, at: Coordinate) -> None:
        self.wanted.setdefault((measure.name, at), None)

    def cell(self, measure: Measure, at: Coordinate) -> Cell:
        return self.found[measure.name, at]

    # --- planning

    def _pins(self, at: Coordinate) -> dict[str, str] | None:
        """Column -> value; None where two members pin one column to different values."""
        pins: dict[str, str] = {}
        for dim, hierarchy, path in at:
            levels = self.schema.dimension(dim).hierarchy(hierarchy).levels
            for level, value in zip(levels, path, strict=False):
                if pins.setdefault(level.key, value) != value:
                    return None
        return pins

    def _open_keys(self, measure: Measure, at: Coordinate) -> tuple[str, ...]:
        """Leaf keys of the non-additive dimensions that the coordinate leaves open; none means a plain sum."""
        bound = {dim for dim, _, _ in at}
        keys = []
        for dim in measure.aggregation.non_additive_dims:
            if dim in bound:
                continue
            own = self.schema.dimension(dim)
            if own is None or not own.hierarchies or not own.hierarchies[0].levels:
                raise EvalAggregateFailed(measure=measure.name, reason=f"non-additive dimension {dim} has no levels")
            keys.append(own.hierarchies[0].levels[-1].key)
        return tuple(keys)

    def plan(self) -> tuple[list[DataFrame], list[list[str]], dict]:
        """Frames of (part, grain, key, n, values); what values mean by part; who asked for (part, grain, key)."""
        grains: dict[tuple[str, ...], int] = {}
        askers: dict[tuple[int, int, tuple[str, ...]], list] = {}
        plain: dict[str, None] = {}
        folded: dict[tuple[tuple[str, ...], str, tuple[str, ...]], None] = {}
        coordinates: set[tuple[tuple[str, ...], tuple[str, ...]]] = set()
        requests = []
        for measure, at in self.wanted:
            own = self.schema.measure(measure)
            pins = self._pins(at)
            if pins is None:
                self.found[measure, at] = Cell.missing()
                continue
            columns = tuple(sorted(pins))
            key = tuple(pins[c] for c in columns)
            grains.setdefault(columns, len(grains))
            open_keys = self._open_keys(own, at) if own.aggregation.kind == "semi_additive" else ()
            if open_keys:
                folded.setdefault((columns, measure, open_keys))
            else:
                plain.setdefault(measure)
            coordinates.add((columns, key))
            requests.append((measure, at, columns, key, open_keys))
        facts = self._narrowed(coordinates)
        frames, meaning = [], []
        part_of: dict = {}
        if plain:
            part_of[None] = len(frames)
            asked = dict.fromkeys(c for m, _, c, _, o in requests if not o)
            frames.append(self._plain(facts, list(plain), {c: grains[c] for c in asked}))
            meaning.append(list(plain))
        for columns, measure, open_keys in folded:
            part_of[columns, measure, open_keys] = len(frames)
            frames.append(self._folded(facts, self.schema.measure(measure), columns, grains[columns], open_keys))
            meaning.append([measure])
        for measure, at, columns, key, open_keys in requests:
            part = part_of[(columns, measure, open_keys) if open_keys else None]
            askers.setdefault((part, grains[columns], key), []).append((measure, at))
        return [f.select(F.lit(i).alias("part"), "*") for i, f in enumerate(frames)], meaning, askers

    def _column(self, name: str) -> Column:
        if name not in self.facts.columns:
            raise EvalColumnMissing(column=name)
        return F.col(f"`{name}`")

    def _narrowed(self, coordinates: Iterable) -> DataFrame:
        """Facts that any coordinate can hold, by the columns that all of them pin."""
        coordinates = list(coordinates)
        if not coordinates:
            return self.facts
        shared = set.intersection(*(set(columns) for columns, _ in coordinates))
        facts = self.facts
        for column in sorted(shared):
            values = sorted({key[columns.index(column)] for columns, key in coordinates})
            if len(values) <= MOST_LITERALS:
                kind = self.facts.schema[column].dataType
                literals = [int(v) for v in values] if isinstance(kind, T.IntegralType) else values
                facts = facts.where(self._column(column).isin(literals) if len(literals) > 1 else self._column(column) == F.lit(literals[0]))
        return facts

    def _plain(self, facts: DataFrame, measures: list[str], grains: dict[tuple[str, ...], int]) -> DataFrame:
        columns = sorted({c for grain in grains for c in grain})
        keyed = facts.select(
            *(self._column(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)),
            *(self._column(m).alias(f"m{i}") for i, m in enumerate(measures)),
        )
        values = [aggregate(self.schema.measure(m), f"m{i}") for i, m in enumerate(measures)]
        named = {c: f"k{i}" for i, c in enumerate(columns)}
        out = [F.count(F.lit(1)).alias("n"), F.array(*values).alias("values")]
        if len(grains) == 1:
            (grain, number), *_ = grains.items()
            keys = [named[c] for c in grain]
            rows = keyed.groupBy(*keys).agg(*out)
            return rows.select(F.lit(number).alias("grain"), F.array(*keys).cast("array<string>").alias("key"), "n", "values")
        # grouping_id has a bit for each column that a row's grain leaves out, the first column highest
        width = len(columns)
        bits = {sum(1 << (width - 1 - i) for i, c in enumerate(columns) if c not in grain): (grain, number) for grain, number in grains.items()}
        sets = [[named[c] for c in grain] for grain in grains]
        rows = keyed.groupingSets(sets, *(named[c] for c in columns)).agg(*out, F.grouping_id().alias("g"))
        number, key = F.lit(None).cast("int"), F.lit(None).cast("array<string>")
        for mask, (grain, n) in bits.items():
            number = F.when(F.col("g") == mask, F.lit(n)).otherwise(number)
            key = F.when(F.col("g") == mask, F.array(*(F.col(named[c]) for c in grain)).cast("array<string>")).otherwise(key)
        return rows.select(number.alias("grain"), key.alias("key"), "n", "values")

    def _folded(self, facts: DataFrame, measure: Measure, columns: tuple[str, ...], number: int, open_keys: tuple[str, ...]) -> DataFrame:
        keys, opens = [f"k{i}" for i in range(len(columns))], [f"o{i}" for i in range(len(open_keys))]
        keyed = facts.select(
            *(self._column(c).cast("string").alias(k) for c, k in zip(columns, keys, strict=True)),
            *(F.coalesce(self._column(c).cast("string"), F.lit("")).alias(o) for c, o in zip(open_keys, opens, strict=True)),
            F.coalesce(self._column(measure.name).cast("double"), F.lit(0.0)).alias("v"),
        )
        sums = keyed.groupBy(*keys, *opens).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
        order = F.struct(*opens)
        over = measure.aggregation.over
        fold = {"first": F.min_by("s", order), "last": F.max_by("s", order), "avg": F.avg("s"), "min": skip_nan(F.min, F.col("s")), "max": skip_nan(F.max, F.col("s"))}[over]
        rows = sums.groupBy(*keys).agg(F.sum("n").alias("n"), F.array(fold).alias("values"))
        return rows.select(F.lit(number).alias("grain"), F.array(*keys).cast("array<string>").alias("key"), "n", "values")

    def frame(self) -> tuple[DataFrame | None, list[list[str]], dict]:
        """All asked for, as one frame: rows of the coordinates that have facts."""
        frames, meaning, askers = self.plan()
        if not frames:
            return None, meaning, askers
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        spark = self.facts.sparkSession
        columns = list(zip(*askers, strict=True)) or [(), (), ()]
        types = (pa.int32(), pa.int32(), pa.list_(pa.string()))
        asked = spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "grain", "key"]))
        if len(askers) <= MOST_BROADCAST:
            asked = F.broadcast(asked)
        return out.join(asked, ["part", "grain", "key"], "left_semi"), meaning, askers

    def run(self) -> None:
        """Fetch everything asked for: one action, whose result is at most one row per coordinate."""
        if not self.wanted:
            return
        rows, meaning, askers = self.frame()
        got = {} if rows is None else {(r["part"], r["grain"], tuple(r["key"])): r for r in rows.collect()}
        for where, who in askers.items():
            row = got.get(where)
            for measure, at in who:
                own = self.schema.measure(measure)
                value = None if row is None or not row["n"] else row["values"][meaning[where[0]].index(measure)]
                if value is None:
                    cell = Cell.missing()
                elif math.isnan(value):
                    cell = Cell.error("not a number")
                else:
                    cell = Cell.valid(value, own.unit)
                self.found[measure, at] = cell


def skip_nan(function, value: Column) -> Column:
    """Minimum or maximum of the numbers; NaN only where nothing else is there."""
    return F.coalesce(function(F.when(~F.isnan(value), value)), F.max(value))


def aggregate(measure: Measure, column: str) -> Column:
    """The measure's rule as a double. Counting counts rows; sums of nulls alone are 0, other rules have none."""
    kind, value = measure.aggregation.kind, F.col(column)
    if kind == "count":
        return F.count(F.lit(1)).cast("double")
    if kind == "distinct_count":
        return F.countDistinct(value.cast("string")).cast("double")
    value = value.cast("double")
    if kind == "avg":
        return F.avg(value)
    if kind in ("min", "max"):
        return skip_nan(F.min if kind == "min" else F.max, value)
    return F.coalesce(F.sum(value), F.lit(0.0))  # sum, and semi_additive with all its dimensions bound
