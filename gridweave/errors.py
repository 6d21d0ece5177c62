"""All errors the library raises on purpose; each carries its facts as attributes."""

from __future__ import annotations


class CubeError(Exception):
    """Base class; `kind` is the class name, and the message is the template filled with the facts."""

    template = ""

    def __init__(self, **facts):
        self.facts = facts
        super().__init__(self.template.format(**facts))
        for key, value in facts.items():
            setattr(self, key, value)

    @property
    def kind(self) -> str:
        return type(self).__name__


class ParseError(CubeError):
    """A value from outside is not well formed."""


class SchemaError(CubeError):
    """A schema contradicts itself."""


class ConstructionError(CubeError):
    """Schema and facts don't fit."""


class ResolveError(CubeError):
    """A query names what is not there."""


class EvalError(CubeError):
    """A query can't be evaluated."""


def _kinds(base: type, **templates: str) -> None:
    for kind, template in templates.items():
        globals()[kind] = type(kind, (base,), {"template": template, "__module__": __name__})


_kinds(
    ParseError,
    InvalidName="not a name ({why}): {value!r}",
    InvalidUnit="not a unit: {value!r}",
    InvalidMonthDay="no such day in every year: month {month}, day {day}",
    EmptyPath="a path needs at least one segment",
    EmptyExplicit="an explicit set needs at least one member",
    RepeatedDimension="a tuple holds dimension {dim} twice",
    MalformedJson="malformed {what}: {why}",
)
_kinds(
    SchemaError,
    MissingDimension="a schema needs a dimension before its measures",
    MissingMeasure="a schema needs a measure before its metrics, named sets and build()",
    DuplicateDimension="two dimensions are named {name}",
    DuplicateMeasure="two measures are named {name}",
    DuplicateMetric="two metrics are named {name}",
    DuplicateNamedSet="two named sets are named {name}",
    NameCollision="{name} names two different things: {one} and {two}",
    UnresolvedMetricRef="metric {metric} refers to {name}, which is neither measure nor metric",
    EmptyNonAdditiveDims="a semi-additive measure needs a non-additive dimension",
)
_kinds(
    ConstructionError,
    MissingMeasureColumn="measure {measure}: the facts have no column {column}",
    MissingLevelColumn="dimension {dim}, hierarchy {hierarchy}, level {level}: the facts have no column {column}",
    MeasureDtypeMismatch="measure {measure}: column {column} of type {dtype} does not suit {aggregation}",
    LevelDtypeMismatch="dimension {dim}, level {level}: column {column} of type {dtype} can't be a level key",
    MalformedMemberValue="dimension {dim}, level {level}: {value!r} can't name a member",
    TooManyMembers="the hierarchies have more than {most} members, the most that the driver is to hold",
)
_kinds(
    ResolveError,
    UnknownHierarchy="dimension {dim} has no hierarchy {hierarchy}",
    MemberRefHierarchyMismatch="the member lies in ({actual_dim}, {actual_hierarchy}), not in ({expected_dim}, {expected_hierarchy})",
    UnknownMember="dimension {dim}, hierarchy {hierarchy}: no member {path}",
    UnsupportedRelation="relation not supported: {relation}",
    ResolveUnresolvedRef="no measure or metric {name}",
    ResolveAmbiguousRef="{name} is a measure and a metric",
    ResolveUnknownDimension="no dimension {dim}",
    ResolveUnknownHierarchy="no hierarchy {hierarchy} in dimension {dim}",
    ResolveUnknownLevel="no level {level} in dimension {dim}, hierarchy {hierarchy}",
    ResolveUnknownMember="no member {path} in dimension {dim}, hierarchy {hierarchy}",
    ResolveLagDimNotTime="lag needs a time dimension, {dim} is none",
    ResolvePeriodsToDateLevelNotInTime="no time hierarchy has a level {level}",
    ResolveUnknownNamedSet="no named set {name}",
    ResolveNamedSetCycle="named set {name} contains itself",
    ResolveCrossJoinDimsOverlap="both sides of a cross join have dimension {dim}",
    ResolveUnionDimsMismatch="the sides of a union have dimensions {left_dims} and {right_dims}",
    ResolveDescendantsLevelNotBelow="level {to_level} is not below {set_level}",
    ResolveRangeMembersAtDifferentLevels="a range from level {from_level} to level {to_level}",
    ResolveSetCompositionIllFormed="ill-formed set: {reason}",
)
_kinds(
    EvalError,
    EvalSetCompositionIllFormed="ill-formed set: {reason}",
    EvalRangeInverted="the range is inverted: {start} sorts after {end}",
    EvalFilterFailed="filtering the facts failed: {reason}",
    EvalColumnMissing="the facts have no column {column}",
    EvalAggregateFailed="measure {measure}: {reason}",
    EvalUnresolvedRef="no measure or metric {name}",
    EvalMetricCycle="metric {name} refers to itself",
    EvalTooManyCells="{cells} tuples or cells on the driver, where {most} are allowed",
)
