"""Arithmetic on cells: errors before missing values, left before right; results carry no unit or format."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable

from ..results import Cell

_OPERATORS = {"add": operator.add, "sub": operator.sub, "mul": operator.mul}


def constant(value: float) -> Cell:
    return Cell.valid(value) if math.isfinite(value) else Cell.error("non-finite constant")


def binary(op: str, left: Cell, right: Cell) -> Cell:
    for state in ("error", "missing"):
        for side in (left, right):
            if side.state == state:
                return side
    if op == "div":
        if right.value == 0:
            return Cell.error("divide by zero")
        value = left.value / right.value
    else:
        try:
            value = _OPERATORS[op](left.value, right.value)
        except OverflowError:
            value = math.inf
    return Cell.valid(value) if math.isfinite(value) else Cell.error("non-finite binary result")


def running_total(cells: Iterable[Cell]) -> Cell:
    """The sum of the valid cells, 0 if there are none; the first error ends it."""
    total, unit, fmt = 0.0, None, None
    for cell in cells:
        if cell.state == "error":
            return cell
        if cell.state == "valid":
            total += cell.value
            unit, fmt = unit or cell.unit, fmt or cell.format
    return Cell.valid(total, unit, fmt) if math.isfinite(total) else Cell.error("non-finite periods-to-date result")


def stamped(cell: Cell, unit: str | None, fmt: str | None) -> Cell:
    """A valid cell with the unit and format it lacks."""
    if cell.state != "valid":
        return cell
    return Cell.valid(cell.value, cell.unit or unit, cell.format or fmt)
