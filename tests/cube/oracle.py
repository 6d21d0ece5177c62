"""A slow evaluator in plain Python: every cell scans the rows. What the engine must agree with."""

from __future__ import annotations

import math

from gridweave.query import MemberRef, Tuple
from gridweave.results import Cell
from gridweave.schema import At, Binary, Const, Lag, PeriodsToDate, Ref


class Oracle:
    def __init__(self, rows: list[dict], schema, levels):
        self.rows, self.schema, self.levels = rows, schema, levels

    def keys(self, m: MemberRef):
        return [x.key for x in self.schema.dimension(m.dim).hierarchy(m.hierarchy).levels]

    def cell(self, metric: str, at: Tuple) -> Cell:
        measure = self.schema.measure(metric)
        if measure is None:
            return self.value(self.schema.metric(metric).expr, at)
        kept = [r for r in self.rows if all(r[k] == s for m in at.members for k, s in zip(self.keys(m), m.path, strict=False))]
        if not kept:
            return Cell.missing()
        return Cell.valid(math.fsum(r[metric] for r in kept if r[metric] is not None))

    def value(self, e, at: Tuple) -> Cell:
        if isinstance(e, Ref):
            return self.cell(e.name, at)
        if isinstance(e, Const):
            return Cell.valid(e.value)
        if isinstance(e, Binary):
            l, r = self.value(e.l, at), self.value(e.r, at)  # noqa: E741
            for c in (l, r):
                if c.state == "error":
                    return c
            for c in (l, r):
                if c.state == "missing":
                    return c
            if e.bin_op == "div" and r.value == 0:
                return Cell.error("divide by zero")
            return Cell.valid({"add": l.value + r.value, "sub": l.value - r.value, "mul": l.value * r.value, "div": l.value / (r.value or 1)}[e.bin_op])
        if isinstance(e, At):
            return self.value(e.of, Tuple((*(m for m in at.members if not e.at.member(m.dim)), *e.at.members)))
        own = at.member("Time")
        if own is None:
            return Cell.missing("not_applicable")
        level = self.levels[len(own.path)]
        i = level.index(own.path)
        move = lambda p: Tuple(tuple(MemberRef(m.dim, m.hierarchy, p) if m is own else m for m in at.members))
        if isinstance(e, Lag):
            return self.value(e.of, move(level[i - e.n])) if 0 <= i - e.n < len(level) else Cell.missing()
        assert isinstance(e, PeriodsToDate) and e.level == "Year"
        total = 0.0
        for p in level[: i + 1]:
            if p[0] == own.path[0]:
                c = self.value(e.of, move(p))
                if c.state == "error":
                    return c
                total += c.value or 0.0
        return Cell.valid(total)
