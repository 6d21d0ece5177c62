"""Laws of the set and metric algebras, and agreement with the plain evaluator on random queries."""

import random

import pytest

from gridweave.engine import SparkCube
from gridweave.operators.sets import tuples_of
from gridweave.plans.resolve import Resolver
from gridweave.query import Axes, Explicit, MemberRef, Members, Predicate, Query, Tuple
from gridweave.schema import At, Const, Lag, Metric, PeriodsToDate, Ref, Schema

from .fixtures import COLUMNS, ROWS, facts, place, plan, schema
from .oracle import Oracle

COUNTRIES, REGIONS, MONTHS, YEARS, PLANS = (
    Members(*x) for x in (("Geography", "Default", "Country"), ("Geography", "Default", "Region"), ("Time", "Fiscal", "Month"), ("Time", "Fiscal", "Year"), ("Scenario", "Default", "Plan"))
)
SETS = [REGIONS, COUNTRIES, Explicit((place("South"), place("North"))), Explicit((place("North", "US"),)), REGIONS.descendants_to("Country"), place("North").children()]
EXPRS = {
    "E0": Ref("amount"), "E1": Ref("amount") / Ref("units"), "E2": Lag(Ref("amount"), "Time", 1), "E3": PeriodsToDate(Ref("amount"), "Year"), "E4": Const(3.0),
    "E5": Lag(PeriodsToDate(Ref("amount"), "Year"), "Time", -1) - Ref("units"), "E6": At(Ref("amount"), Tuple.of(plan("Plan"))) * Ref("amount"), "E7": PeriodsToDate(Lag(Ref("amount"), "Time", 2) + Ref("amount"), "Year"),
}


@pytest.fixture(scope="module")
def cube(spark):
    own = schema()
    return SparkCube(facts(spark), Schema(own.dimensions, own.measures, (*own.metrics, *(Metric(n, e) for n, e in EXPRS.items())), own.named_sets))


def run(cube, s):
    return tuples_of(Resolver(cube.schema(), cube.catalogue).set(s)[0], cube.evaluator)


@pytest.mark.parametrize("seed", range(8))
def test_set_laws(cube, seed):
    rng = random.Random(seed)
    a, b, c = (rng.choice(SETS) for _ in range(3))
    flip = lambda ts: {tuple(sorted(t.members, key=str)) for t in ts}
    assert set(run(cube, a.union(b))) == set(run(cube, b.union(a)))
    assert run(cube, a.union(b).union(c)) == run(cube, a.union(b.union(c)))
    assert run(cube, a.union(a)) == run(cube, a)
    assert flip(run(cube, a.cross(MONTHS))) == flip(run(cube, MONTHS.cross(a)))
    assert run(cube, a.cross(MONTHS).cross(PLANS)) == run(cube, a.cross(MONTHS.cross(PLANS)))
    p = Predicate.is_in("Geography", "North")
    assert run(cube, a.filter(p).filter(p)) == run(cube, a.filter(p))
    assert run(cube, a.cross(MONTHS).filter(p)) == run(cube, a.filter(p).cross(MONTHS))
    assert run(cube, a.top(3, "amount").top(2, "amount")) == run(cube, a.top(2, "amount"))
    x, y = Explicit((place("North"),)), Explicit((place("South"),))
    assert run(cube, x.union(y).descendants_to("Country")) == run(cube, x.descendants_to("Country").union(y.descendants_to("Country")))
    assert run(cube, REGIONS.children()) == run(cube, REGIONS.descendants_to("Country"))


def test_random_formulas_agree(cube):
    names = COLUMNS.replace(" string", "").replace(" double", "").split(", ")
    rows = [dict(zip(names, r, strict=True)) for r in ROWS]
    tree = cube.catalogue.tree("Time", "Fiscal")
    oracle = Oracle(rows, cube.schema(), {d + 1: level for d, level in enumerate(tree.levels)})
    rng = random.Random(5)
    asked = []
    for _ in range(200):
        members = []
        for dim, hierarchy in (("Geography", "Default"), ("Time", "Fiscal"), ("Scenario", "Default")):
            if rng.random() < 0.7:
                members.append(MemberRef(dim, hierarchy, rng.choice(list(cube.catalogue.tree(dim, hierarchy).position))))
        rng.shuffle(members)
        asked.append((rng.choice(list(EXPRS)), Tuple(tuple(members))))
    for (metric, at), got in zip(asked, cube.evaluator.cells(asked), strict=True):
        want = oracle.cell(metric, at)
        assert (got.state, got.reason) == (want.state, want.reason), (metric, str(at))
        assert got.value == pytest.approx(want.value, rel=1e-9) if got.state == "valid" else True, (metric, str(at))


def test_metric_laws(cube):
    extra = {
        "AB": Ref("amount") + Ref("units"), "BA": Ref("units") + Ref("amount"), "One": Ref("amount") * Const(1.0), "Nil": Ref("amount") + Const(0.0),
        "L11": Lag(Lag(Ref("amount"), "Time", 1), "Time", 1), "L2": Lag(Ref("amount"), "Time", 2), "L0": Lag(Ref("amount"), "Time", 0),
    }
    own = cube.schema()
    more = SparkCube(cube.facts, Schema(own.dimensions, own.measures, (*own.metrics, *(Metric(n, e) for n, e in extra.items()))))
    r = more.query(Query(Axes.series(MONTHS), Tuple(), (*extra, "amount")))
    cells = {row.label: [(c.state, c.value) for c in row.values] for row in r.rows}
    assert cells["AB"] == cells["BA"]
    assert cells["One"] == cells["Nil"] == cells["L0"] == cells["amount"]
    assert cells["L11"] == cells["L2"]
    assert cells["L2"][:2] == [("missing", None)] * 2
