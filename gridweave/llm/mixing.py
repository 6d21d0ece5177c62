"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

A document's rate is how often the mix takes it. Of all rates within [0, 2] that meet each source's
target of words, the ones nearest to 1 in relative entropy are min(2, exp(l * size / m)), l being the
source's dual variable and m its mean size; the duals maximise a concave function, solved by Newton
steps, bracketed by bisection, over each source's histogram of sizes. Rates become 0, 1 or 2 whole
copies: a document gives one copy more than its rate's whole part where (hash of the id - fraction) is
below a cut, one for each source and class of sizes, which falls near 0 and makes the words add up.

Targets: sources in code-point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share `share` of all
words; no target exceeds twice its source's words, the excess being shared by weight among the others.

Defined results: null or word-less text has size 0 and is taken never; a null source is a source of its
own; rows of one doc_id in one source share their draw; an empty table gives an empty one; extra columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import columns_of, discard, settle, unit_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Newton steps end when every source is this near to its target, relatively, or after STEPS.
TOLERANCE, STEPS = 1e-4, 40
BRACKET = 1e6
#: Documents are rounded by classes of size, target / 2**c; a cut falls between so many equal parts of (-1, 1).
CLASSES, PARTS = 16, 4096
#: Up to so many sources their table is broadcast (under 100 bytes each); beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


def size_of(text):
    """The number of words: runs of bytes other than ASCII white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(per_source: DataFrame, share: float = SHARE) -> DataFrame:
    """source, words -> source, source_size, target: water-filling under the cap of twice the words."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    every = Window.partitionBy()
    rows = per_source.select("source", F.col("words").alias("source_size"), weight.alias("w")).withColumn("cap", MOST * F.col("source_size"))
    # fill by the level cap / weight at which a source is full: those before the last level are full
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing))
    level = (share * F.sum("source_size").over(every) - before) / rest
    rows = rows.withColumn("level", level)
    # the true level is the highest that doesn't overfill its own source
    final = F.max(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))).over(every)
    return rows.select("source", "source_size", F.least("cap", F.coalesce(final, F.lit(float("inf"))) * F.col("w")).alias("target"))


def _full():
    """A target at the cap: every rate is MOST, and the dual has no finite value."""
    return F.col("target") >= MOST * F.col("source_size") * (1 - 1e-9)


def _with(rows: DataFrame, state: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """rows joined with the one row per source of state; null is a source."""
    named = state.withColumnRenamed("source", "state_source")
    return rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("state_source")), how).drop("state_source")


def solve(hist: DataFrame, goal: DataFrame, few: bool) -> DataFrame:
    """source, target, source_size, mean and the dual variable of each source. hist: source, size, n."""
    mean = hist.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    state = _with(goal, mean, few, "left").select(
        "source", "source_size", "target", F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(1e-9)).alias("mean"),
        F.lit(0.0).alias("dual"), F.lit(-BRACKET).alias("lo"), F.lit(BRACKET).alias("hi"), _full().alias("done"),
    )
    state = settle(state, "duals")
    for _ in range(STEPS):
        x = F.col("size") / F.col("mean")
        free = F.col("dual") * x < math.log(MOST)
        rate = F.when(free, F.exp(F.col("dual") * x)).otherwise(F.lit(MOST))
        at = (
            _with(hist, state, few)
            .where(F.col("size") > 0)
            .groupBy("source")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.when(free, F.col("n") * F.col("size") * x * rate).otherwise(0.0)).alias("slope"))
        )
        joined = _with(state, at, few, "left")
        got, slope = F.coalesce("got", F.lit(0.0)), F.coalesce("slope", F.lit(0.0))
        gap = F.col("target") - got
        lo, hi = F.when(gap > 0, F.col("dual")).otherwise(F.col("lo")), F.when(gap < 0, F.col("dual")).otherwise(F.col("hi"))
        newton = F.when(slope > 0, F.col("dual") + gap / F.when(slope > 0, slope).otherwise(1.0))
        inside = (newton > lo) & (newton < hi)
        done = F.col("done") | (F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0)))
        new = settle(
            joined.select(
                "source", "source_size", "target", "mean",
                F.when(done, F.col("dual")).when(F.coalesce(inside, F.lit(False)), newton).otherwise((lo + hi) / 2).alias("dual"),
                lo.alias("lo"), hi.alias("hi"), done.alias("done"),
            ),
            "duals",
        )
        discard(state)
        state = new
        if state.where(~F.col("done")).isEmpty():
            break
    return state


def _cuts(rated: DataFrame) -> DataFrame:
    """source -> cuts: per size class the first part whose documents get no further copy.

    Walks a source's sums from its largest documents to its smallest; within a class the documents
    likeliest to be taken come first. A part is taken while that brings the words so far nearer to what
    the rates ask of this class and all larger ones, so each class makes up for the rounding of those
    before it. Sums are gathered by class first, at most PARTS to a row, so that a hot source is spread;
    its at most CLASSES rows meet only for the walk.
    """
    open_ = rated.where(F.col("rate") > F.col("base"))
    sums = open_.groupBy("source", "class", "part").agg(F.sum("size").alias("words"), F.sum((F.col("rate") - F.col("base")) * F.col("size")).alias("due"))
    by_class = sums.groupBy("source", "class").agg(F.sum("due").alias("due"), F.sort_array(F.collect_list(F.struct("part", "words"))).alias("parts"))
    walk = by_class.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("class", "due", "parts"))).alias("classes"))
    start = F.struct(F.lit(0.0).alias("taken"), F.lit(0.0).alias("goal"), F.array().cast("array<struct<class:int,part:int>>").alias("cuts"))

    def fill(goal):
        def step(acc, p):
            take = acc["part"].isNull() & (acc["taken"] + p["words"] / 2 <= goal)
            taken = acc["taken"] + F.when(take, p["words"].cast("double")).otherwise(F.lit(0.0))
            return F.struct(taken.alias("taken"), F.coalesce(acc["part"], F.when(~take, p["part"])).alias("part"))

        return step

    def walked(acc, c):
        goal = acc["goal"] + c["due"]
        end = F.aggregate(c["parts"], F.struct(acc["taken"].alias("taken"), F.lit(None).cast("int").alias("part")), fill(goal))
        cut = F.struct(c["class"].alias("class"), end["part"].alias("part"))
        cuts = F.when(end["part"].isNull(), acc["cuts"]).otherwise(F.array_append(acc["cuts"], cut))
        return F.struct(end["taken"].alias("taken"), goal.alias("goal"), cuts.alias("cuts"))

    return walk.select("source", F.map_from_entries(F.aggregate("classes", start, walked)["cuts"]).alias("cuts"))


def _rated(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target, rate, base, class and part."""
    out = _with(rows, plan, few)
    x = F.col("dual") * F.col("size") / F.col("mean")
    rate = F.when(_full(), F.lit(MOST)).otherwise(F.least(F.lit(MOST), F.exp(F.least(x, F.lit(2.0)))))
    out = out.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(F.lit(0.0))).withColumn("base", F.floor("rate"))
    v = unit_hash("doc_id", "source", seed=3) - (F.col("rate") - F.col("base"))
    rank = F.floor(F.log2(F.greatest(F.col("target"), F.lit(1.0)) / F.greatest("size", F.lit(1))))
    return out.withColumn("part", F.floor((v + 1) * (PARTS / 2)).cast("int")).withColumn(
        "class", F.least(F.greatest(rank, F.lit(0)), F.lit(CLASSES - 1)).cast("int")
    )


def plan_mix(narrow: DataFrame, share: float = SHARE) -> tuple[DataFrame, bool]:
    """One row per source with all that its documents' copies depend on, and whether it may be broadcast."""
    hist = settle(narrow.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "histogram")
    per_source = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("words"))
    goal = settle(targets(per_source, share), "targets")
    few = goal.count() <= BROADCAST_SOURCES
    plan = solve(hist, goal, few).select("source", "source_size", "target", "mean", "dual")
    cuts = _cuts(_rated(narrow, plan, few))
    return settle(_with(plan, cuts, few, "left"), "mix"), few


def take(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows (doc_id, source, size, ...) with source_size, target, rate, copies and taken; no row is moved where the plan is broadcast."""
    out = _rated(rows, plan, few)
    cut = F.coalesce(F.try_element_at("cuts", F.col("class")), F.lit(PARTS))
    more = F.when((F.col("rate") > F.col("base")) & (cut > F.col("part")), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("base") + more).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.drop("base", "part", "class", "mean", "dual", "cuts")


def mix(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken (= copies * size), copies, rate."""
    narrow = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size")), "sizes")
    plan, few = plan_mix(narrow, share)
    return take(narrow, plan, few).select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "rate")


def mixed(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    narrow = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size")), "sizes")
    plan, few = plan_mix(narrow, share)
    names = [F.col("row").getField(c).alias(c) for c in docs.columns]
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), size_of(F.col("text")).alias("size"), F.struct(*columns_of(docs)).alias("row"))
    chosen = take(rows, plan, few).where(F.col("copies") > 0)
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names)
