"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, settle


def _state(edges: DataFrame) -> tuple:
    # edges are distinct, so that no two cancel out
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, component) for every node of an edge, component being its smallest reachable id.

    Every round is groupBy-min (combined before the shuffle) plus an equi-join that AQE can split, so a
    node with very many neighbours is no bottleneck. Each round's edges are written to the shared folder.
    Loops and null ends are dropped; an empty table gives an empty one.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    cur = settle(
        edges.where(x.isNotNull() & y.isNotNull() & (x != y))
        .select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        .distinct(),
        "edges",
    )
    seen = _state(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = large.join(least, "a")
        small = (
            tied.where(F.col("b") != F.col("m"))
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        nxt = settle(small, "edges")
        now = _state(nxt)
        discard(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    roots = cur.select(F.col("b").alias("node")).distinct()
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
