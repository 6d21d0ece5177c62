"""Near-duplicate vectors by sorted projection passes and bucket passes.

A few passes first hash a vector to 64 sign bits of random projections and sort the vectors of a label by the
concatenated bits. In sorted order each is compared with its next WINDOW neighbours, in double precision, and
pairs that reach the threshold are united. That only gathers groups of near copies cheaply.

Bucket passes then find the links between what is still apart. Vectors of a label that share the first k sign
bits are a bucket, and all of a bucket's rows that aren't united yet are compared, whatever its size. A pair
at the threshold shares a sign bit with probability 1 - acos(cosine)/pi and hence a bucket with the k-th power
of that, however crowded its label is; the number of passes is set so that it is missed by all with probability
MISS at most. How crowded a label is affects only the cost: k is chosen per label, from measured shares of
row pairs that k bits leave together. At k = 0 (labels of some thousand rows) one pass compares all.

What is left open inside a group of near copies is then settled exactly: a component's
members within half the threshold angle of its centre are certain to link with each other and are only
counted; all others are compared with every member of their component, block by block. So link counts
within a component are exact whatever its size, and no pairs are written.

Defined results: only vectors of equal, non-null labels and equal length are compared; null or zero
vectors, and those with a null or non-finite component, link with nothing; equal vectors link like any
others; rows that repeat a vec_id count as vectors of their own, and share an output id; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .runtime import discard, prepare, settle, unit_hash

WINDOW, MISS, BITS = 32, 0.002, 64
#: Rows of a component that are compared at a time; components are held by no task as a whole.
BLOCK = 512
#: Sorted passes, and bucket passes that are shuffled together.
SCANS, TOGETHER = 2, 2
#: Rows of a bucket that one task compares; larger buckets are dealt into such blocks.
BUCKET = 8192
#: What one row costs in a bucket pass, in comparisons; longest bucket prefix.
ROW_COST, PREFIX = 2000, 40
#: Rows of a label from which the choice of k is estimated; it affects cost alone.
PROBE = 2000


def passes_for(bits: int, cosine: float) -> int:
    """Bucket passes of `bits` sign bits after which a pair at the threshold was together in none with probability MISS at most."""
    same = (1 - math.acos(min(1.0, max(-1.0, cosine))) / math.pi) ** bits
    return 1 if same >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-same))


def planes_of(size: int, dimension: int, number: int) -> np.ndarray:
    return np.random.default_rng([20_011, size, number]).standard_normal((dimension, BITS))


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length, stored as bytes of their own float type, as unit rows in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _sign_bits(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    return np.packbits(x @ planes > 0, axis=1).view(">u8").astype(np.uint64).ravel()


def _keys(planes: int, kind: str):
    """(row, label, unit vector) -> one row per pass: label, size, pass, key, row, vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            raw = batch.column(2).to_pylist()
            for d in sorted({len(v) for v in raw}):
                at = np.flatnonzero(np.array([len(v) == d for v in raw]))
                x = unit_rows([raw[i] for i in at], kind)
                own = batch.take(pa.array(at))
                for p in range(planes):
                    if (d, p) not in drawn:
                        drawn[d, p] = planes_of(d, x.shape[1], p)
                    key = (_sign_bits(x, drawn[d, p]) ^ np.uint64(1 << 63)).view(np.int64)  # signed order is the order of the bits
                    n = len(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, p, np.int32)), own.column(1), pa.array(np.full(n, d, np.int32)), pa.array(key), own.column(0), own.column(2)],
                        names=["pass", "label", "size", "key", "row", "vec"],
                    )

    return run


def _forest(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: what unites the same rows with fewer edges."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    out = []
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        x, y = find(i), find(j)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((int(rows[i]), int(rows[j])))
    return out


def _close(x: np.ndarray, group: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions at most WINDOW apart, of one group, whose cosine reaches the threshold."""
    found = []
    for step in range(1, min(WINDOW, len(x) - 1) + 1):
        dot = np.einsum("ij,ij->i", x[:-step], x[step:])
        i = np.flatnonzero((dot >= cosine) & (group[:-step] == group[step:]))
        found.append(np.stack((i, i + step)))
    both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return both[0], both[1]


_SCANNED = "a long, b long, edge long, side int, ord int, pass int, label long, size int, vec binary"


def _scan(cosine: float, kind: str):
    """A sorted partition -> links (edge null), and its first and last WINDOW rows for the neighbouring partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        carry: pa.Table | None = None
        links: list[tuple[int, int]] = []
        head, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            head = t if head is None else (pa.concat_tables([head, t]) if head.num_rows < WINDOW else head)
            total += batch.num_rows
            t = pa.concat_tables([carry, t]) if carry is not None else t
            rows = t["row"].to_numpy()
            group = np.stack([t[c].to_numpy() for c in ("pass", "label", "size")], axis=1)
            change = np.concatenate(([True], (group[1:] != group[:-1]).any(axis=1)))
            start = np.flatnonzero(change)
            for s, e in zip(start, np.append(start[1:], len(rows)), strict=True):
                x = unit_rows(t["vec"].slice(s, e - s).to_pylist(), kind)
                i, j = _close(x, np.zeros(len(x)), cosine)
                links += _forest(rows[s:e], i, j)
            carry = t.slice(max(0, t.num_rows - WINDOW))
        n = len(links)
        cols = list(zip(*links, strict=True)) if n else [(), ()]
        none = lambda k: pa.nulls(n, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.int32()), none(pa.binary())],
            names=_NAMES,
        )
        # the border rows: this partition's head meets the tail of the one before, its tail the next one's head
        for part, edge, side in ((None if head is None else head.slice(0, WINDOW), me - 1, 1), (carry, me, 0)):
            if part is not None and part.num_rows:
                m = part.num_rows
                for b in (
                    pa.Table.from_arrays(
                        [part["row"], pa.nulls(m, pa.int64()), pa.array(np.full(m, edge), pa.int64()), pa.array(np.full(m, side), pa.int32()), pa.array(np.arange(m), pa.int32()), part["pass"], part["label"], part["size"], part["vec"]],
                        names=_NAMES,
                    )
                    .combine_chunks()
                    .to_batches()
                ):
                    yield b

    return run


_NAMES = [x.split()[0] for x in _SCANNED.split(", ")]


def _border(cosine: float, kind: str):
    """Tail of one partition and head of the next, at most 2 * WINDOW rows -> links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["side", "ord"])
        out: list[tuple[int, int]] = []
        for _, own in rows.groupby(["pass", "label", "size"], sort=False):
            x = unit_rows(list(own["vec"]), kind)
            i, j = _close(x, np.zeros(len(x)), cosine)
            out += _forest(own["a"].to_numpy(), i, j)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _blocks(cosine: float, kind: str):
    """Two blocks of one component -> how many members of either are linked with each row of the first."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["role"] == 0], rows[rows["role"] == 1]
        if not len(left) or not len(right):
            return pd.DataFrame({"row": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64")})
        x, y = unit_rows(list(left["vec"]), kind), unit_rows(list(right["vec"]), kind)
        hit = (x @ y.T >= cosine) & (left["row"].to_numpy()[:, None] != right["row"].to_numpy()[None, :])
        # rows of the core learn here of their links with the rows outside it
        core = right["core"].to_numpy()
        return pd.DataFrame(
            {
                "row": np.concatenate((left["row"].to_numpy(), right["row"].to_numpy()[core])),
                "links": np.concatenate((hit.sum(axis=1), hit.sum(axis=0)[core])).astype("int64"),
            }
        )

    return run


def bits_for(keys: np.ndarray, group: np.ndarray, rows: int, cosine: float, row_cost: float, bucket: int) -> int:
    """The cheapest k for `rows` rows, by sampled keys and the groups that are united already."""
    n = len(keys)
    apart = np.zeros(PREFIX + 1)
    for k in range(PREFIX + 1):
        prefix = keys >> np.uint64(64 - k) if k else np.zeros(n, np.uint64)
        together = np.unique(prefix, return_counts=True)[1].astype(float)
        united = np.unique(np.stack((prefix.view(np.int64), group)), axis=1, return_counts=True)[1].astype(float)
        apart[k] = ((together**2).sum() - (united**2).sum()) / max(1.0, n * (n - 1.0))
    met = rows * apart
    # rows of a bucket beyond a block are shuffled once for each block of it
    cost = [passes_for(k, cosine) * (row_cost * max(1.0, 2 * met[k] / bucket) + met[k]) for k in range(PREFIX + 1)]
    return int(np.argmin(cost))


def _choose(cosine: float, kind: str, row_cost: float, bucket: int):
    """Sampled rows of one label and size -> its k and number of bucket passes."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(list(rows["vec"]), kind)
        size = int(rows["size"].iloc[0])
        k = bits_for(_sign_bits(x, planes_of(size, x.shape[1], SCANS)), rows["comp"].to_numpy(), int(rows["n"].iloc[0]), cosine, row_cost, bucket)
        return pd.DataFrame({"label": [rows["label"].iloc[0]], "size": [size], "k": [k], "passes": [passes_for(k, cosine)]})

    return run


_BUCKETED = "pass int, label long, size int, bucket long, row long, comp long, vec binary"


def _buckets(first: int, end: int, kind: str):
    """(label, size, row, comp, k, passes, vector) -> one row for each of the passes first to end - 1 that its label has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            size, k, passes = (batch.column(i).to_numpy() for i in (1, 4, 5))
            for d in np.unique(size).tolist():
                for p in range(first, end):
                    at = np.flatnonzero((size == d) & (passes > p))
                    if not len(at):
                        continue
                    own = batch.take(pa.array(at))
                    x = unit_rows(own.column(6).to_pylist(), kind)
                    if (d, p) not in drawn:
                        drawn[d, p] = planes_of(d, x.shape[1], SCANS + p)
                    kept = k[at].astype(np.uint64)
                    bits = _sign_bits(x, drawn[d, p])
                    bucket = np.where(kept > 0, bits >> (np.uint64(64) - np.maximum(kept, np.uint64(1))), np.uint64(0)).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), p, np.int32)), own.column(0), own.column(1), pa.array(bucket), own.column(2), own.column(3), own.column(6)],
                        names=["pass", "label", "size", "bucket", "row", "comp", "vec"],
                    )

    return run


def _unite(cosine: float, kind: str):
    """A bucket, or two blocks of a large one (role 0 meets role 1) -> links between components that are still apart."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, own = np.unique(rows["comp"].to_numpy(), return_inverse=True)
        out: list[tuple[int, int]] = []
        if len(names) > 1:
            role = rows["role"].to_numpy()
            x = unit_rows(list(rows["vec"]), kind)
            right = np.flatnonzero(role > 0)
            left = np.flatnonzero(role == 0) if (role == 0).any() else right
            whole = left is right
            root = np.arange(len(names))
            for at in range(0, len(left), BLOCK):
                mine = left[at : at + BLOCK]
                others = right[at:] if whole else right
                a, b = root[own[mine]], root[own[others]]
                i, j = np.nonzero((x[mine] @ x[others].T >= cosine) & (a[:, None] != b[None, :]))
                for u, v in np.unique(np.stack((a[i], b[j])), axis=1).T.tolist():
                    u, v = int(root[u]), int(root[v])
                    if u != v:
                        root[root == max(u, v)] = min(u, v)
                        out.append((int(names[u]), int(names[v])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return run


def _pass_links(united: DataFrame, first: int, end: int, cosine: float, kind: str) -> DataFrame:
    """Links (a, b) between components that bucket passes first to end - 1 find."""
    keyed = united.where(F.col("passes") > first).select("label", "size", "row", "comp", "k", "passes", "vec").mapInArrow(_buckets(first, end, kind), _BUCKETED)
    key = ["pass", "label", "size", "bucket"]
    counts = keyed.groupBy(*key, "comp").agg(F.count(F.lit(1)).alias("m")).groupBy(*key)
    counts = counts.agg(F.sum("m").alias("n_all"), F.max(F.struct("m", "comp")).alias("most")).where(F.col("n_all") > BUCKET)
    blocks = lambda n: F.ceil(n / BUCKET).cast("int")
    large = counts.select(*key, blocks(F.col("n_all")).alias("n_all"), blocks(F.col("n_all") - F.col("most.m")).alias("n_out"), F.col("most.comp").alias("major"))
    # at most one row for BUCKET rows of a pass; in a large bucket, rows outside its largest component meet all rows
    keyed = keyed.join(F.broadcast(large), key, "left")
    deal = lambda n: F.pmod(F.xxhash64("row"), F.greatest(F.col(n), F.lit(1))).cast("int")
    cell = lambda i, j, role: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(role).alias("role"))
    span = lambda n: F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)
    right = F.when(F.col("n_out") > 0, F.transform(span("n_out"), lambda i: cell(i, deal("n_all"), 1)))
    left = F.when(F.col("comp") != F.col("major"), F.transform(span("n_all"), lambda j: cell(deal("n_out"), j, 0)))
    empty = F.array().cast("array<struct<i:int,j:int,role:int>>")
    cells = F.when(F.col("n_all").isNull(), F.array(cell(F.lit(0), F.lit(0), 1))).otherwise(F.concat(F.coalesce(left, empty), F.coalesce(right, empty)))
    dealt = keyed.select(*key, "comp", "vec", F.explode(cells).alias("cell")).select(*key, "comp", "vec", "cell.*")
    return dealt.groupBy(*key, "i", "j").applyInPandas(_unite(cosine, kind), "a long, b long")


def near_vectors(vectors: DataFrame, cosine: float = 0.93) -> DataFrame:
    """One row per row of vectors (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    spark = prepare(vectors.sparkSession)
    doubles = F.col("embedding").cast("array<double>")
    sane = F.coalesce(F.forall(doubles, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    base = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.when(sane, doubles).alias("x"),
    )
    single = dict(vectors.dtypes)["embedding"] == "array<float>"
    kind = "<f4" if single else "<f8"
    base = base.mapInArrow(_bytes(kind), "row long, vec_id long, label long, vec binary")
    base = settle(base, "vectors")
    usable = base.where(F.col("vec").isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    count = usable.count()
    if not count:
        return base.select("vec_id", F.expr("0L").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    keyed = usable.select("row", "label", "vec").mapInArrow(_keys(SCANS, kind), "pass int, label long, size int, key long, row long, vec binary")
    order = ["pass", "label", "size", "key", "row"]
    scanned = settle(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan(cosine, kind), _SCANNED), "scanned")
    edges = scanned.where(F.col("edge").isNull()).select("a", "b")
    borders = scanned.where(F.col("edge") >= 0).groupBy("edge").applyInPandas(_border(cosine, kind), "a long, b long")
    label = settle(components(edges.unionByName(borders)), "gathered")
    discard(scanned)

    known = usable.join(label.withColumnRenamed("node", "row"), "row", "left").select("row", "label", F.length("vec").alias("size"), F.coalesce("component", "row").alias("comp"), "vec")
    known = settle(known, "known")
    groups = known.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n"))
    probed = known.join(groups, ["label", "size"]).where(unit_hash(F.col("row"), seed=8) * F.col("n") < PROBE)
    chosen = probed.groupBy("label", "size").applyInPandas(_choose(cosine, kind, ROW_COST, BUCKET), "label long, size int, k int, passes int")
    # a label of which no row was drawn: one pass over all its rows
    chosen = settle(groups.select("label", "size").join(chosen, ["label", "size"], "left").na.fill({"k": 0, "passes": 1}), "chosen")
    united = known.join(chosen, ["label", "size"])
    edges = label.select(F.col("node").alias("a"), F.col("component").alias("b"))
    last = chosen.agg(F.max("passes")).first()[0]
    for first in range(0, last, TOGETHER):
        edges = edges.unionByName(settle(_pass_links(united, first, min(last, first + TOGETHER), cosine, kind), "links"))
        spark.sparkContext._jvm.System.gc()  # the passes' shuffle files go with their plans
    discard(known)
    label = components(edges)

    members = settle(usable.join(label.withColumnRenamed("node", "row"), "row"), "members")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("component_id"))
    # its smallest row is the centre; one row of each component meets all others by equi-join
    centre = members.where(F.col("row") == F.col("component")).select("component", F.col("vec").alias("centre"))
    placed = members.join(settle(sizes.join(centre, "component"), "centres"), "component")
    half = math.cos(math.acos(cosine) / 2) + 1e-9
    placed = settle(placed.mapInArrow(_core(half, kind), "row long, component long, size long, component_id long, core boolean, vec binary"), "placed")
    cores = placed.groupBy("component").agg(F.sum(F.col("core").cast("long")).alias("n_core"), F.sum((~F.col("core")).cast("long")).alias("n_rest"))
    loose = cores.where(F.col("n_rest") > 0)
    # blocks of about BLOCK rows, dealt by hash; each block of rows outside the core meets every block of its component
    blocked = placed.join(loose, "component").select(
        "component", "row", "core", "vec", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_all"), F.ceil(F.col("n_rest") / BLOCK).cast("int").alias("n_out"),
    )
    deal = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    left = blocked.where(~F.col("core")).select("component", deal("n_out").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"), "row", "core", "vec", F.lit(0).alias("role"))
    right = blocked.select("component", F.explode(F.sequence(F.lit(0), F.col("n_out") - 1)).alias("i"), deal("n_all").alias("j"), "row", "core", "vec", F.lit(1).alias("role"))
    counted = left.unionByName(right).groupBy("component", "i", "j").applyInPandas(_blocks(cosine, kind), "row long, links long")
    counted = counted.groupBy("row").agg(F.sum("links").alias("links"))
    per_row = placed.select("row", "component", "component_id", "core").join(cores, "component").join(counted, "row", "left")
    links = F.when(F.col("core"), F.col("n_core") - 1).otherwise(F.lit(0)) + F.coalesce("links", F.lit(0))
    per_row = per_row.select("row", "component_id", links.cast("long").alias("n_links"))
    out = base.select("row", "vec_id").join(per_row, "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )


def _bytes(kind: str):
    """Vectors as bytes of their own float type; null where all is zero or nothing is there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(3).to_pylist():
                x = np.array(v if v is not None else [], kind)
                out.append(x.tobytes() if x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], names=["row", "vec_id", "label", "vec"])

    return run


def _core(half: float, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            pairs = zip(t["vec"].to_pylist(), t["centre"].to_pylist(), strict=True)
            core = [float(np.prod(unit_rows([v, c], kind), axis=0).sum()) >= half for v, c in pairs]
            yield pa.RecordBatch.from_arrays(
                [t["row"], t["component"], t["size"], t["component_id"], pa.array(core, pa.bool_()), t["vec"]],
                names=["row", "component", "size", "component_id", "core", "vec"],
            )

    return run
