"""Near-duplicate documents by min-max hashing.

Every permutation is evaluated once per shingle and gives two signature values, its minimum and its
maximum. Bands of values are the keys of candidate buckets. Texts of equal shingle sets are one class, and
a bucket's classes are tied to the bucket's first (a star, never all pairs); each tie is confirmed on the
full sets before it counts.

Classes that share a bucket but not a component after that are compared across components by an exact
prefix-filter join: sets at the threshold share at least one of their rarest shingles (of a set of n, the
n - ceil(0.8 n) + 1 rarest), so only those are joined, not the buckets. A passage that very many texts
share is not among the rarest, and brings no pairs. Rarity is read from a table of hashed counts, whose
size is bounded; any fixed order is exact, rare first saves pairs. The join itself drops pairs whose first
common shingle comes too late in their order, or whose parity sketches differ in more bits than the sets
may in shingles. Large components at a shingle meet others only, never themselves.

Defined results: null or word-less text has no shingles and links with nothing; a text with fewer words
than a shingle is one shingle; documents with equal sets are one class and share a component; a doc_id
that occurs in several rows gets one row for each, judged by its own text; a row without doc_id is
compared like any other, counts for no component's id, and is kept only where its group has no id at all;
extra columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import LOWER, U64, buffers, mix, portions, prefix_hash, span_hash, words
from .graph import components
from .runtime import columns_of, discard, fresh, prepare, release, settle, tidy
from .sieve import Sieve

#: Values per band and number of bands; two values come from each of ROWS * BANDS / 2 permutations.
#: A pair at similarity 0.8 escapes every band with probability (1 - 0.8**6)**32 = 6e-5, at 0.85 with 3e-7.
ROWS, BANDS = 6, 32
PERMUTATIONS = ROWS * BANDS // 2
#: One-bit sketch: pairs at similarity 0.8 differ in 12.8 of 128 bits, standard deviation 3.4.
SKETCH_BITS, SKETCH_MOST = 128, 30
#: Most hashed counts of shingles, 4 bytes each.
COUNTERS = 1 << 22
#: Bits of the parity sketch: two sets' differ in no more bits than the sets differ in shingles.
PARITY = 1024
#: Classes of one component at one shingle from which on they are kept from meeting each other.
LARGE = 64

_KEYS = mix(np.arange(1, PERMUTATIONS + 1, dtype=U64))
_MULT = mix(np.arange(1001, PERMUTATIONS + 1001, dtype=U64)) | U64(1)
_BAND = mix(np.arange(5001, ROWS + 5001, dtype=U64)) | U64(1)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and the n + 1 bounds."""
    data, offsets = buffers(column)
    data = LOWER[data]
    start, end, doc = words(data, offsets)
    n = len(offsets) - 1
    if not len(start):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    h = span_hash(prefix_hash(data), start, end)
    first = np.searchsorted(doc, np.arange(n + 1))
    out, bounds = [], np.zeros(n + 1, np.int64)
    for k in range(n):
        own = h[first[k] : first[k + 1]]
        m = len(own)
        if m:
            width = min(size, m)
            x = own[: m - width + 1].copy()
            for j in range(1, width):
                x = mix(x * U64(0x9DDFEA08EB382D69) + own[j : m - width + 1 + j])
            x = mix(x + U64(width))
            x.sort()
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
        bounds[k + 1] = bounds[k] + (len(out[-1]) if m else 0)
    return (np.concatenate(out) if out else np.zeros(0, U64)), bounds


def signature(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and one-bit sketch of a non-empty shingle set, 4,096 shingles at a time."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, U64)
    high = np.zeros(PERMUTATIONS, U64)
    for at in range(0, len(x), 4096):
        v = (x[None, at : at + 4096] ^ _KEYS[:, None]) * _MULT[:, None]
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    values = np.concatenate((low, high))
    keys = mix((mix(values).reshape(BANDS, ROWS) * _BAND).sum(axis=1, dtype=U64) + np.arange(BANDS, dtype=U64))
    bits = (mix(values[:SKETCH_BITS] + U64(77)) & U64(1)).reshape(-1, 64)
    sketch = (bits << np.arange(64, dtype=U64)).sum(axis=1, dtype=U64)
    return keys.view(np.int64), sketch.view(np.int64)


_SIGNED = "doc_id long, th long, n_shingles long, set_a long, set_b long, bands array<long>, sketch_a long, sketch_b long"


def _identity(x: np.ndarray) -> list[int]:
    """128 bits that name a shingle set."""
    order = mix(x + U64(0x1234567))
    return np.array([order.sum(dtype=U64), np.bitwise_xor.reduce(mix(order ^ U64(99)))], U64).view(np.int64).tolist()


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in (b.slice(low, high - low) for b in batches for low, high in portions(b.column(1))):
            sets, bounds = shingle_sets(batch.column(1), size)
            n = batch.num_rows
            ident, bands, sketch = np.zeros((n, 2), np.int64), [], np.zeros((n, 2), np.int64)
            for k in range(n):
                x = sets[bounds[k] : bounds[k + 1]]
                if not len(x):
                    bands.append(np.zeros(0, np.int64))
                    continue
                ident[k] = _identity(x)
                keys, sketch[k] = signature(x)
                bands.append(keys)
            off = np.concatenate(([0], np.cumsum([len(b) for b in bands]))).astype(np.int32)
            values = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            column = lambda x: pa.array(x.copy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(bounds)), column(ident[:, 0]), column(ident[:, 1]),
                 pa.ListArray.from_arrays(pa.array(off), pa.array(values)).cast(longs), column(sketch[:, 0]), column(sketch[:, 1])],
                names=[x.split()[0] for x in _SIGNED.split(", ")],
            )

    return run


def _sets(size: int, sieve: Sieve | None):
    """(place, text, th, slot) -> place, th and the shingles of each text that the sieve lets through; a row that repeats in a task is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            if sieve is not None:
                batch = batch.filter(pa.array(sieve.hits(batch.column(3).to_numpy())))
            new = []
            for k, own in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if own not in seen:
                    seen.add(own)
                    new.append(k)
            batch = batch.take(pa.array(new, pa.int64()))
            for low, high in portions(batch.column(1)):
                part = batch.slice(low, high - low)
                sets, bounds = shingle_sets(part.column(1), size)
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(sets.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["place", "place_th", "shingles"])

    return run


def _full_sets(asked: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """cls and shingles of the classes asked for (cls, place, place_th), by one more scan of docs (place, text, th)."""
    asked = settle(asked, "asked")
    sieve = Sieve(asked, "place")
    if sieve.bitmap is not None:
        some = docs.select("place", "text", "th", sieve.slot("place").alias("slot"))
    else:
        some = sieve.maybe(docs.select("place", "text", "th"), "place").withColumn("slot", F.lit(0).cast("long"))
    found = some.mapInArrow(tidy(_sets(size, sieve if sieve.bitmap is not None else None)), "place long, place_th long, shingles array<long>")
    out = settle(found.join(asked, ["place", "place_th"]).select("cls", "shingles"), "shingles")
    discard(asked)
    return out


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    one = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    linked = pairs.select("a", "b").join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("sa") + F.size("sb") - both))
    return settle(linked.select("a", "b"), "links")


def _rarest(slots: int, counts, percent: int):
    """(cls, shingles) -> shingle, place in the order, cls for the rarest shingles of a set, of which two sets at the threshold share one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(counts.value, np.int32)
        for batch in batches:
            found, places, owner = ([np.zeros(0, np.int64)] for _ in range(3))
            lists = batch.column(1)
            off = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            for cls, low, high in zip(batch.column(0).to_pylist(), off[:-1], off[1:], strict=True):
                x = values[low:high]
                n = len(x)
                seen = table[x % slots]
                first = np.lexsort((x, seen))[: n - -(-percent * n // 100) + 1]
                shared = np.flatnonzero(seen[first] > 1)  # one that nobody else has makes no pair
                found.append(x[first[shared]])
                places.append(shared)
                owner.append(np.full(len(shared), cls, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (found, places, owner)], names=["shingle", "at", "cls"])

    return run


def _parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, shingles) -> cls, parity: for each of PARITY slots, whether an odd number of shingles falls into it."""
    for batch in batches:
        lists = batch.column(1)
        off, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        rows = np.repeat(np.arange(batch.num_rows), np.diff(off))
        slot = (mix(values[off[0] : off[-1]].view(U64) ^ U64(0xABCDEF)) % U64(PARITY)).astype(np.int64)
        odd = np.bincount(rows * PARITY + slot, minlength=batch.num_rows * PARITY) & 1
        packed = np.packbits(odd.astype(np.uint8)).view(np.int64)
        starts = np.arange(batch.num_rows + 1, dtype=np.int32) * (PARITY // 64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(packed))], names=["cls", "parity"])


def _across(left: DataFrame, sets: DataFrame, side, fits, percent: int) -> DataFrame:
    """Pairs (a, b) of classes of different components (left: cls, c) that share one of their rarest shingles and may reach the threshold."""
    spark = left.sparkSession
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    slots = min(COUNTERS, max(1 << 16, 1 << (total // 8).bit_length()))
    rows = sets.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(slots)).alias("s")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(slots, np.int32)
    counts[rows["s"].to_numpy()] = np.minimum(rows["n"].to_numpy(), np.iinfo(np.int32).max)
    own = sets.select("cls", "shingles")
    rare = own.mapInArrow(tidy(_rarest(slots, spark.sparkContext.broadcast(counts.tobytes()), percent)), "shingle long, at long, cls long")
    rare = settle(rare.join(left, "cls"), "rarest")
    ends = rare.groupBy("shingle").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") != F.col("c1"))
    met = settle(rare.join(settle(ends.select("shingle"), "met"), "shingle", "left_semi"), "meeting")
    discard(rare)
    facts = side("cls").join(own.mapInArrow(tidy(_parity), "cls long, parity array<long>"), "cls")
    facts = facts.select("cls", *(F.col(f"{c}_cls").alias(c) for c in ("n", "sketch_a", "sketch_b")), "parity")
    facts = settle(facts, "facts")
    described = settle(met.join(facts, "cls"), "described")
    discard(met)
    discard(facts)
    met = described
    end = lambda rows, s: rows.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("c", "at", "n", "sketch_a", "sketch_b", "parity")), F.col("cls").alias(s))
    # of the shingles from the first common one on, all may be common
    late = (100 + percent) * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) < percent * (F.col("n_a") + F.col("n_b"))
    odd = F.aggregate(F.zip_with("parity_a", "parity_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    may = fits & ~late & ((100 + percent) * odd <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    sizes = met.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LARGE)
    large = settle(sizes.select("shingle", "c"), "large")
    small, many = met.join(large, ["shingle", "c"], "left_anti"), met.join(large, ["shingle", "c"], "left_semi")
    pairs = end(small, "a").join(end(small, "b"), "shingle").where((F.col("c_a") > F.col("c_b")) & may).select("a", "b")
    if not large.isEmpty():
        pairs = pairs.unionByName(end(many, "a").join(end(small, "b"), "shingle").where(may).select("a", "b"))
        two = large.withColumnRenamed("c", "c_a").join(large.withColumnRenamed("c", "c_b"), "shingle").where(F.col("c_a") > F.col("c_b"))
        pairs = pairs.unionByName(end(many, "a").join(two, ["shingle", "c_a"]).join(end(many, "b"), ["shingle", "c_b"]).where(may).select("a", "b"))
    out = settle(pairs.distinct(), "across")
    discard(met)
    release(spark)
    return out


def _judged(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, th, n_shingles, component_id, kept of each row of docs."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    place = F.coalesce("doc_id", "th")  # where a class's text is found again
    signed = settle(docs.select("doc_id", "text", "th").mapInArrow(tidy(_sign(size)), _SIGNED), "signatures")
    some = signed.where(F.col("n_shingles") > 0)
    # rows of one set have one signature, whichever is taken
    classes = some.groupBy("set_a", "set_b").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct(place.alias("place"), "th")).alias("at"),
        *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch_a", "sketch_b")),
    )
    classes = settle(
        classes.select(
            F.monotonically_increasing_id().alias("cls"), "set_a", "set_b", "rep", "at.place", F.col("at.th").alias("place_th"), F.col("n_shingles").alias("n"), "bands", "sketch_a", "sketch_b"
        ),
        "classes",
    )
    banded = classes.select("cls", "rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min(F.struct("rep", "cls")).alias("pivot"), F.min("cls").alias("c0"), F.max("cls").alias("c1")).where(F.col("c0") != F.col("c1"))
    # written first: both sides of the join are then plain exchanges, and a crowded bucket can be split
    buckets = settle(buckets.select("key", F.col("pivot.cls").alias("pivot")), "buckets")
    members = settle(banded.select("cls", "key").join(buckets, "key"), "members")
    discard(buckets)

    facts = classes.select("cls", "n", "sketch_a", "sketch_b")
    side = lambda s: facts.select(F.col("cls").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "sketch_a", "sketch_b")))
    apart = F.bit_count(F.col("sketch_a_a").bitwiseXOR(F.col("sketch_a_b"))) + F.bit_count(F.col("sketch_b_a").bitwiseXOR(F.col("sketch_b_b")))
    fits = (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (apart <= SKETCH_MOST)
    stars = members.where(F.col("cls") != F.col("pivot")).select(F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()
    stars = settle(stars.join(side("a"), "a").join(side("b"), "b").where(fits).select("a", "b"), "stars")
    ends = stars.select(F.col("a").alias("cls")).unionByName(stars.select(F.col("b").alias("cls"))).distinct()
    texts, places = docs.select(place.alias("place"), "text", "th"), classes.select("cls", "place", "place_th")
    sets = _full_sets(places.join(ends, "cls", "left_semi"), texts, size)
    links = _confirm(stars, sets, percent)
    discard(sets)
    discard(stars)
    release(docs.sparkSession)

    label = components(links)
    known = members.join(label.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("c"))
    split = known.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where(F.col("c0") != F.col("c1")).select("key")
    known, split = settle(known, "known"), settle(split, "split")
    left = settle(known.join(split, "key", "left_semi").select("cls", "c").distinct(), "unsettled")
    for done in (members, known, split):
        discard(done)
    if not left.isEmpty():
        sets = _full_sets(places.join(left, "cls", "left_semi"), texts, size)
        more = _confirm(_across(left, sets, side, fits, percent), sets, percent)
        discard(sets)
        if not more.isEmpty():
            label = components(links.unionByName(more))
    group = classes.join(label, classes["cls"] == label["node"], "left").select("set_a", "set_b", "rep", F.coalesce("component", "cls").alias("c"))
    group = settle(group, "groups")
    # a component is named by its smallest doc_id
    names = settle(group.groupBy("c").agg(F.min("rep").alias("component_id")), "names")
    group = group.select("set_a", "set_b", "c").join(names, "c").select("set_a", "set_b", "component_id")
    joined = signed.select("doc_id", "th", "n_shingles", "set_a", "set_b").join(group, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "th", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Texts are linked where 100 * |A and B| >= percent * |A or B| over their sets of `size`-word shingles,
    words being runs of bytes other than ASCII white space with A-Z lower-cased.
    """
    return _judged(docs, size, percent).drop("th")


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the rows that aren't kept, with its columns as they are; one document of each group stays."""
    dropped = _judged(docs, size, percent).where(~F.col("kept")).select(F.coalesce("doc_id", "th").alias("place"), "th").distinct()
    return without_rows(docs, settle(dropped, "dropped"))


def without_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows listed by place (doc_id, else the text's hash) and th; only rows that the sieve can't clear are shuffled."""
    place, th = fresh(docs, "place"), fresh(docs, "th")
    text = F.col("text").cast("string")
    marked = docs.select(*columns_of(docs), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias(place), F.xxhash64(text).alias(th))
    sieve = Sieve(dropped, "place")
    listed = dropped.select(F.col("place").alias(place), F.col("th").alias(th))
    left = sieve.surely_not(marked, place).unionByName(sieve.maybe(marked, place).join(listed, [place, th], "left_anti").select(*columns_of(marked)))
    return left.select(*columns_of(docs))
