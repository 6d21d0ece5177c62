"""Bytes of repeated passages: every byte covered by a LENGTH-byte string that also starts elsewhere.

A suffix-array method over a difference cover. A cover is a sample of positions such that any two equal
LENGTH-byte strings hold samples at the same offset; suffixes then need sorting at samples only, and all
others follow from the sample within their first LENGTH bytes. The regular cover modulo 3 samples two
thirds of all bytes. This one is defined by content: a position is sampled where the hash of its NAME
bytes is least in a window of LENGTH - NAME + 1 positions, about one position in 69, and equal strings
hold equal least hashes at equal offsets. The steps are those of the difference-cover algorithm:

1. Name the samples by their next NAME bytes; names that occur once can't lie in a repeated string.
2. Recurse on what surrounds a name: samples with equal contexts (LENGTH bytes ahead, LENGTH - NAME
   behind) are one class, whose strings all repeat if it has two members.
3. Sort the other classes, per name, by the bytes ahead and by the reversed bytes behind, and compare
   adjacent prefixes: that bounds how far each sample's strings can repeat on either side, and settles
   it where one neighbour reaches the bound on both sides together.
4. Merge the remaining suffixes: the few strings between a settled and a bounding extent are named,
   looked for among the name's other contexts, and counted.

All sorts are range-partitioned, so a passage that a third of all documents share is split among tasks;
counts are combined before the shuffle; texts are whole and matches stay within one text. Names, classes
and strings are compared by 64-bit hashes (jointly 128 bits for a context, 192 for a string); sorted
contexts by their bytes.

Defined results: null is the empty text; texts below LENGTH bytes lose nothing; a text that occurs in two
rows is a repeat of itself in both; rows that repeat doc_id and text have equal results; extra columns
are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import U64, buffers, mix, prefix_hash, span_hash
from .runtime import discard, prepare, settle
from .sieve import Sieve

LENGTH, NAME = 200, 64
BEHIND = LENGTH - NAME
#: Sorted neighbours on either side that a context is compared with.
NEAR = 6


def _slide(x: np.ndarray, width: int, function) -> np.ndarray:
    """function over each window of `width` values, by doubling."""
    w = 1
    while 2 * w <= width:
        x = function(x[:-w], x[w:])
        w *= 2
    rest = width - w
    return function(x[: len(x) - rest], x[rest:]) if rest else x


def samples(h: np.ndarray) -> np.ndarray:
    """Positions whose hash is least in some window of BEHIND + 1 positions."""
    width = BEHIND + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = _slide(h, width, np.minimum)
    pad = np.zeros(width - 1, U64)
    return np.flatnonzero(_slide(np.concatenate((pad, least, pad)), width, np.maximum) == h)


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) -> doc_id, th, pos, name, ctx of each sample."""
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        names, contexts, places, owner = [], [], [], []
        for k in range(batch.num_rows):
            a = data[offsets[k] : offsets[k + 1]]
            n = len(a)
            if n < LENGTH:
                continue
            prefix = prefix_hash(a)
            i = np.arange(n - NAME + 1)
            h = span_hash(prefix, i, i + NAME)
            p = samples(h)
            left, right = np.maximum(p - BEHIND, 0), np.minimum(p + LENGTH, n)
            names.append(h[p])
            contexts.append(mix(span_hash(prefix, left, right) + (p - left).astype(U64)))
            places.append(p)
            owner.append(np.full(len(p), k))
        own = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        column = lambda x, kind: pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind))
        signed = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), column(places, np.int32), signed(names), signed(contexts)],
            names=["doc_id", "th", "pos", "name", "ctx"],
        )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, places: array of (name, ctx, n, pos)) -> name, ctx, n, behind, context, and both sides as sort keys."""
    for batch in batches:
        rows = []
        for text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            for x in places:
                p = x["pos"]
                low = max(0, p - BEHIND)
                rows.append((x["name"], x["ctx"], x["n"], p - low, raw[low:p][::-1], raw[p : p + LENGTH]))
        yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()], _CUT)


def _batch(rows: list, types: list, names: list) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


_CUT = ["name", "ctx", "n", "behind_n", "behind", "ahead"]


def _common(sides: list[bytes], width: int, step: int) -> np.ndarray:
    """Lengths of the common prefixes of sides[i] and sides[i + step]."""
    size = np.array([len(s) for s in sides])
    m = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in sides), np.uint8).reshape(len(sides), width)
    differ = m[:-step] != m[step:]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return np.minimum(first, np.minimum(size[:-step], size[step:]))


def _neighbours(names: np.ndarray, behind: list[bytes], ahead: list[bytes]) -> tuple[np.ndarray, ...]:
    """For rows in order: greatest extents behind and ahead over neighbours, and the span of offsets known to repeat.

    Columns: reach behind, reach ahead, lowest and highest offset d (the string starts d bytes before the
    sample) of which a repeat was seen; low > high if none.
    """
    n = len(names)
    back, front = np.zeros(n, np.int32), np.zeros(n, np.int32)
    low, high = np.full(n, LENGTH, np.int32), np.full(n, -1, np.int32)
    for step in range(1, min(NEAR, n - 1) + 1):
        same = names[:-step] == names[step:]
        a = np.where(same, _common(behind, BEHIND, step), 0)
        b = np.where(same, _common(ahead, LENGTH, step), 0)
        ok = same & (a + b >= LENGTH)
        for part in (slice(None, -step), slice(step, None)):
            back[part] = np.maximum(back[part], a)
            front[part] = np.maximum(front[part], b)
            low[part] = np.where(ok, np.minimum(low[part], LENGTH - b), low[part])
            high[part] = np.where(ok, np.maximum(high[part], a), high[part])
    return back, front, low, high


_SEEN = "name long, ctx long, back int, front int, low int, high int, edge int, side int, place int, behind binary, ahead binary"


def _adjacent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition: what neighbours show, and its first and last NEAR rows (edge not null) for the neighbouring partitions."""
    me = TaskContext.get().partitionId()
    head: list[tuple] = []
    carry: list[tuple] = []
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5)), strict=True))
        if not rows:
            continue
        if len(head) < NEAR:
            head += rows[: NEAR - len(head)]
        own = carry + rows
        yield _shown(own)
        carry = own[-NEAR:]
    none = (None,) * 4
    yield _batch([(*r[:2], *none, me, side, i, *r[2:]) for side, part in ((1, head), (0, carry)) for i, r in enumerate(part)], _SEEN_TYPES, _SEEN_NAMES)


def _shown(rows: list[tuple]) -> pa.RecordBatch:
    names = np.array([r[0] for r in rows], np.int64)
    found = _neighbours(names, [r[2] for r in rows], [r[3] for r in rows])
    none = [None] * len(rows)
    return _batch(list(zip(names.tolist(), [r[1] for r in rows], *(x.tolist() for x in found), *[none] * 5, strict=True)), _SEEN_TYPES, _SEEN_NAMES)


_SEEN_NAMES = [x.split()[0] for x in _SEEN.split(", ")]
_SEEN_TYPES = [pa.int64(), pa.int64(), *[pa.int32()] * 7, pa.binary(), pa.binary()]
_REACH = ["name", "ctx", "back", "front", "low", "high"]


def _border(rows: pd.DataFrame) -> pd.DataFrame:
    """The last rows of a partition and the first of the next, 2 * NEAR at most, as neighbours of each other."""
    rows = rows.sort_values(["side", "place"])
    return _shown(list(zip(rows["name"], rows["ctx"], rows["behind"], rows["ahead"], strict=True))).select(_REACH).to_pandas()


def _sorted_pass(contexts: DataFrame, first: str, second: str, used: list) -> DataFrame:
    """name, ctx, back, front, low, high: what sorting by name, first and second shows of each context."""
    order = ["name", first, second, "ctx"]
    seen = settle(contexts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_adjacent, _SEEN), "adjacent")
    used.append(seen)
    out = seen.where(F.col("edge").isNull()).select(*_REACH)
    # the numbers of partitions that aren't empty, one for each task: the driver held as many to run them
    parts = sorted(r[0] for r in seen.where("side = 0").select("edge").distinct().collect())
    if len(parts) < 2:
        return out
    before = contexts.sparkSession.createDataFrame(list(zip(parts[1:], parts, strict=False)), "edge int, before int")
    ends = seen.where("side = 0").withColumn("before", F.col("edge")).unionByName(seen.where("side = 1").join(F.broadcast(before), "edge").select(*seen.columns, "before"))
    meeting = ends.select("before", "side", "place", "name", "ctx", "behind", "ahead").groupBy("before")
    return out.unionByName(meeting.applyInPandas(_border, out.schema))


def _strings(sieve: Sieve | None):
    """(name, ctx, n, behind, ahead, offsets) -> name, d, string hash, ctx, n for each offset d at which a string fits.

    With a sieve, only strings that it may hold.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, ctx, n, behind, ahead, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = np.frombuffer(behind[::-1] + ahead, np.uint8)
                d = np.array(offsets, np.int64)
                d = d[(d >= max(0, LENGTH - len(ahead))) & (d <= len(behind))]
                if not len(d):
                    continue
                at = len(behind) - d
                h = span_hash(prefix_hash(raw), at, at + LENGTH).view(np.int64)
                if sieve is not None:
                    hit = sieve.hits(h)
                    d, h = d[hit], h[hit]
                out += [(name, x, y, ctx, n) for x, y in zip(d.tolist(), h.tolist(), strict=True)]
            yield _batch(out, [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()], ["name", "d", "string", "ctx", "n"])

    return run


def _extents(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """name, ctx, low, high of the classes whose strings repeat from offset high before the sample down to low."""
    whole = classes.where(F.col("n") > 1).select(
        "name", "ctx", (F.lit(LENGTH) - F.col("ahead_n")).alias("low"), F.col("behind_n").alias("high")
    )  # equal contexts: all strings of theirs repeat
    several = classes.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).where((F.col("k") > 1) & (F.col("single") > 0))
    # written first: both sides of the join are then plain exchanges, and a name of very many contexts can be split
    several = settle(several.select("name"), "several")
    asked = settle(classes.join(several, "name", "left_semi").select("name", "ctx", "n", "doc_id", "th", "pos"), "asked")
    per_doc = settle(asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("name", "ctx", "n", "pos")).alias("places")), "places")
    texts = Sieve(per_doc, "doc_id").maybe(docs, "doc_id")
    cut = texts.dropDuplicates(["doc_id", "th"]).join(per_doc, ["doc_id", "th"]).select("text", "places")
    contexts = settle(cut.mapInArrow(_cut, "name long, ctx long, n long, behind_n int, behind binary, ahead binary"), "contexts")
    used = [several, asked, per_doc, contexts]
    seen = _sorted_pass(contexts, "behind", "ahead", used).unionByName(_sorted_pass(contexts, "ahead", "behind", used))
    reach = seen.groupBy("name", "ctx").agg(F.max("back").alias("back"), F.max("front").alias("front"), F.min("low").alias("low"), F.max("high").alias("high"))
    single = classes.where(F.col("n") == 1).select("name", "ctx")
    reach = settle(reach.join(single, ["name", "ctx"], "left_semi").where(F.col("back") + F.col("front") >= LENGTH), "reach")
    least = F.lit(LENGTH) - F.col("front")  # the lowest offset that any neighbour allows
    # offsets still open: above the highest seen to repeat, and below the lowest
    none = F.col("high") < 0
    top = F.when(none, least).otherwise(F.col("high") + 1)
    bottom = F.when(none, F.lit(-1)).otherwise(F.col("low") - 1)
    open_ = reach.select("name", "ctx", top.alias("t0"), F.col("back").alias("t1"), least.alias("b0"), bottom.alias("b1")).where((F.col("t0") <= F.col("t1")) | (F.col("b0") <= F.col("b1")))
    asked_of = F.filter(
        F.array_distinct(F.concat(*(F.when(F.col(x) <= F.col(y), F.sequence(x, y)).otherwise(F.array().cast("array<int>")) for x, y in (("t0", "t1"), ("b0", "b1"))))),
        lambda d: (d >= 0) & (d <= BEHIND),
    )
    open_ = settle(open_.select("name", "ctx", asked_of.alias("offsets")), "open")
    kinds = "name long, d int, string long, ctx long, n long"
    sides = ("name", "ctx", "n", "behind", "ahead", "offsets")
    wanted = settle(contexts.join(open_, ["name", "ctx"]).select(*sides).mapInArrow(_strings(None), kinds), "wanted")
    # partners are all contexts of the name; of their strings only wanted ones leave the task, summed up
    need = settle(open_.select("name", F.explode("offsets").alias("d")).distinct().groupBy("name").agg(F.collect_list("d").alias("offsets")), "need")
    used.append(need)
    sieve = Sieve(wanted, "string", hashed=True)
    partners = contexts.join(need, "name").select(*sides).mapInArrow(_strings(None if sieve.bitmap is None else sieve), kinds)
    if sieve.bitmap is None:
        partners = partners.join(wanted.select("name", "d", "string"), ["name", "d", "string"], "left_semi")
    twice = partners.groupBy("name", "d", "string").agg(F.sum("n").alias("m")).where(F.col("m") > 1).select("name", "d", "string")
    found = wanted.join(twice, ["name", "d", "string"], "left_semi").select("name", "ctx", F.col("d").alias("low"), F.col("d").alias("high"))
    known = reach.where(F.col("high") >= 0).select("name", "ctx", "low", "high").unionByName(found)
    known = known.groupBy("name", "ctx").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    out = settle(whole.unionByName(known), "extents")
    for table in (*used, reach, open_, wanted):
        discard(table)
    return out


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) -> the digest row of each text."""
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            raw = (text or "").encode()
            kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for x in spans):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            for start, end in merged:
                kept.update(raw[at:start])
                at, removed, runs = end, removed + end - start, runs + 1
            kept.update(raw[at:])
            rows.append((doc_id, len(raw), removed, runs, kept.hexdigest(), [{"start": a, "end": b} for a, b in merged]))
        yield _batch(rows, [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPANS], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges)."""
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("own_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))
    # rows without an id go by their text's hash until the end
    docs = docs.select(F.coalesce("own_id", "th").alias("doc_id"), "own_id", "text", "th")
    sampled = settle(docs.select("doc_id", "th", "text").mapInArrow(_sample, "doc_id long, th long, pos int, name long, ctx long"), "samples")
    names = settle(sampled.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("name"), "names")
    repeated = settle(Sieve(names, "name", hashed=True).maybe(sampled, "name"), "repeated")
    discard(sampled)
    discard(names)
    place = F.struct("doc_id", "th", "pos")
    classes = repeated.groupBy("name", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at"))
    # extents need a class's own bounds: all its members have the same
    sizes = docs.select("doc_id", "th", F.octet_length("text").alias("bytes"))
    classes = classes.select("name", "ctx", "n", "at.doc_id", "at.th", "at.pos")
    classes = classes.join(sizes.dropDuplicates(["doc_id", "th"]), ["doc_id", "th"]).select(
        "*", F.least("pos", F.lit(BEHIND)).alias("behind_n"), F.least(F.col("bytes") - F.col("pos"), F.lit(LENGTH)).alias("ahead_n")
    )
    classes = settle(classes, "classes")
    extents = _extents(docs, classes)
    spans = repeated.join(extents, ["name", "ctx"]).select("doc_id", "th", F.struct((F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + LENGTH).alias("end")).alias("span"))
    per_doc = settle(spans.groupBy("doc_id", "th").agg(F.collect_set("span").alias("spans")), "spans")
    sieve = Sieve(per_doc, "doc_id")
    clear, touched = sieve.surely_not(docs, "doc_id"), sieve.maybe(docs, "doc_id")
    empty = F.array().cast("array<struct<start:int,end:int>>")
    zero = F.lit(0).cast("long")
    same = clear.select(F.col("own_id").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), empty.alias("spans"))
    cut = touched.join(per_doc, ["doc_id", "th"], "left").select(F.col("own_id").alias("doc_id"), "text", F.coalesce("spans", empty).alias("spans"))
    return same.unionByName(cut.mapInArrow(_merge, _OUT))
