"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Tokens are runs of word bytes (letters, digits, _ and all non-ASCII, A-Z lower-cased) and runs of other
visible bytes. Their 1- and 2-grams are hashed to BUCKETS. The raw model counts the n-grams of all
documents; the target model those of labelled good ones (quality 1), at most TARGET_ROWS of them, those of
smallest hash of the id, with the raw model as a prior. A document's importance is the ratio of its likelihoods under both: log_weight is
the sum of its n-grams' log ratios. Adding Gumbel noise, fixed by the id, and keeping the k largest keys
samples k documents without replacement in proportion to importance. k is the given share of all rows, by
default the share of good rows among those labelled.

Defined results: texts without n-grams have log weight 0, as a likelihood ratio of nothing; without labels
the share is 1 and all are kept; exactly k rows are kept, ties in the key going to the smaller doc_id (null
last), then to any; rows that repeat a doc_id share its noise; extra columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytescan import LOWER, SPACE, U64, buffers, mix, portions, prefix_hash, span_hash
from .runtime import prepare, settle, unit_hash

BUCKETS, TARGET_ROWS = 10_000, 5000
#: Weight of the raw model in the target's, in n-grams.
PRIOR = 10_000.0
#: The k-th key is looked for among so many equal steps of the keys' range, level by level.
STEPS = 4096

_CLASS = np.ones(256, np.uint8)  # 0 space, 1 word, 2 other
for _b in range(128):
    if not (chr(_b).isalnum() or chr(_b) == "_"):
        _CLASS[_b] = 2
_CLASS[SPACE] = 0


def ngrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams, and the document of each."""
    data, offsets = buffers(column)
    data = LOWER[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = np.concatenate(([True], kind[1:] != kind[:-1])) | edge[:-1]
    at = np.flatnonzero(change)
    end = np.append(at[1:], len(data))
    solid = kind[at] != 0
    at, end = at[solid], end[solid]
    doc = np.searchsorted(offsets, at, side="right") - 1
    h = span_hash(prefix_hash(data), at, end)
    two = mix(h[:-1] * U64(0x9DDFEA08EB382D69) + h[1:])[doc[:-1] == doc[1:]]
    grams = np.concatenate((h, two))
    owner = np.concatenate((doc, doc[:-1][doc[:-1] == doc[1:]]))
    return (grams % U64(BUCKETS)).astype(np.int64), owner


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by bucket of all texts of a task, and of its target texts: BUCKETS rows however much it reads."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in (b.slice(low, high - low) for b in batches for low, high in portions(b.column(0))):
        grams, owner = ngrams(batch.column(0))
        raw += np.bincount(grams, minlength=BUCKETS)
        good = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        target += np.bincount(grams[good[owner]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(raw), pa.array(target)], names=["bucket", "raw", "target"])


def _weigh(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = np.frombuffer(table.value, np.float64)
        for batch in (b.slice(low, high - low) for b in batches for low, high in portions(b.column(1))):
            grams, owner = ngrams(batch.column(1))
            n = np.bincount(owner, minlength=batch.num_rows)
            weight = np.bincount(owner, weights=ratio[grams], minlength=batch.num_rows).astype(np.float64)  # of no n-grams: integers
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(weight)], names=["doc_id", "n_grams", "log_weight"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratio of the two models by bucket, and the share of good rows among those labelled."""
    prepare(docs.sparkSession)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"))
    share = known.agg(F.avg("q")).first()[0]
    # at most TARGET_ROWS ids: small enough to broadcast whatever the input
    chosen = known.where(F.col("q") == 1).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(TARGET_ROWS).select("doc_id", F.lit(True).alias("good"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.join(F.broadcast(chosen), "doc_id", "left").select("text", "good").mapInArrow(_tally, "bucket int, raw long, target long")
    totals = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in totals:
        raw[b], target[b] = r, t
    return log_ratio(raw, target), (1.0 if share is None else float(share))


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the models by bucket, the target's having PRIOR n-grams of the raw one as a prior; 0 where nothing was counted."""
    p = np.where(raw > 0, raw, 1) / max(1.0, raw.sum())
    return np.where(raw > 0, np.log((target + PRIOR * p) / (target.sum() + PRIOR)) - np.log(p), 0.0)


def _kth(rows: DataFrame, k: int) -> tuple[float, int, float]:
    """The largest bound found with at most k keys above it, how many those are, and where the next keys end."""
    lo, hi = rows.agg(F.min("key"), F.max("key")).first()
    above = 0
    hi = hi + 1e-9 * max(1.0, abs(hi))
    for _ in range(4):
        width = (hi - lo) / STEPS
        if width <= 1e-12 * max(1.0, abs(lo)):
            break
        part = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(STEPS - 1)).cast("int")
        hist = rows.where((F.col("key") >= lo) & (F.col("key") < hi)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        for p, n in sorted(((r["part"], r["n"]) for r in hist.collect()), reverse=True):  # at most STEPS rows
            if above + n > k:
                lo, hi = lo + p * width, (lo + (p + 1) * width if p < STEPS - 1 else hi)
                break
            above += n
        else:
            return lo, above, float("-inf")
    return hi, above, lo


def _last(rows: DataFrame, n: int):
    """The n-th of the rows by falling key, then id and row; no task sorts more than its range."""
    order = [F.col("key").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()]
    ranged = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "ties")
    part = F.shiftright("at", 33)
    # one number for each partition
    for p, m in sorted(ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect()):
        if n <= m:
            return ranged.where(F.col("at") == (p << 33) + n - 1).first()
        n -= m
    return None


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_grams, log_weight, key, kept."""
    spark = prepare(docs.sparkSession)
    ratio, known = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(ratio.tobytes())
    scored = rows.mapInArrow(_weigh(table), "doc_id long, n_grams long, log_weight double")
    noise = -F.log(-F.log(unit_hash("doc_id", seed=10)))
    scored = settle(scored.withColumn("key", F.col("log_weight") + noise).withColumn("row", F.monotonically_increasing_id()), "keys")
    n = scored.count()
    k = round((known if share is None else share) * n)
    if k >= n or not n:
        return scored.drop("row").withColumn("kept", F.lit(True))
    bound, above, low = _kth(scored, k)
    kept = F.col("key") >= bound
    # what lies right below the bound are ties to within rounding
    last = _last(scored.where((F.col("key") < bound) & (F.col("key") >= low)), k - above) if above < k else None
    if last is not None:
        same = F.col("doc_id").eqNullSafe(F.lit(last["doc_id"]).cast("long"))
        before = F.col("doc_id").isNotNull() if last["doc_id"] is None else F.coalesce(F.col("doc_id") < last["doc_id"], F.lit(False))
        kept = kept | (F.col("key") > last["key"]) | ((F.col("key") == last["key"]) & (before | (same & (F.col("row") <= last["row"]))))
    return scored.withColumn("kept", kept).drop("row")
