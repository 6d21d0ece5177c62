"""Token counts by a two-tier lookup in the map stage; pre-tokens are never shuffled.

Tier one is a broadcast table of frequent pre-tokens and their numbers of tokens, at most FREQUENT
entries. It is counted in up to PARTS partitions of the input, on the first SAMPLE_ROWS rows of each, and
affects speed alone, never a count. Tier two is the worker's cache, bounded in bytes, which encodes what
tier one lacks. Both serve texts of every script. Texts are processed whole.

Defined results: null is the empty text, of 0 tokens; repeated rows stay; extra columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import LONGEST, Cache, encoder, pieces
from .runtime import prepare

#: Rows of a partition, and partitions, in which frequent pre-tokens are counted.
SAMPLE_ROWS, PARTS = 2000, 4
FREQUENT = 20_000
#: Tier two by tokenizer, in each worker.
_LENGTHS: dict[str, Cache] = {}


def _frequent(name: str):
    """One row a partition: its most frequent pre-tokens, how often they occur, and their numbers of tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, rows = encoder(name), Counter(), 0
        for batch in batches:
            if rows < SAMPLE_ROWS:
                seen.update(p for p in pieces(batch.column(0).to_pylist(), own) if len(p) <= LONGEST)
                rows += batch.num_rows
        top = [p for p, n in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT] if n > 1]
        columns = [pa.array([x], t) for x, t in ((top, pa.list_(pa.string())), ([seen[p] for p in top], pa.list_(pa.int64())), ([len(own.one(p)) for p in top], pa.list_(pa.int32())))]
        yield pa.RecordBatch.from_arrays(columns, names=["piece", "n", "tokens"])

    return run


def frequent(rows: DataFrame, name: str) -> dict[str, int]:
    """Tier one. Taking PARTS rows runs a few partitions, not all."""
    found = rows.select("text").mapInArrow(_frequent(name), "piece array<string>, n array<long>, tokens array<int>").take(PARTS)
    seen, tokens = Counter(), {}
    for r in found:
        seen.update(dict(zip(r["piece"], r["n"], strict=True)))
        tokens.update(zip(r["piece"], r["tokens"], strict=True))
    return {p: tokens[p] for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:FREQUENT]}


def _count(name: str, limit: int, table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, first = encoder(name), table.value
        cache = _LENGTHS.get(name)
        if cache is None or cache.fixed != first:
            cache = _LENGTHS[name] = Cache(first)
        lengths = cache.table

        def known(piece: str) -> int:
            n = lengths.get(piece)
            if n is None:
                n = len(own.one(piece))
                cache.learn(piece, n)
            return n

        for batch in batches:
            counts, sizes = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode()))
                cut = own.cut(text)
                if cut is None:
                    counts.append(len(own.library(text)))
                    continue
                try:
                    counts.append(sum([lengths[p] for p in cut]))
                except KeyError:
                    counts.append(sum([known(p) for p in cut]))
            n = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), n, pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    `tokenizer` names a byte-level BPE file of the public tokenizers.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = spark.sparkContext.broadcast(frequent(rows, tokenizer))
    return rows.mapInArrow(_count(tokenizer, limit, first), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
