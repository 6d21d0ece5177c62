"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's tokens, with its end id, are cut into full windows and one remainder. Remainders are packed
block by block. First they are cut, where sums of whole ones couldn't meet a window: into parts of at most
GRAIN tokens, and of every GRADED-th remainder the last part into halves of halves. Then differencing makes
the windows: each part starts as a partial partition with one filled slot; the two partitions of greatest
imbalance merge, largest slots meeting smallest, until one is left whose slots are the windows, near-equal
in size. Whenever one exceeds the capacity, the block is differenced again with one window more; nothing
is cut or moved afterwards.

Blocks are formed within the tasks that read the documents, so packing shuffles nothing and holds one
block in memory. A block leaves at most about one window's room empty, unless its windows had to rise.

Defined results: null is the empty text and gives one piece, its end id; repeated rows are packed each on
their own; extra columns are ignored; an empty table gives an empty one. Sequence ids are unique, not dense.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import encoder
from .runtime import prepare, tidy

#: Remainders packed at a time.
BLOCK = 768
#: Tokens of a part at most, which remainders are cut to the smallest parts, and the size of those.
GRAIN, GRADED, LEAST = 512, 4, 2
END = (0).to_bytes(4, "little")


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of sizes in k parts of near-equal sums; the part of greatest sum first."""
    # a partition is its k slots' sums in falling order; merged ones also say which slots met
    slots = np.zeros((len(sizes), k), np.int64)
    slots[:, 0] = sizes
    sums = list(slots)
    met: list[tuple[int, int, np.ndarray]] = []
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums[a] + sums[b][::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        met.append((a, b, order))
        sums.append(both)
        heapq.heappush(heap, (int(both[-1] - both[0]), len(sums) - 1))
    # from the last merge back: which window each slot of each partition has become
    window: list[np.ndarray | None] = [None] * len(sums)
    window[-1:] = [np.arange(k)]
    for at in range(len(met) - 1, -1, -1):
        a, b, order = met[at]
        own = np.empty(k, np.int64)
        own[order] = window[len(sizes) + at]
        window[a], window[b], window[len(sizes) + at] = own, own[::-1], None
    out: list[list[int]] = [[] for _ in range(k)]
    for i in range(len(sizes)):
        out[int(window[i][0])].append(i)
    return out


def parts_of(item: int, size: int, grain: int) -> list[tuple[int, int, int]]:
    """(item, start, length) of the parts that a remainder is cut into before differencing."""
    # the first cut differs by item, so that equal remainders give parts of many sizes
    first = max(1, grain - int(grain / 2 * (item * 0.6180339887498949 % 1)))
    edges = [0, *range(first, size, grain), size]
    if item % GRADED == 0:
        rest = size - edges[-2]
        while rest > LEAST:
            rest //= 2
            edges.insert(-1, size - rest)
    return [(item, a, b - a) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def pack_block(sizes: list[int], capacity: int) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Pieces (item, start in it, length), and windows as lists of pieces, each of at most capacity."""
    pieces = [p for i, n in enumerate(sizes) for p in parts_of(i, n, max(1, min(GRAIN, capacity // 2)))]
    lengths = [n for _, _, n in pieces]
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        windows = differencing(lengths, k)
        if all(sum(lengths[p] for p in w) <= capacity for w in windows):
            return pieces, [w for w in windows if w]
        k += 1


_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long, ids binary"


def _pack(name: str, capacity: int, want_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name)
        sequence = number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        block: list[tuple] = []

        def put(item, ids, start, end, seq, offset):
            part = ids[4 * start : 4 * end]
            rows.append((item[0], start, end - start, zlib.crc32(part), len(ids) // 4, seq, offset, item[1], part if want_ids else None))

        def flush():
            nonlocal sequence
            pieces, windows = pack_block([len(ids) // 4 - start for _, ids, start in block], capacity)
            for window in windows:
                offset = 0
                for p in window:
                    item, at, n = pieces[p]
                    own_row, ids, start = block[item]
                    put(own_row, ids, start + at, start + at + n, sequence, offset)
                    offset += n
                sequence += 1
            block.clear()

        def batch_of():
            columns = list(zip(*rows, strict=True)) if rows else [()] * 9
            rows.clear()
            types = [pa.int64()] * 8 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.ids(text or "") + END
                n, start = len(ids) // 4, 0
                item, number = (doc_id, number), number + 1
                while n - start >= capacity:
                    put(item, ids, start, start + capacity, sequence, 0)
                    sequence += 1
                    start += capacity
                if start < n:
                    block.append((item, ids, start))
                if len(block) >= BLOCK:
                    flush()
                if len(rows) > 4000:
                    yield batch_of()
        if block:
            flush()
        yield batch_of()

    return run


_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, row, ids (bytes, or null).

    `row` numbers the rows of docs, so that rows that repeat a doc_id can be told apart; not densely.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_pack(tokenizer, capacity, with_ids)), _SCHEMA)
