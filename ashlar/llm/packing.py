"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition encodes its documents and packs their pieces by best fit, longest
first. Bins that are nearly full are final. The others become items of their
own, whose length is what they hold; fewer, larger partitions pack these by the
same rule, level by level, until one task has seen all that is left or a level
has more items than one task should hold.

Defined cases: a null text is the empty text, which has only the end id; rows
with equal or null ids stay separate rows; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch
from .units import blocks, hf_encoder

CAPACITY = 2048
#: A bin with at most so many free places is final.
SLACK = 8
#: Items that one task of a level packs.
TASK_ITEMS = 50_000
#: Partitions of a level that become one of the next.
FAN_IN = 8

_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, by best fit in order of decreasing length.

    Bins are kept by their free places; a bit set over the free places finds the
    tightest bin that fits in constant time.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    some, n_bins = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[k])
        if fits := some >> length:
            room = length + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                some &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        bins[k], offsets[k] = b, capacity - room
        if left := room - length:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` tokens: full ones, but for the first, which has the rest."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _encode_and_pack(path: str, end_id: int, capacity: int):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hf_encoder(path)
        rows: list[list] = [[], [], [], [], []]
        for docs, texts in blocks(batches):
            ids, at = encoder.encode(texts)
            for doc, a, b in zip(docs, at[:-1].tolist(), at[1:].tolist(), strict=True):
                data = ids[a:b].tobytes() + end
                for k, (start, length) in enumerate(cut(b - a + 1, capacity)):
                    for to, x in zip(rows, (doc, k, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])), strict=True):
                        to.append(x)
        bins, offsets = best_fit(np.array(rows[3], dtype=np.int64), capacity)
        bins += TaskContext.get().partitionId() << 32
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        names = [c.split()[0] for c in _PLACED.split(", ")]
        columns = [pa.array(x, kind) for x, kind in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(bins), pa.array(offsets)], names=names)

    return run


def _pack_bins(capacity: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [b for b in batches if b.num_rows]
        if read:
            items = np.concatenate([b.column(0).to_numpy() for b in read])
            order = np.argsort(items)
            lengths = np.concatenate([b.column(1).to_numpy() for b in read])[order]
            bins, offsets = best_fit(lengths, capacity)
            bins += level << 56 | TaskContext.get().partitionId() << 32
            yield pa.RecordBatch.from_arrays([pa.array(items[order]), pa.array(lengths), pa.array(bins), pa.array(offsets)], names=["item", "fill", "into", "at"])

    return run


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Rows of every piece of every document with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    scratch = Scratch(spark, "packing")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = scratch.keep(texts.mapInArrow(_encode_and_pack(tokenizer, end_id, capacity), _PLACED), "placed")

    items = placed.groupBy(F.col("bin").alias("item")).agg(F.sum("length").alias("fill"))
    into, level = None, 0
    while True:
        level += 1
        items = scratch.keep(items.where(F.col("fill") < capacity - SLACK), f"items{level}")
        count, parts = items.count(), items.rdd.getNumPartitions()
        if count < 2:
            break
        fewer = max(-(-count // TASK_ITEMS), min(parts // FAN_IN, count // 1000), 1)
        moves = scratch.keep(items.coalesce(fewer).mapInArrow(_pack_bins(capacity, level), "item long, fill long, into long, at long"), f"moves{level}")
        step = moves.select("item", "into", "at")
        if into is None:
            into = step
        else:
            later = step.select(F.col("item").alias("into"), F.col("into").alias("into2"), F.col("at").alias("at2"))
            into = into.join(later, "into", "left").select("item", F.coalesce("into2", "into").alias("into"), (F.col("at") + F.coalesce("at2", F.lit(0))).alias("at"))
        if fewer == 1 or fewer >= parts:
            break
        items = moves.groupBy(F.col("into").alias("item")).agg(F.sum("fill").alias("fill"))
    where = (F.col("bin"), F.col("offset")) if into is None else (F.coalesce("into", "bin"), F.col("offset") + F.coalesce("at", F.lit(0)))
    if into is not None:
        placed = placed.join(into.withColumnRenamed("item", "bin"), "bin", "left")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", where[0].alias("sequence_id"), where[1].alias("offset"))
