"""Token ids in binary files with Elias-Fano coded document boundaries.

A file is a run of blocks. A block has, little-endian:

    8 bytes   magic
    u64 x 5   width of an id in bytes, documents, ids, documents with null id, smallest doc_id (signed)
    then, after these 48 bytes,
    Elias-Fano sequence of the doc_ids less the smallest (of those that aren't null; null ids come first)
    Elias-Fano sequence of the documents' ends, counted in ids from the block's start
    the ids of all documents, one after the other
    a line feed

An Elias-Fano sequence of n values up to u has, after four u64 (n, u, bits of a
low part, words of the high parts), the low parts packed, the high parts as a
bit vector in unary and the bit position of every 64th one, by which ``select``
finds a value after looking at a few words. That is about 2 + log2(u / n) bits a
value beside the samples' half bit, and there is no table of 64-bit offsets.

Files are in the order of their part's number and their own within it, and hold ascending doc_ids. A file has at most
FILE_BLOCKS blocks, and a block about BLOCK_BYTES of ids unless one document has more. An id is as wide as the largest
one of the vocabulary needs. A document's place comes from ``select`` of its end and of the one before.

Defined cases: a null text is the empty text, which has only the end id; rows
with a null doc_id come first; rows with equal ids stay separate rows, ordered
by the hash of their text; an empty table gives no blocks and no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .units import blocks, hf_encoder

MAGIC = b"ASHTOK01"
SAMPLE = 64
#: Bytes of ids of a block, unless one document has more.
BLOCK_BYTES = 4 << 20
#: Blocks of a file; who reads a file holds all of it.
FILE_BLOCKS = 8


class EliasFano:
    """A sequence of non-decreasing integers from 0 on."""

    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-((int(ones[-1]) if n else 0) + 1) // 64) * 64, dtype=np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(bits, bitorder="little").view("<u8"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<4Q", self.n, self.universe, self.low_bits, len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that starts there, and where it ends."""
        n, universe, low_bits, words = struct.unpack_from("<4Q", data, at)
        at += 32
        low = np.frombuffer(data, np.uint8, -(-n * low_bits // 8), at)
        at += len(low)
        high = np.frombuffer(data, "<u8", words, at)
        at += 8 * words
        samples = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        return cls(n, universe, low_bits, low, high, samples), at + 4 * len(samples)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        first = i * self.low_bits
        return int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8].tobytes(), "little") >> first % 8 & (1 << self.low_bits) - 1

    def select(self, i: int) -> int:
        """The value at place ``i``, from the sample before it and the words between."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = int(self.samples[i // SAMPLE])
        word, left = bit // 64, i % SAMPLE
        bits = int(self.high[word]) >> bit % 64 << bit % 64
        while (ones := bits.bit_count()) <= left:
            left -= ones
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return (64 * word + (bits & -bits).bit_length() - 1 - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """All values, decoded together."""
        ones = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)


def block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, width: int) -> bytes:
    """One block, of all documents' ids in a row and how many each has."""
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ends = np.cumsum(counts)
    header = MAGIC + struct.pack("<4Qq", width, len(doc_ids), len(ids), len(doc_ids) - len(known), least)
    return header + EliasFano.of([d - least for d in known]).to_bytes() + EliasFano.of(ends).to_bytes() + ids.astype(f"<u{width}").tobytes()


class Blocks:
    """Reads a file's blocks."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)

    def __iter__(self) -> Iterator[tuple[list[int | None], EliasFano, np.ndarray]]:
        """Of each block the doc_ids, the ends and the ids."""
        at = 0
        while at < len(self.data):
            if self.data[at : at + 8] != MAGIC:
                raise ValueError(f"no block at byte {at}")
            width, docs, n, nulls, least = struct.unpack_from("<4Qq", self.data, at + 8)
            known, at = EliasFano.read(self.data, at + 48)
            ends, at = EliasFano.read(self.data, at)
            ids = np.frombuffer(self.data, f"<u{width}", n, at)
            at += width * n + 1
            yield [None] * nulls + [int(x) + least for x in known.all()], ends, ids


def width_for(largest: int, width: int | None = None) -> int:
    """Bytes of an id, 2 or 4 if not given; an error if that is too few."""
    needed = 2 if largest < 1 << 16 else 4
    if width is not None and width < needed:
        raise ValueError(f"ids up to {largest} don't fit in {width} bytes")
    return width or needed


def _blocks(path: str, end_id: int, width: int | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hf_encoder(path)
        wide = width_for(max(encoder.largest, end_id), width)
        for docs, texts in blocks(batches):
            flat, at = encoder.encode(texts)
            flat = np.insert(flat, at[1:], end_id).astype(f"<u{wide}")
            at = at + np.arange(len(at))
            first = 0
            while first < len(docs):  # as many documents as fill a block, and one at least
                last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_BYTES // wide, "right")) - 1)
                one = block(docs[first:last], np.diff(at[first : last + 1]), flat[at[first] : at[last]], wide)
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.binary())], names=["block"])
                first = last

    return run


def write(docs: DataFrame, where: str, tokenizer: str, end_id: int, id_width: int | None = None) -> None:
    """Encode all documents and write them as files of blocks under ``where``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("h", F.xxhash64("text"))  # parts rows that share an id
    ordered = texts.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    blocks = ordered.mapInArrow(_blocks(tokenizer, end_id, id_width), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", FILE_BLOCKS).text(where)


_READ = "part int, file int, doc_id long, file_start long, n_tokens long, ids_crc32 long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            before = 0
            for docs, ends, ids in Blocks(batch.column(2)[k].as_buffer()):
                n = ends.n
                last = [ends.select(i) for i in range(n)]
                first = [0, *last[:-1]]
                wide = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
                sums = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(first, last, strict=True)]
                part, file = (np.full(n, batch.column(c)[k].as_py(), dtype=np.int32) for c in (0, 1))
                columns = (part, file, docs, np.array(first) + before, np.subtract(last, first), sums)
                kinds = (pa.int32(), pa.int32(), *[pa.int64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _READ.split(", ")])
                before += last[-1]


def _numbers(path: Column) -> tuple[Column, Column]:
    """A part's number and a file's own within it. Between them stands an id that may look like either."""
    number = lambda pattern: F.regexp_extract(path, pattern, 1).cast("int")
    return number(r"/part-(\d+)-[^/]*$").alias("part"), number(r"-c(\d+)\.[^/-]*$").alias("file")


def read_documents(spark: SparkSession, where: str, scratch: Scratch) -> DataFrame:
    """Of each document in the files: doc_id, start over all files, n_tokens and the crc32 of its ids."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(where)
    files = files.select(*_numbers(F.col("path")), "content")
    rows = scratch.keep(files.mapInArrow(_read, _READ), "rows")
    totals = rows.groupBy("part", "file").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = totals.select("part", "file", (F.sum("total").over(Window.orderBy("part", "file")) - F.col("total")).alias("before"))
    return rows.join(before, ["part", "file"]).select("doc_id", (F.col("before") + F.col("file_start")).alias("start"), "n_tokens", "ids_crc32")


def store_and_read(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to files and return what the files say of each."""
    scratch = Scratch(spark, "token-store")
    write(docs, f"{scratch.root}/files", tokenizer, end_id)
    return read_documents(spark, f"{scratch.root}/files", scratch)
