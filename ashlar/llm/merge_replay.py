"""Byte-level BPE by replaying merges over the corpus' distinct words.

The parts of all texts between spaces are counted over the corpus. Those that occur
most often, as many as all executors can hold (at most BASE_UNITS, told by their
counts, nine tenths of all parts or so), form one table of words in partitions, and
each is replayed once: a partition's words stand in one array of tokens, with links
between neighbours. An inverted index leads from the rank of a token pair to the
positions where the pair stands, and a heap holds the ranks that have positions.
The lowest rank is taken, its merge is applied at every position still valid,
and only the two pairs beside each merged position are looked up again. The table of
words and their ids then goes to all executors, where texts are put together from it.
The rest, which occur a few times each, are replayed in the same way, but where they
stand: a block's new words at once. To join them back, all texts would have to be
shuffled besides them.

A merge may make a pair of lower rank, as any split of a token's bytes counts as
a pair. The order of ranks over all words is then not that word's own, so words
where this happens are noted and encoded alone, lowest rank and leftmost first.
For all others, the two orders give the same, as words don't touch each other.

Defined cases: a null text is the empty text, which has no ids, no bytes and the
hash of nothing; repeated rows stay; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .units import Kept, UnitCache, blocks, count_units

#: Matches of the pattern whose ids a worker keeps; others are replayed again.
MOST_KNOWN = 200_000
#: Parts of texts, of some tens of bytes each, whose ids go to all executors, none longer than LONGEST characters.
BASE_UNITS, LONGEST = 300_000, 64
#: Parts that are replayed at once.
TOGETHER = 50_000
#: Places from which on a merge is applied to all of them by array operations.
FEW = 24


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class MergeReplay:
    """Encoder and decoder for tokens with ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.pairs: dict[int, int] = {}  # both ids in one integer
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    self.pairs[a << 32 | b] = rank
        self.keys = np.array(sorted(self.pairs), dtype=np.int64)
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.known = Kept(MOST_KNOWN, 64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.first_rank = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)])

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (right >= 0), self.merged[at], -1)

    def alone(self, word: bytes) -> list[int]:
        """One word: its lowest pair, leftmost first, again and again, by a heap of its own."""
        ids = self.single[list(word)].tolist()
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [pairs.get(a << 32 | b, -1) for a, b in zip(ids, ids[1:], strict=False)] + [-1]
        heap = [(rank, p) for p, rank in enumerate(rank_at) if rank >= 0]
        heapq.heapify(heap)
        while heap:
            rank, p = heapq.heappop(heap)
            if rank_at[p] != rank:
                continue
            q = after[p]
            ids[p], ids[q], rank_at[q] = rank, -1, -1
            after[p] = r = after[q]
            if r < n:
                before[r] = p
            for left, right in ((before[p], p), (p, r)):
                if left >= 0:
                    rank_at[left] = new = pairs.get(ids[left] << 32 | ids[right], -1) if right < n else -1
                    if new >= 0:
                        heapq.heappush(heap, (new, left))
        return [i for i in ids if i >= 0]

    def replay(self, words: Sequence[bytes]) -> list[bytes]:
        """The ids of each word, as unsigned 32-bit integers; a word has at least one byte."""
        if not words:
            return []
        joined = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths) - 1
        starts = ends + 1 - lengths
        n = len(joined)
        tokens = np.append(self.single[joined], -1).astype(np.int32)  # one more: what a link past the end leads to
        tokens[ends] = -1  # between words: in no pair
        now = np.full(n + 1, -1, dtype=np.int32)  # the rank of the pair that begins there
        now[: n - 1] = self.first_rank[joined[:-1], joined[1:]]
        now[ends] = -1
        now[ends - 1] = -1
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        places = np.flatnonzero(now >= 0)
        places = places[np.argsort(now[places], kind="stable")]
        ranks, cuts = np.unique(now[places], return_index=True)
        index: dict[int, list[int]] = {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(places, cuts[1:]), strict=True)} if len(ranks) else {}
        heap = list(index)
        heapq.heapify(heap)
        odd: list[int] = []  # places of words where a merge made a pair of lower rank
        token, rank_at, next_, last, pairs = memoryview(tokens), memoryview(now), memoryview(after), memoryview(before), self.pairs

        def file(places: list[int], ranks: list[int], limit: int) -> None:
            for p, rank in zip(places, ranks, strict=True):
                if rank >= 0:
                    if rank < limit:
                        odd.append(p)
                    if rank in index:
                        index[rank].append(p)
                    else:
                        index[rank] = [p]
                        heapq.heappush(heap, rank)

        while heap:
            rank = heapq.heappop(heap)
            found = index.pop(rank, None)
            if found is None:
                continue
            if len(found) >= FEW:
                p = np.unique(np.array(found, dtype=np.int32))
                p = p[now[p] == rank]
                q = after[p]
                if not (q[:-1] == p[1:]).any():  # no place in two pairs
                    r = after[q]
                    tokens[p], tokens[q], now[q] = rank, -2, -1
                    after[p], before[r] = r, p
                    left = before[p]
                    right_rank, left_rank = self._ranks(tokens[p], tokens[r]), self._ranks(tokens[left], tokens[p])
                    left_rank[tokens[left] < 0] = -1
                    now[left] = left_rank
                    now[p] = right_rank
                    file(left.tolist(), left_rank.tolist(), rank)
                    file(p.tolist(), right_rank.tolist(), rank)
                    continue
            for p in sorted(found):
                if rank_at[p] != rank:
                    continue
                q = next_[p]
                r = next_[q]
                token[p], token[q], rank_at[q] = rank, -2, -1
                next_[p], last[r] = r, p
                left = last[p]
                near = (left, p)
                made = [-1, -1]
                if left >= 0 and (t := token[left]) >= 0:
                    made[0] = rank_at[left] = pairs.get(t << 32 | rank, -1)
                made[1] = rank_at[p] = pairs.get(rank << 32 | token[r], -1)
                file(near, made, rank)
        live = tokens[:n] >= 0
        data = tokens[:n][live].astype("<u4").tobytes()
        at = np.concatenate(([0], 4 * np.cumsum(np.add.reduceat(live, starts, dtype=np.int64)))).tolist()
        out = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
        for k in set(np.searchsorted(starts, odd, "right").tolist()) if odd else ():
            out[k - 1] = array("I", self.alone(words[k - 1])).tobytes()
        return out

    def encode_many(self, parts: Sequence[str]) -> list[bytes]:
        """Ids of whole strings, by the pattern's matches; each distinct match that isn't known is replayed once."""
        matches = [self.find(part) for part in parts]
        found = list(set().union(*matches))
        coded = self.known.get_many(found)
        new = [k for k, x in enumerate(coded) if x is None]
        encoded = [found[k].encode() for k in new]
        missing = []
        for k, data in zip(new, encoded, strict=True):
            if (rank := self.ranks.get(data)) is None:
                missing.append(k)
            else:
                coded[k] = array("I", (rank,)).tobytes()
        for k, x in zip(missing, self.replay([found[k].encode() for k in missing]), strict=True):
            coded[k] = x
        self.known.put_many([found[k] for k in new], [coded[k] for k in new])
        ids = dict(zip(found, coded, strict=True))
        return [b"".join(map(ids.__getitem__, m)) for m in matches]

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_REPLAYS: dict[tuple[str, str], tuple[MergeReplay, UnitCache]] = {}


def encoder(path: str, pattern: str) -> tuple[MergeReplay, UnitCache]:
    """The replay of a file's ranks and a cache before it, one for each Python worker."""
    if (path, pattern) not in _REPLAYS:
        replay = MergeReplay(read_ranks(path), pattern)
        _REPLAYS[path, pattern] = replay, UnitCache(replay.encode_many, most=MOST_KNOWN)
    return _REPLAYS[path, pattern]


def corpus_codes(scratch: Scratch, texts: DataFrame, path: str, pattern: str) -> DataFrame:
    """``unit`` and ``ids`` of the corpus' most frequent parts of texts, at most BASE_UNITS: those of a space and the unit."""
    counted = texts.mapInArrow(count_units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    units = scratch.keep(counted.where((F.col("n") > 1) & (F.length("unit") <= LONGEST)), "units")
    # The least power of two that not too many counts reach: no order of all units is needed.
    power, held, least = F.floor(F.log2("n")).cast("int"), 0, 62
    for row in units.groupBy(power.alias("power")).agg(F.count("*").alias("units")).orderBy(F.desc("power")).collect():
        held += row.units
        if held > BASE_UNITS:
            break
        least = row.power

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = encoder(path, pattern)
        for table in gathered(batches, TOGETHER):
            words = table.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([table.column(0).combine_chunks(), pa.array(own.encode_many([" " + w for w in words]), pa.binary())], names=["unit", "ids"])

    frequent = units.where(F.col("n") >= F.lit(1 << least)).select("unit")
    return scratch.keep(frequent.mapInArrow(replay, "unit string, ids binary"), "codes")


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of about so many rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode its ids, and give a digest of either: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "merge-replay")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    codes = corpus_codes(scratch, texts, path, pattern).toArrow()
    shared = spark.sparkContext.broadcast((codes.column("unit").combine_chunks(), codes.column("ids").combine_chunks()))  # at most BASE_UNITS
    name = scratch.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, cache = encoder(path, pattern)
        if cache.base_of != name:  # a worker builds it once
            units, ids = shared.value
            cache.base, cache.base_of = dict(zip(units.to_pylist(), ids.to_pylist(), strict=True)), name
        decimal = [str(i) for i in range(len(replay.bytes_of))]
        for doc_ids, some in blocks(batches):
            counts, coded, decoded = [], [], []
            flat, at = cache.encode(some)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                ids = flat[a:b].tolist()
                counts.append(len(ids))
                coded.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(replay.decode(ids)).hexdigest())
            columns = [pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(coded), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
