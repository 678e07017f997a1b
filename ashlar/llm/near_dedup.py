"""MinHash near-deduplication with confirmation on full shingle sets.

1. Each document's set of shingles gives a digest and BANDS x ROWS minima of
   universal hashes, (a x + b) mod 2^64. Documents with equal sets become one
   representative, so copies cost one row each and no pairs.
2. A band of ROWS minima is a bucket. Each member of a bucket is paired with the
   bucket's most central member, the one whose own buckets are fullest. Pairs
   whose signatures agree in a share of less than the threshold less MARGIN go, so
   texts that share no more than a template form no group. A member is done in a
   bucket only if it is so near the centre that, by the triangle inequality of
   distances, whatever it may be linked with (but for NOISE of the signatures) is
   paired with the centre too. All others, near it or not, are paired with the most
   central of their own, TURNS times; of what is then left of a bucket, however
   large, all pairs of signatures are compared, two blocks in a task. Components of
   what stays are groups. So no bucket drops a pair that it holds.
3. In each group, the sets of all members are compared exactly: a large group is
   dealt into blocks, a task takes two blocks, counts shared shingles by a matrix
   product and returns links that span what it found connected, at most one for
   each of its texts. No link is lost to a large group, and no group meets in
   one task.
4. Components of the links, by large-star and small-star, are the result.

Defined cases: a text that is null or without words has the empty set and is
linked with nothing; with fewer words than a shingle has, its whole sequence is
the one shingle; rows with equal texts are linked; a row whose doc_id is null is
linked with nothing, has no component and is kept; rows that share a doc_id are
one document: each of them is a row of the result with the size of its own set, and what
any of their texts is linked with, all of them are; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch

BANDS, ROWS = 24, 6
#: How far below the threshold the share of equal minima may be for two texts to be in a group.
MARGIN = 0.15
#: Centres that a bucket gets, and members left over that make a block, of which a task compares two.
TURNS, LEFT_BLOCK = 3, 512
#: By how much signatures of linked texts may agree less than the threshold, where a member is done in its bucket.
NOISE = 0.03
#: Texts and shingles of a block; a large group has up to MOST_BLOCKS blocks before they grow to LARGE_BLOCK texts.
BLOCK, LARGE_BLOCK, MOST_BLOCKS, BLOCK_SHINGLES = 128, 1024, 32, 400_000

#: Up to so many rows of a few ids go to all executors; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000

_TABLE = bytes(32 if 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_random = np.random.default_rng(20_240_229)
_A = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles."""
    lowered = [(t or "").encode().translate(_TABLE) for t in texts.to_pylist()]
    split = pc.split_pattern(pa.array(lowered, pa.binary()), b" ")
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    at = np.concatenate(([0], np.cumsum(full)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    each = hashes[coded.indices.to_numpy()] if len(hashes) else hashes
    n = max(0, len(each) - words + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        runs = _scramble(runs * _ODD[0] + each[k : k + n])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:  # shorter than a shingle
            out.append(np.array([xxhash.xxh3_64_intdigest(each[a:b].tobytes())], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    out = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[k : k + 2048] * _A[:, None] + _B[:, None]).min(axis=1), out=out)
    return out


_SIGNED = "doc_id long, n long, digest binary, bands array<long>, sig binary"


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[1]
        for batch in batches:
            counts, digests, bands, sigs = [], [], [], []
            for shingles in shingle_sets(batch.column(1), words):
                counts.append(len(shingles))
                if len(shingles):
                    low = minima(shingles)
                    digests.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    bands.append(_scramble((low.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) + keys).view(np.int64))
                    sigs.append((low >> np.uint64(40)).astype("<u2").tobytes())
                else:
                    digests.append(None)
                    bands.append(None)
                    sigs.append(None)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _SIGNED.split(", ")])

    return run


def _alike(loose: float, settled: float):
    """Of pairs with signatures, whether these agree in a share of ``loose``, and in one of ``settled``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for k in (2, 3))
                share = (a == b).mean(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share >= loose), pa.array(share >= settled)], names=["u", "v", "near", "settled"])

    return run


def agreements(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places each signature of ``a`` agrees with each of ``b``."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for x, y in zip(a.T.copy(), b.T.copy(), strict=True):
        out += x[:, None] == y
    return out


def spanning(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Of a symmetric matrix, pairs that span its components."""
    left = near.any(axis=1)
    u: list[int] = []
    v: list[int] = []
    for first in np.flatnonzero(left).tolist():
        if left[first]:
            left[first] = False
            stack = [first]
            while stack:
                x = stack.pop()
                new = np.flatnonzero(near[x] & left)
                left[new] = False
                found = new.tolist()
                u += [x] * len(found)
                v += found
                stack += found
    return u, v


def _alike_in_blocks(loose: float):
    """Of two blocks of a bucket, or of one, links that span the pairs whose signatures agree in a share of ``loose``.

    Rows of two blocks are compared with the other's only; each block has a group of its own.
    """
    least = loose * BANDS * ROWS

    def compare(table: pa.Table) -> pa.Table:
        rep, own = table.column("rep").to_numpy(), table.column("own").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, BANDS * ROWS)
        first = own == table.column("a")[0].as_py()
        if first.all():
            near = agreements(sig, sig) >= least
            np.fill_diagonal(near, False)
        else:
            i, j = np.flatnonzero(first), np.flatnonzero(~first)
            near = np.zeros((len(rep), len(rep)), dtype=bool)
            near[np.ix_(i, j)] = agreements(sig[i], sig[j]) >= least
            near |= near.T
        u, v = spanning(near)
        return pa.table({"u": rep[u], "v": rep[v]}) if u else pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})

    return compare


def links(doc_ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that span the components of all pairs with 100 * intersection >= percent * union."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    used, column = np.unique(column, return_inverse=True)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    both = np.zeros((n, n), dtype=np.float32)
    width = max(1, 8_000_000 // n)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, len(used), width):
        a, b = np.searchsorted(column, (first, first + width))
        held = np.zeros((n, min(width, len(used) - first)), dtype=np.float32)
        held[row[a:b], column[a:b] - first] = 1
        both += held @ held.T
    i, j = np.nonzero(np.triu(100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), 1))
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((doc_ids[x], doc_ids[y]))
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row. Nothing but Parquet in the shared folder outlives a task."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(_sign(words), _SIGNED), "signed")

    # One representative of each set: the least doc_id that has it.
    sets = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    first = scratch.keep(sets.groupBy("digest").agg(F.min("doc_id").alias("rep")), "first")
    reps = sets.join(first, (sets.digest == first.digest) & (sets.doc_id == first.rep), "left_semi").dropDuplicates(["digest"])
    reps = scratch.keep(reps.select(F.col("doc_id").alias("rep"), "n", "bands", "sig"), "reps")  # a document with several texts has several rows
    loose = percent / 100 - MARGIN
    settled = loose + 1 - percent / 100 + NOISE

    # Buckets of two or more, each member with the sum of its buckets' sizes.
    members = reps.select("rep", F.explode("bands").alias("key")).distinct()
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = scratch.keep(members.join(sizes, "key"), "members")
    centrality = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    members = members.select("key", "rep").join(centrality, "rep")
    sig = reps.select("rep", "sig")
    near = None
    for turn in range(TURNS):
        centres = members.groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("rep"))).alias("top")).select("key", (-F.col("top.rep")).alias("u"))
        met = scratch.keep(members.join(centres, "key").where("rep != u"), f"met{turn}")
        pairs = met.select("u", F.col("rep").alias("v")).distinct()
        pairs = pairs.join(sig.select(F.col("rep").alias("v"), F.col("sig").alias("sig_v")), "v").join(sig.select(F.col("rep").alias("u"), F.col("sig").alias("sig_u")), "u")
        tried = scratch.keep(pairs.select("u", "v", "sig_u", "sig_v").mapInArrow(_alike(loose, settled), "u long, v long, near boolean, settled boolean"), f"tried{turn}")
        close = tried.where("near").select("u", "v")
        near = close if near is None else near.unionByName(close)
        apart = tried.groupBy("u", "v").agg(F.min("settled").alias("settled")).where("NOT settled").select("u", F.col("v").alias("rep"))
        members = scratch.keep(met.join(apart, ["u", "rep"], "left_semi").select("key", "rep", "degree"), f"left{turn}")
        sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        members = members.join(sizes, "key")
        if turn < TURNS - 1:
            members = members.select("key", "rep", "degree")
    blocks = F.ceil(F.col("size") / LEFT_BLOCK).cast("int")
    rest = members.select("key", "rep", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own")).join(sig, "rep")
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "rep", "sig")
    near = near.unionByName(rest.groupBy("key", "a", "b").applyInArrow(_alike_in_blocks(loose), "u long, v long"))
    near = scratch.keep(near.where("u != v").distinct(), "near")

    # Groups, their blocks, and the exact comparison of all of a group's texts.
    labels = components(scratch, near, "groups")
    labels = labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())
    placed = scratch.keep(labels.join(reps.groupBy(F.col("rep").alias("node")).agg(F.sum("n").alias("n")), "node"), "placed")
    size = placed.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    block = F.greatest(F.least(F.col("texts") / MOST_BLOCKS, F.lit(float(LARGE_BLOCK))), F.lit(float(BLOCK)))
    blocks = F.greatest(F.ceil(F.col("texts") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    dealt = placed.join(size.select("component", blocks.alias("blocks")), "component")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    few = placed.count() <= BROADCAST_ROWS
    held = texts.where("doc_id IS NOT NULL").join(F.broadcast(dealt) if few else dealt, F.col("doc_id") == F.col("node")).select("component", "node", "blocks", "own", "text")
    held = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    held = held.select("component", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "text")

    def compare(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        found = links(nodes, shingle_sets(table.column("text").combine_chunks(), words), percent)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    confirmed = scratch.keep(held.groupBy("component", "a", "b").applyInArrow(compare, "u long, v long"), "links")
    # A document with several texts links what they are linked with.
    many = sets.groupBy("doc_id").agg(F.count_distinct("digest").alias("texts")).where("texts > 1").select("doc_id")
    same = sets.join(many, "doc_id", "left_semi").select("doc_id", "digest").distinct().join(first, "digest").where("doc_id != rep")
    confirmed = confirmed.unionByName(same.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    final = components(scratch, confirmed, "components")

    of_rep = first.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n", "digest").join(of_rep, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows whose document is in a component with a lesser doc_id."""
    scratch = Scratch(docs.sparkSession, "near-dedup-removed")
    removed = near_duplicates(docs, words, percent).where("NOT kept").select(F.col("doc_id").alias("__removed")).distinct()
    removed = scratch.keep(removed, "removed")
    few = removed.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(removed) if few else removed, F.col("doc_id").cast("long") == removed["__removed"], "left_anti")


def oracle(words: int, percent: int) -> str:
    """The same in DuckDB's SQL, by comparing all pairs that share a shingle. For small tables."""
    joined = " || ' ' || ".join(f"w[k + {i}]" for i in range(words))
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda k: {joined}) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.b, d.doc_id) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id"""
