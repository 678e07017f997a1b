"""Approximate nearest neighbours by a graph from NN-descent and greedy search in it.

Nearness is the largest inner product. Equal vectors are one vertex. Vertices fall
into shells by norm, each from a power of two to the next, and each shell has a graph
of its own: there, a vector x becomes x / m with one more component, the root of
1 - |x / m|^2, where m is the shell's upper bound, so that all have length one, a
larger inner product is a smaller distance, and no vector of another norm, however
large, takes away from the others' precision.

A shell is dealt by a hash of its vertices to shards of at most SHARD, each with a graph
of its own, which one task builds and searches in arrays: the vectors move once to the
build and once to the search, however many rounds and steps there are.

Build: blocks of neighbours in a few random orders give a first graph. In each
round, the neighbours of a vertex, those it points to and a bounded sample of
those that point to it, meet: pairs of them, one new since the last round, are
candidates for one another, and a vertex keeps the best of its neighbours. Rounds
end when few edges change.

Search: a beam of the best vertices for each query and shard, from the query's own
vertex if it has one and from the nearest of a fixed number of entries. The
best vertices not yet expanded are looked up in the graph, their neighbours are
scored, and the beam keeps the best, until all in it are expanded. A shell whose
bound on any product is below what a query has found among the shells' entries is
left out for it. The rows behind the vertices found are ranked by the exact product of
the original vectors; those that no rounding of half floats can bring among the
nearest are left out before.

How wide a beam must be depends on the vectors, not only on their number. So each
run compares a bounded sample of its own queries with brute force: as long as their
recall is below TARGET, beams get wider and go on from where they are, in the end to
all vertices; then all queries are searched by those beams. What is scored for a query thus stays as it is where
data grow and stay as easy, and grows where they are hard, as uniform ones are.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part, as query or candidate, nor do rows whose id is null; a vector shorter
than the longest counts as one that ends in zeros; of rows that share an id the
least vector counts; equal vectors are found together, ties go to the smaller id;
with fewer candidates than asked for, a query gets all there are; an empty table
gives no rows; other columns are ignored. Products beyond the range of doubles are
infinite, and ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

NEIGHBOURS = 32
#: Of the vertices that point to one, those that take part in a round or are added to the final graph.
REVERSE = 20
#: Candidates that one meeting gives a vertex, where meetings give many.
OFFERS = 12
ORDERS, ORDER_BLOCK, SIGNS = 4, 512, 12
#: Rounds end at FEW_CHANGES; MAX_ROUNDS only keeps a build that doesn't settle from going on for ever.
MAX_ROUNDS, FEW_CHANGES = 30, 0.03
#: The first beam, over all shards, by what it grows, and how many of it are expanded in a step.
BEAM, WIDER, WIDTH = 128, 1.6, 128
#: Vertices of a shell among which each query's first ones are looked for, and how many of them it gets.
ENTRIES, ENTER = 256, 4
#: Vertices of a shard, at most and, so that all cores have some, at least. Numbers in a shard have 16 bits.
SHARD, LEAST_SHARD = 49_152, 8192
#: Vertices in a row of a stored graph; of those whose neighbours meet at once; offers held before they are merged.
PIECE, MEETING, HELD = 4096, 512, 8_000_000
#: Queries compared with brute force, and the recall at which beams grow no more.
SAMPLE, TARGET = 200, 0.95


def _rank(by: str, *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(by).orderBy(*order))


def _matrix(column: pa.Array, kind: str = "<f2") -> np.ndarray:
    """Vectors of one length, from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _clean(kind: str):
    """id and bytes of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if i is not None and v and None not in v:
                    x = np.array(v, dtype=kind) + np.zeros(1, kind)  # no negative zero
                    if np.isfinite(x).all() and x.any():
                        rows.append((i, x.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary()))], names=["id", "vector"])

    return run


_EMPTY = np.uint64(0xFFFF_FFFF_FFFF_FFFF)
_NONE = 0xFFFF


def _places(keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys, from 0."""
    first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    at = np.flatnonzero(first)
    return np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))


def _packed(node: np.ndarray, nbr: np.ndarray, sim: np.ndarray) -> np.ndarray:
    """Edges as numbers that sort by vertex, from the best, and then by neighbour."""
    far = np.clip((1.01 - sim) * (1 << 20), 0, (1 << 30) - 1).astype(np.uint64)
    return (node.astype(np.uint64) << np.uint64(48)) | (far << np.uint64(16)) | nbr.astype(np.uint64)


def _firsts(keys: np.ndarray, n: int, width: int) -> np.ndarray:
    """A row for each vertex with the first ``width`` of its sorted numbers."""
    node = (keys >> np.uint64(48)).astype(np.int64)
    place = _places(node)
    fits = place < width
    out = np.full((n, width), _EMPTY)
    out[node[fits], place[fits]] = keys[fits]
    return out


def _nbr(edges: np.ndarray) -> np.ndarray:
    return (edges & np.uint64(_NONE)).astype(np.int64)


def _merged(edges: np.ndarray, offers: list[np.ndarray]) -> np.ndarray:
    """The best edges of each vertex of those it has and those offered."""
    n, width = edges.shape
    keys = np.concatenate([edges[edges != _EMPTY], *offers])
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
    rows = _firsts(keys, n, 2 * width)  # the product of a pair may differ in its last bit, so it is there twice at most
    nbr = _nbr(rows)
    order = np.argsort(nbr, axis=1, kind="stable")
    nbr = np.take_along_axis(nbr, order, 1)
    row, column = np.nonzero((nbr[:, 1:] == nbr[:, :-1]) & (nbr[:, 1:] != _NONE))
    rows[row, order[row, column + 1]] = _EMPTY
    rows.sort(axis=1)
    return np.ascontiguousarray(rows[:, :width])


def _first_graph(x: np.ndarray, width: int) -> np.ndarray:
    """Each vertex' best in its blocks of some orders by which like vectors come near one another."""
    n, edges = len(x), np.full((len(x), width), _EMPTY)
    blocks = max(1, n // ORDER_BLOCK)
    cuts = [n * k // blocks for k in range(blocks + 1)]
    for number in range(ORDERS):
        planes = np.random.default_rng((number, 1)).standard_normal((x.shape[1], SIGNS + 1)).astype(np.float32)
        at = x @ planes
        order = np.lexsort((at[:, SIGNS], (at[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS))))
        offers = []
        for first, end in zip(cuts, cuts[1:], strict=False):
            node = order[first:end]
            if len(node) > 1:
                sims = x[node] @ x[node].T
                np.fill_diagonal(sims, -np.inf)
                k = min(width, len(node) - 1)
                best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                offers.append(_packed(np.repeat(node, k), node[best].ravel(), np.take_along_axis(sims, best, 1).ravel()))
        edges = _merged(edges, offers)
    return edges


def _members(edges: np.ndarray, new: np.ndarray, back: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Who meets at each vertex, _NONE where nobody does, and who is new there. One met both ways is new if either way is."""
    n, width = edges.shape
    node, column = np.nonzero(edges != _EMPTY)
    fresh = new[node, column]
    chance = rng.integers(0, 1 << 31, len(node), dtype=np.uint64) | (np.uint64(1 << 31) * (~fresh).astype(np.uint64))
    keys = (_nbr(edges[node, column]).astype(np.uint64) << np.uint64(48)) | (chance << np.uint64(16)) | node.astype(np.uint64)
    keys.sort()
    behind = _firsts(keys, n, back)
    old = np.concatenate([~new, (behind >> np.uint64(47)) & np.uint64(1) == 1], axis=1)
    met = np.sort(2 * np.concatenate([_nbr(edges), _nbr(behind)], axis=1) + old, axis=1)
    who, fresh = met >> 1, met & 1 == 0
    again = who[:, 1:] == who[:, :-1]
    who[:, 1:][again] = _NONE
    return who, fresh & (who != _NONE)


def _descend(x: np.ndarray, width: int, back: int, most: int) -> np.ndarray:
    """The graph of one shard by NN-descent: the best neighbours of each vertex, packed."""
    n, rng = len(x), np.random.default_rng(len(x))
    edges = _first_graph(x, width)
    new, total = edges != _EMPTY, max(1, int((edges != _EMPTY).sum()))
    for _ in range(MAX_ROUNDS):
        who, fresh = _members(edges, new, back, rng)
        before = np.sort((np.arange(n)[:, None] << 16 | _nbr(edges))[edges != _EMPTY])
        offers, held = [], 0
        meeting = np.flatnonzero(fresh.any(axis=1))
        diagonal = np.arange(who.shape[1])

        def worst() -> np.ndarray:
            last = edges[:, -1]
            return np.where(last == _EMPTY, -np.inf, 1.01 - ((last >> np.uint64(16)) & np.uint64(0xFFFF_FFFF)).astype(np.float64) / (1 << 20)).astype(np.float32)

        least = worst()
        for a in range(0, len(meeting), MEETING):
            rows = meeting[a : a + MEETING]
            m, f = who[rows], fresh[rows]
            there = m != _NONE
            m = np.where(there, m, 0)
            xs = x[m]
            sims = xs @ xs.transpose(0, 2, 1)
            fits = sims > np.where(there, least[m], np.inf)[:, :, None]
            fits &= f[:, :, None] | f[:, None, :]
            fits &= there[:, None, :]
            fits[:, diagonal, diagonal] = False
            if np.count_nonzero(fits) > most * m.size and most < m.shape[1]:
                sims[~fits] = -np.inf
                kept = np.argpartition(-sims, most - 1, axis=2)[:, :, :most]
                i, j, c = np.nonzero(np.isfinite(np.take_along_axis(sims, kept, 2)))
                o = kept[i, j, c]
            else:
                i, j, o = np.nonzero(fits)
            offers.append(_packed(m[i, j], m[i, o], sims[i, j, o]))
            held += len(i)
            if held > HELD:
                edges, offers, held = _merged(edges, offers), [], 0
                least = worst()
        edges = _merged(edges, offers)
        pairs = np.arange(n)[:, None] << 16 | _nbr(edges)
        at = np.minimum(np.searchsorted(before, pairs), max(0, len(before) - 1))
        new = (edges != _EMPTY) & (before[at] != pairs if len(before) else True)
        if new.sum() <= FEW_CHANGES * total:
            break
    return edges


_GRAPH = "shard int, piece int, nodes binary, x binary, nbrs binary"


def _built(width: int, back: int, most: int):
    """Rows of a shard's graph: its vertices by number, their vectors and neighbours, _NONE where there are no more."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        node, half = table.column("node").to_numpy(), _matrix(table.column("x").combine_chunks())
        edges = _descend(half.astype(np.float32), width, back, most)
        row, column = np.nonzero(edges != _EMPTY)
        packed = edges[row, column]
        behind = (_nbr(packed).astype(np.uint64) << np.uint64(48)) | (packed & np.uint64(0xFFFF_FFFF_0000)) | row.astype(np.uint64)
        behind.sort()
        nbrs = np.concatenate([_nbr(edges), _nbr(_firsts(behind, len(node), back))], axis=1).astype("<u2")
        at = range(0, len(node), PIECE)
        columns = [[c[a : a + PIECE].tobytes() for a in at] for c in (node.astype("<i8"), half, nbrs)]
        shard = table.column("shard")[0].as_py()
        return pa.table([pa.array([shard] * len(at), pa.int32()), pa.array(range(len(at)), pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "piece", "nodes", "x", "nbrs"])

    return run


def _shards(points: DataFrame) -> list[tuple[int, int, int]]:
    """Of each shell its number, its first shard and how many it has."""
    counts = sorted((r.shell, r["n"]) for r in points.groupBy("shell").agg(F.count("*").alias("n")).collect())  # few shells
    cores = points.sparkSession.sparkContext.defaultParallelism
    total = sum(n for _, n in counts)
    if total > SHARD * cores:  # as many for each core
        size = -(-total // (cores * -(-total // (SHARD * cores))))
    else:
        size = min(SHARD, max(LEAST_SHARD, -(-total // cores)))
    out, first = [], 0
    for shell, n in counts:
        out.append((shell, first, -(-n // size)))
        first += out[-1][2]
    return out


def _apart(df: DataFrame, shards: int) -> DataFrame:
    """Each shard in one partition and, as ranges are guessed from samples, more ranges than shards, so that each has its own."""
    if shards == 1:
        return df.repartition(1)
    return df.repartitionByRange(min(3 * shards, max(shards, 4 * df.sparkSession.sparkContext.defaultParallelism)), "shard")


def build(scratch: Scratch, points: DataFrame, dims: int) -> DataFrame:
    """The graphs of all shards, each vertex' best neighbours found in its shard and some of those it is one of.

    ``points``: ``node``, ``shell`` and ``x``, the bytes of a vector of ``dims`` components and length one as half floats.
    """
    shards = _shards(points)
    if not shards:
        return scratch.spark.createDataFrame([], _GRAPH)
    table = F.broadcast(scratch.spark.createDataFrame(shards, "shell int, first int, n int"))
    dealt = points.join(table, "shell").select((F.col("first") + F.pmod(F.xxhash64("node"), "n")).cast("int").alias("shard"), "node", "x")
    dealt = _apart(dealt, shards[-1][1] + shards[-1][2])
    return scratch.keep(dealt.groupBy("shard").applyInArrow(_built(NEIGHBOURS, REVERSE, OFFERS), _GRAPH), "graph")


def _scale(shells: np.ndarray, top: int) -> np.ndarray:
    """What makes products of vectors scaled by their shells comparable."""
    return np.ldexp(1.0, np.maximum(shells - top, -1060))


def _sampled(sample: list, top: int, k: int):
    """The k-th largest products of the sampled queries: each task gives its best ones. ``sample``: query and bytes."""
    xq = np.stack([np.frombuffer(r.x, "<f2") for r in sample]).astype(np.float32)
    queries = np.array([r["query"] for r in sample])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(queries), 0))
        for batch in batches:
            if batch.num_rows:
                sims = (xq @ _matrix(batch.column(1)).astype(np.float32).T) * _scale(batch.column(0).to_numpy(), top)
                best = np.concatenate([best, sims], axis=1)
                if best.shape[1] > k:
                    best = -np.partition(-best, k - 1, axis=1)[:, :k]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(queries, best.shape[1])), pa.array(best.ravel())], names=["query", "sim"])

    return run


class _Graph:
    """A shard while it is searched."""

    def __init__(self, pieces: list[dict]):
        pieces = sorted(pieces, key=lambda r: r["piece"])
        self.node = np.concatenate([np.frombuffer(r["nodes"], "<i8") for r in pieces])
        n = len(self.node)
        self.x = np.frombuffer(b"".join(r["x"] for r in pieces), "<f2").reshape(n, -1).astype(np.float32)
        self.nbrs = np.frombuffer(b"".join(r["nbrs"] for r in pieces), "<u2").reshape(n, -1).astype(np.int32)
        self.nbrs[self.nbrs == _NONE] = n
        self.seen, self.stamp = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=np.int32)
        self.seen[n] = True  # stands for no neighbour
        self.entries = np.random.default_rng(n).permutation(n)

    def start(self, q: np.ndarray, own: int | None, entries: int) -> np.ndarray:
        some = self.entries[:entries]
        best = some[np.argsort(-(self.x[some] @ q), kind="stable")[:ENTER]]
        if own is not None:
            at = int(np.searchsorted(self.node, own))
            if at < len(self.node) and self.node[at] == own and at not in best:
                best = np.append(best, at)
        return best

    def walk(self, q: np.ndarray, start: np.ndarray, beams: list[int], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """After each of the beams, the vertices seen and their products; a wider beam goes on from where the last one was."""
        ids, sims = start, self.x[start] @ q
        expanded = np.zeros(len(ids), dtype=bool)
        seen, stamp = self.seen, self.stamp
        seen[ids] = True
        try:
            for beam in beams:
                if beam >= len(self.x):  # all take part, also those no edge leads to
                    near = np.flatnonzero(~seen)
                    seen[near] = True
                    ids, sims = np.concatenate([ids, near]), np.concatenate([sims, self.x[near] @ q])
                    yield ids, sims
                    continue
                while True:
                    best = np.argpartition(-sims, beam - 1)[:beam] if len(ids) > beam else np.arange(len(ids))
                    best = best[~expanded[best]]
                    if not len(best):
                        break
                    if len(best) > width:
                        best = best[np.argpartition(-sims[best], width - 1)[:width]]
                    expanded[best] = True
                    near = self.nbrs[ids[best]].ravel()
                    near = near[~seen[near]]
                    order = np.arange(len(near), dtype=np.int32)
                    stamp[near] = order
                    near = near[stamp[near] == order]
                    seen[near] = True
                    ids, sims = np.concatenate([ids, near]), np.concatenate([sims, self.x[near] @ q])
                    expanded = np.concatenate([expanded, np.zeros(len(near), dtype=bool)])
                yield ids, sims
        finally:
            seen[ids] = False


def _in_shards(job):
    """Run ``job`` on each shard's graph and the queries for it, batch by batch. Rows come sorted by shard and with the graph first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pieces, graph = None, [], None
        for batch in batches:
            shards, kinds = (batch.column(k).to_numpy() for k in (0, 1))
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                if kinds[a] == 0:
                    if shard != shards[a]:
                        shard, pieces, graph = shards[a], [], None
                    pieces += rows.to_pylist()
                else:
                    if graph is None:
                        graph, pieces = _Graph(pieces), []
                    yield from job(graph, rows)

    return run


def _trial(beams: list[int], width: int, entries: int, top: int):
    """Of the sampled queries' nearest, how many the shard's walk has found after each beam. ``bound``: the least product of them."""

    def job(graph: _Graph, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        xq = _matrix(rows.column("x")).astype(np.float32)
        factor = _scale(rows.column("shell").to_numpy(), top)
        for q, query, own, bound, scale in zip(xq, *(rows.column(c).to_pylist() for c in ("query", "own", "bound")), factor, strict=True):
            enough = lambda sims: int((sims * scale >= bound - 1e-5 * abs(bound)).sum())  # noqa: E731, B023
            all_ = enough(graph.x @ q)
            hits = 0
            walk = graph.walk(q, graph.start(q, own, entries), beams, width)
            for turn in range(len(beams)):
                if hits < all_:
                    hits = enough(next(walk)[1])
                out.append((query, turn, hits))
            walk.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64()))], names=["query", "turn", "hits"])

    return _in_shards(job)


def _finds(beams: list[int], width: int, entries: int, top: int, k: int, error: float):
    """Of each shard those that may be among a query's ``k`` nearest, with what rounding may have done to their products."""

    def job(graph: _Graph, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        xq = _matrix(rows.column("x")).astype(np.float32)
        factor = _scale(rows.column("shell").to_numpy(), top)
        queries, nodes, found = [], [], []
        for q, own in zip(xq, rows.column("own").to_pylist(), strict=True):
            for ids, sims in graph.walk(q, graph.start(q, own, entries), beams, width):
                pass
            if len(sims) > k:
                kept = np.flatnonzero(sims >= -np.partition(-sims, k - 1)[k - 1] - 2 * error)
                if len(kept) > k + DOUBT:
                    kept = kept[np.argpartition(-sims[kept], k + DOUBT - 1)[: k + DOUBT]]
                ids, sims = ids[kept], sims[kept]
            nodes.append(graph.node[ids])
            found.append(sims)
        sizes = [len(f) for f in found]
        scale = np.repeat(factor, sizes)
        sims = np.concatenate(found) * scale
        columns = [pa.array(np.repeat(rows.column("query").to_numpy(), sizes)), pa.array(np.concatenate(nodes)), pa.array(sims), pa.array(error * scale)]
        yield pa.RecordBatch.from_arrays(columns, names=["query", "node", "sim", "error"])

    return _in_shards(job)


def search(scratch: Scratch, graph: DataFrame, points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query``, ``node`` for the vertices found for each query, its ``k`` nearest among them where they were reached.

    ``queries``: ``query``, ``x`` and ``own``, its vertex or null. ``sim`` is their product, which may be off by ``error``.
    """
    found = "query long, node long, sim double, error double"
    shards = _shards(points)
    sample = queries.select("query", "x").orderBy(F.xxhash64("query"), "query").limit(SAMPLE).collect()
    if not sample or not shards:
        return scratch.spark.createDataFrame([], found)
    least, top = shards[0][0], shards[-1][0]
    # Half floats change a vector of length one by 2^-11; where doubles overflow or vanish, products tie that differ here.
    error = 1.1e-3 if -1000 < 2 * least and 2 * top < 1020 else float("inf")
    all_ = [(shell, first + j) for shell, first, n in shards for j in range(n)]
    count, width, entries = len(all_), WIDTH, ENTRIES
    where = F.broadcast(scratch.spark.createDataFrame([(shell, shard, float(_scale(np.array([shell]), top)[0])) for shell, shard in all_], "shell int, shard int, most double"))

    bounded = queries.select("query", "x", "own", F.lit(float("-inf")).alias("floor"))
    if len(shards) > 1:
        ranked = points.withColumn("r", F.row_number().over(Window.partitionBy("shell", F.pmod(F.xxhash64("node"), F.lit(entries))).orderBy("node")))
        known = ranked.where("r = 1").select("shell", "x").collect()  # ENTRIES a shell, and there are few shells
        x, factor = np.stack([np.frombuffer(r.x, "<f2") for r in known]).astype(np.float32), _scale(np.array([r.shell for r in known]), top)

        def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """What at least k vertices reach."""
            for batch in batches:
                if batch.num_rows:
                    sims = (_matrix(batch.column(1)).astype(np.float32) @ x.T) * factor
                    floor = -np.partition(-sims, k - 1, axis=1)[:, k - 1] if len(x) >= k else np.full(len(sims), -np.inf)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor.astype(np.float64))], names=["query", "x", "own", "floor"])

        bounded = queries.select("query", "x", "own").mapInArrow(floors, "query long, x binary, own long, floor double")
        bounded = scratch.keep(bounded, "bounded")

    nothing = {"nodes": "binary", "nbrs": "binary", "piece": "int", "query": "long", "own": "long", "bound": "double", "shell": "int"}
    order = ["shard", "kind", "piece", "nodes", "x", "nbrs", "query", "own", "bound", "shell"]

    def met(asking: DataFrame) -> DataFrame:
        """Each shard's graph and then the queries for it."""
        asking = asking.crossJoin(where).where((F.col("floor") < F.col("most") * 1.01) | F.lit(error == float("inf"))).withColumn("kind", F.lit(1))
        have = graph.withColumn("kind", F.lit(0))
        full = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(nothing[c]).alias(c) for c in order))
        both = full(have).unionByName(full(asking))
        return _apart(both, count).sortWithinPartitions("shard", "kind")

    exact = points.select("shell", "x").mapInArrow(_sampled(sample, top, k), "query long, sim double")
    exact = exact.withColumn("r", _rank("query", F.desc("sim"))).where(F.col("r") <= k).groupBy("query").agg(F.min("sim").alias("bound"), F.count("*").alias("want"))
    exact = scratch.keep(exact, "exact")  # a row for each of the sample
    # A query has a beam in each shard, so the first one is dealt over those of the shell that has most.
    beams, largest = [max(2, BEAM // max(n for _, _, n in shards))], points.count()
    while beams[-1] < largest:
        beams.append(int(WIDER * beams[-1] + 0.5))
    tried = met(bounded.join(F.broadcast(exact), "query")).mapInArrow(_trial(beams, width, entries, top), "query long, turn int, hits long")
    tried = tried.groupBy("query", "turn").agg(F.sum("hits").alias("hits")).join(F.broadcast(exact), "query")
    recall = {r.turn: r.recall for r in tried.groupBy("turn").agg(F.avg(F.least("hits", "want") / F.col("want")).alias("recall")).collect()}
    turn = next((t for t in range(len(beams)) if recall.get(t, 0.0) >= TARGET), len(beams) - 1)
    return met(bounded).mapInArrow(_finds(beams[: turn + 1], width, entries, top, k, error), found)


def _shells(kind: str):
    """node, shell and scaled vector. The shell of s holds norms from 2^(s - 1) up to 2^s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scaled, shell = _scaled(_matrix(batch.column(1), kind).astype(np.float64))
                x = np.column_stack([scaled, np.sqrt(np.maximum(1 - (scaled * scaled).sum(axis=1), 0))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shell.astype(np.int32)), pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary())], names=["node", "shell", "x"])

    return run


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors scaled by powers of two to a norm from a half to one, and the powers. No square overflows or vanishes."""
    _, most = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -most[:, None])
    _, more = np.frexp(np.sqrt((x * x).sum(axis=1)))
    return np.ldexp(x, -more[:, None]), most + more


def _as_queries(kind: str):
    """Queries of length one with 0 as the added component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _ = _scaled(_matrix(batch.column(1), kind).astype(np.float64))
                x = np.column_stack([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros(len(x))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype("<f2")], pa.binary())], names=["query", "x"])

    return run


def _exact(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                with np.errstate(over="ignore", invalid="ignore"):
                    score = np.einsum("ij,ij->i", *(_matrix(batch.column(k), kind).astype(np.float64) for k in (2, 3)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["query", "node", "score"])

    return run


#: Vertices found for a query that are compared by their original vectors, beyond those it asks for: half floats leave some in doubt.
DOUBT = 64


def nearest(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The ``k`` nearest rows found for each row for which ``is_query`` holds, itself left out.

    ``vectors``: ``vec_id`` and ``embedding``. Columns: query_id, rank, vec_id, score.
    """
    scratch = Scratch(vectors.sparkSession, "ann")
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # kept as it is, else as doubles
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    of = F.col("embedding") if single else F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), of.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    kept = rows.select("id", "v").mapInArrow(_clean(kind), "id long, vector binary")
    kept = scratch.keep(kept.groupBy("id").agg(F.min("vector").alias("vector")), "kept")
    shape = kept.agg(F.min(F.octet_length("vector")).alias("least"), F.max(F.octet_length("vector")).alias("most")).first()
    if shape.most is None:
        return scratch.spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape.least < shape.most:
        zero = F.lit(bytes(width))
        kept = scratch.keep(kept.withColumn("vector", F.rpad("vector", shape.most, zero)), "padded")

    # A vertex is a distinct vector, by its least id, with the k + 1 least ids that have it.
    nodes = scratch.keep(kept.groupBy("vector").agg(F.min("id").alias("node"), F.count("*").alias("n")), "nodes")
    several, own = nodes.where("n > 1").select("vector", "node"), nodes.where("n = 1").select("node", F.col("node").alias("id"))
    owners, members = own, own
    if not several.isEmpty():  # else no vector has to be moved for it
        copies = scratch.keep(kept.join(several, "vector").select("node", "id"), "copies")
        least = copies.withColumn("r", _rank("node", F.col("id"))).where(F.col("r") <= k + 1)
        owners, members = own.unionByName(copies), own.unionByName(least.select("node", "id"))
    scratch.drop("kept", "padded")
    points = scratch.keep(nodes.select("node", "vector").mapInArrow(_shells(kind), "node long, shell int, x binary"), "points")
    graph = build(scratch, points, shape.most // width + 1)

    asking = owners.join(rows.where("asks").select("id").distinct(), "id", "left_semi").select("id", "node")
    asking = scratch.keep(asking, "asking")
    sources = nodes.join(asking.select("node").distinct(), "node", "left_semi")
    queries = sources.select("node", "vector").mapInArrow(_as_queries(kind), "query long, x binary").withColumn("own", F.col("query"))
    found = search(scratch, graph, points, scratch.keep(queries, "queries"), k + 1)
    low = F.col("sim") - F.col("error")
    found = found.withColumn("r", _rank("query", F.desc("sim"), F.col("node"))).withColumn("low", F.when(_rank("query", low.desc()) == k + 1, low))
    found = found.withColumn("low", F.max("low").over(Window.partitionBy("query")))
    found = found.where((F.col("r") <= k + 1 + DOUBT) & (F.col("low").isNull() | (F.col("sim") + F.col("error") >= F.col("low"))))

    original = nodes.select("node", "vector")
    pairs = found.select("query", "node").join(original.withColumnRenamed("vector", "vn"), "node").join(original.select(F.col("node").alias("query"), F.col("vector").alias("vq")), "query")
    exact = pairs.select("query", "node", "vq", "vn").mapInArrow(_exact(kind), "query long, node long, score double")
    # A vertex' least id is its number, so the k + 1 best rows are among the rows of the k + 1 best vertices.
    best = exact.withColumn("r", _rank("query", F.desc("score"), F.col("node"))).where(F.col("r") <= k + 1).drop("r")
    ranked = best.join(members, "node").withColumn("r", _rank("query", F.desc("score"), F.col("id"))).where(F.col("r") <= k + 1)
    ranked = scratch.keep(ranked.select(F.col("query").alias("node"), F.col("id").alias("vec_id"), "score"), "ranked")
    each = asking.withColumnRenamed("id", "query_id").join(ranked, "node").where("query_id != vec_id")
    each = each.withColumn("rank", _rank("query_id", F.desc("score"), F.col("vec_id"))).where(F.col("rank") <= k)
    return each.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
