"""Near duplicates, components, fingerprints and nearest neighbours against plain versions."""

import hashlib
import random
import re
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from ashlar.llm import ann, near_dedup, syncmers
from ashlar.llm.components import components
from ashlar.llm.scratch import Scratch

from . import helpers
from .helpers import FOLDER, documents


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)] + [(200, k) for k in range(201, 240)] + [(7, None)]
    found = components(Scratch(spark, "t"), spark.createDataFrame(edges, "u long, v long")).collect()
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    assert {r.node: r.component for r in found} == {x: root(x) for x in parent if root(x) != x}
    assert components(Scratch(spark, "t"), spark.createDataFrame([], "u long, v long")).collect() == []


def check_near(spark, docs, words, percent):
    rows = near_dedup.near_duplicates(docs, words, percent).collect()
    plain = helpers.components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == plain
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return rows


def test_near_duplicates_of_the_corpus(spark):
    check_near(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), 3, 85)


def test_a_dense_group_of_near_copies(spark, monkeypatch):
    """Copies of one text with more and fewer edits, around the threshold; the group takes several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    rng = random.Random(1)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randrange(0, 11)):
            words[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(500 + k, rows[3][1]) for k in range(60)]
    rng.shuffle(rows)
    check_near(spark, documents(spark, *rows), 3, 85)


def test_templates_form_no_group(spark, monkeypatch):
    """1,500 texts that share half their shingles, and 60 pairs among them that are near copies: all pairs found, no large group."""
    rng = random.Random(4)
    template = [f"t{k}" for k in range(80)]
    rows = [(k, " ".join(template + [f"w{rng.randrange(10**6)}" for _ in range(40)])) for k in range(1500)]
    for k in range(60):
        words = rows[k][1].split()
        words[rng.randrange(85, 118)] = "edited"
        rows.append((2000 + k, " ".join(words)))
    rng.shuffle(rows)
    seen, original = [], near_dedup.components
    monkeypatch.setattr(near_dedup, "components", lambda scratch, edges, name: seen.append((name, original(scratch, edges, name))) or seen[-1][1])
    out = check_near(spark, documents(spark, *rows), 3, 85)
    assert sum(not r.kept for r in out) == 60
    (groups,) = [df for name, df in seen if name == "groups"]
    assert groups.groupBy("component").count().agg(F.max("count")).first()[0] < 20


def test_a_large_bucket_loses_no_link(spark, monkeypatch):
    """Where all texts share one bucket only and no two are near but 30 pairs of near copies, all of these are found, in blocks."""
    signed = near_dedup._sign

    def in_one_bucket(words):
        run = signed(words)

        def all_alike(batches):
            for batch in run(batches):
                yield batch.set_column(3, "bands", pa.array([[7]] * batch.num_rows, pa.list_(pa.int64())))

        return all_alike

    monkeypatch.setattr(near_dedup, "_sign", in_one_bucket)
    monkeypatch.setattr(near_dedup, "LEFT_BLOCK", 64, raising=False)
    rng = random.Random(8)
    rows = [(k, [f"w{rng.randrange(400)}" for _ in range(150)]) for k in range(300)]
    rows += [(10_000 + k, [*rows[k][1][:-5], *(f"e{k}x{i}" for i in range(5))]) for k in range(30)]
    found = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, *[(k, " ".join(text)) for k, text in rows]), 3, 85).collect()}
    assert found == {k: k % 10_000 for k, _ in rows}


def test_one_document_with_several_texts(spark):
    a, b, c = ("a b c d e f g", "p q r s t u v", "h i j k l m n")
    docs = documents(spark, (1, a), (2, a), (2, b), (3, b), (4, c), (4, a + " z"), (5, c), (6, "x y z w"))
    rows = near_dedup.near_duplicates(docs, 3, 80).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in rows) == [(1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 1, False), (4, 1, False), (5, 1, False), (6, 6, True)]


def test_near_duplicates_of_odd_texts(spark):
    docs = documents(spark, (1, None), (2, ""), (3, "A b"), (4, "a  B\n"), (None, "a b"), (None, None), (5, "x " * 9000), (6, "X " * 9000), (7, "q w e r"), (7, "q w e r"))
    rows = near_dedup.near_duplicates(docs, 3, 85).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows) == [(0, 0, 0, True), (0, 1, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 7, True), (7, 2, 7, True)]
    assert near_dedup.near_duplicates(docs.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in near_dedup.without_near_duplicates(docs, 3, 85).collect()) == [0, 0, 1, 2, 3, 5, 7, 7]


def test_joins_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = documents(spark, *[(k, "a b c d e f " + ("z" if k % 2 else "y")) for k in range(40)])
    few = sorted(tuple(r) for r in near_dedup.near_duplicates(docs, 3, 60).collect())
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", -1)
    assert sorted(tuple(r) for r in near_dedup.near_duplicates(docs, 3, 60).collect()) == few
    assert near_dedup.without_near_duplicates(docs, 3, 60).count() == len({r[2] for r in few})


def xx(value, seed):
    """The hash that DataFrame functions give: of a string's bytes or a long, after what was hashed before it."""
    data = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)))[0]


def chained(values):
    out = 42
    for v in values:
        out = xx(v, out)
    return out


def plain_anchors(text):
    """Anchors of a text, run by run."""
    hashes = [xx(w, 42) for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    if len(hashes) < 3:
        return [chained(hashes)] if hashes else []
    return [chained(run) for run in zip(hashes, hashes[1:], hashes[2:], strict=False) if min(run) in (run[0], run[2])]


def plain_likeness(a, b):
    union = set(a) | set(b)
    if not union:
        return 1.0
    both = set(a) & set(b)
    first = [[x for x in dict.fromkeys(side) if x in both] for side in (a, b)]
    before = [dict(zip(side[1:], side, strict=False)) for side in first]
    return (sum(before[0].get(x) == before[1].get(x) for x in both if x in before[0] and x in before[1]) + bool(both)) / len(union)


def as_hex(prints):
    return "".join(f"{x & (1 << 64) - 1:016x}" for x in prints)


def check_prints(rows, texts):
    """Every column against the plain version."""
    for r, k in zip(rows, range(len(texts)), strict=True):
        text, following = texts[k], texts[(k + 1) % len(texts)]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        prints = [plain_anchors(t) for t in (text, edited, following)]
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(prints[0]), as_hex(prints[1]))
        assert (r.near_edited, r.near_next) == (plain_likeness(prints[0], prints[1]), plain_likeness(prints[0], prints[2]))


def test_a_moved_passage_breaks_the_order_at_its_ends(spark):
    words = [f"w{k}" for k in range(400)]
    moved = words[300:340] + words[:300] + words[340:]
    texts = [" ".join(w) for w in (words, moved, words[::-1])]
    rows = syncmers.fingerprints(documents(spark, *enumerate(texts))).orderBy("doc_id").collect()
    check_prints(rows, texts)
    assert rows[0].near_next > 0.9 and rows[1].near_next < 0.1


def test_fingerprints(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = syncmers.fingerprints(docs).orderBy("doc_id").collect()
    check_prints(rows, [r.text for r in docs.orderBy("doc_id").collect()])
    by = {}
    for r, d in zip(rows, docs.orderBy("doc_id").collect(), strict=True):
        assert by.setdefault(d.text, r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in rows]) > 0.25 > 0.05 > np.mean([r.near_next for r in rows if r.near_next < 1])


def test_fingerprints_with_more_buckets_than_rows(spark):
    texts = ["é" * 5 + " x y z", "", "one two three four", "one two three four", "😀 b", "m n o p q r s"]
    rows = syncmers.fingerprints(documents(spark, *[(k * k * k, t) for k, t in enumerate(texts)]).repartition(3)).orderBy("doc_id").collect()
    check_prints(rows, texts)
    assert rows[2].near_next == 1.0 and rows[1].fingerprint == "" and rows[1].near_edited == 1.0 and rows[1].near_next == 0.0
    assert len(rows[4].fingerprint) == 16  # fewer words than a run


def test_closed_syncmers_by_hand(spark):
    """A run is chosen exactly if its minimal word by hash is at an end."""
    words = [f"w{k}" for k in range(60)]
    hashes = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w").alias("h")).collect()]
    chosen = [k for k in range(58) if min(hashes[k : k + 3]) in (hashes[k], hashes[k + 2])]
    rows = spark.createDataFrame([(" ".join(words),)], "t string").select(F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("h")).select(syncmers.anchors(F.col("h")).alias("a"))
    frame = spark.createDataFrame([(hashes[k], hashes[k + 1], hashes[k + 2]) for k in chosen], "a long, b long, c long")
    expected = [r.x for r in frame.select(F.xxhash64("a", "b", "c").alias("x")).collect()]
    assert rows.first().a == expected


def test_every_anchor_of_a_long_text_counts(spark):
    """All anchors are kept, in text order; each edit of a word shows; a shared passage has anchors in both texts."""
    rng = np.random.default_rng(2)
    words = [f"w{k}" for k in rng.integers(0, 100_000, 5000)]
    passage = [f"p{k}" for k in range(50)]
    edits = [words[:at] + ["edited"] + words[at + 1 :] for at in range(100, 5000, 490)]
    others = [[f"x{n}y{k}" for k in range(3000)] for n in range(2)]
    texts = [" ".join(w) for w in [words, *edits, others[0] + passage, passage + others[1]]]
    rows = syncmers.fingerprints(documents(spark, *enumerate(texts))).orderBy("doc_id").collect()
    hashes = F.transform(F.split("t", " "), lambda w: F.xxhash64(w))
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("k", syncmers.as_text(syncmers.anchors(hashes)).alias("a"))
    assert [r.fingerprint for r in rows] == [r.a for r in frame.orderBy("k").collect()]
    assert len({r.fingerprint for r in rows}) == len(texts) and len(rows[0].fingerprint) > 16 * 2500
    assert all(0.9 < r.near_next < 1 for r in rows[: len(edits)])
    codes = [{r.fingerprint[k : k + 16] for k in range(0, len(r.fingerprint), 16)} for r in rows[-2:]]
    assert len(codes[0] & codes[1]) >= 20 and rows[-2].near_next > 0


def test_fingerprints_of_odd_tables(spark):
    docs = documents(spark, (1, None), (None, "a b c d e"), (3, "x"), (3, "x"))
    assert [r.doc_id for r in syncmers.fingerprints(docs).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == [None, 1, 3, 3]
    assert syncmers.fingerprints(docs.limit(0)).collect() == []
    (one,) = syncmers.fingerprints(documents(spark, (9, "a b c d"))).collect()
    assert one.near_next == 1.0


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        scores = x @ x[ids.index(q)]
        order = sorted((j for j in range(len(ids)) if ids[j] != q), key=lambda j: (-scores[j], ids[j]))[:k]
        out[q] = [ids[j] for j in order]
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = sorted((r.vec_id, r.embedding) for r in df.collect())
    ids, x = [i for i, _ in data], np.array([v for _, v in data], dtype=np.float64)
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - float(x[ids.index(r.query_id)] @ x[ids.index(r.vec_id)])) < 1e-12
    want = brute(ids, x, [i for i in ids if i % 20 == 0], 20)
    assert set(found) == set(want) and all(len(f) == 20 for f in found.values())
    assert np.mean([len(set(found[q]) & set(want[q])) / 20 for q in want]) >= 0.95


def recall_of(spark, x, every, k=10, **settings):
    """Recall by brute force over ``x`` of what is found for each ``every``-th vector."""
    df = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    found = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0, k).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(len(x))), x.astype(np.float32).astype(np.float64), range(0, len(x), every), k)
    assert set(found) == set(want)
    return np.mean([len(found[q] & set(want[q])) / k for q in want])


def test_beams_grow_until_recall_is_reached(spark, monkeypatch):
    """With few neighbours and a beam of 8, a set far larger than what that could cover is searched well, and badly if beams stay."""
    for name, value in (("NEIGHBOURS", 8), ("REVERSE", 6), ("OFFERS", 4), ("BEAM", 8), ("WIDTH", 16), ("ENTRIES", 16)):
        monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(3).standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert recall_of(spark, x, 40) >= 0.9
    monkeypatch.setattr(ann, "TARGET", 0.0)
    assert recall_of(spark, x, 40) < 0.8


def test_shards(spark, monkeypatch):
    """Vectors of several shards are found, and rounds and steps are no jobs of their own."""
    monkeypatch.setattr(ann, "SHARD", 600, raising=False)
    monkeypatch.setattr(ann, "LEAST_SHARD", 100, raising=False)
    x = np.random.default_rng(5).standard_normal((4000, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.sparkContext.setJobGroup("shards", "shards")
    try:
        assert recall_of(spark, x, 40) >= 0.95
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("shards")) < 70


def test_recall_with_outlying_norms(spark):
    """One vector of a huge norm, norms over many powers of ten, and products beyond the range of doubles."""
    rng = np.random.default_rng(7)
    centres = rng.standard_normal((60, 16))
    x = centres[rng.integers(0, 60, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    plain = recall_of(spark, x, 30)
    x[7] *= 10_000
    assert plain >= 0.95 and recall_of(spark, x, 30) >= 0.95
    heavy = x * np.exp(2 * rng.standard_normal(3000))[:, None]
    assert recall_of(spark, heavy, 30) >= 0.95
    huge = spark.createDataFrame([(k, [1e200 * (1 + k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in ann.nearest(huge, F.col("vec_id") == 0, 3).orderBy("rank").collect()] == [(k, float("inf")) for k in (1, 2, 3)]


def test_equal_vectors_and_lengths(spark):
    """Copies rank by id; unequal norms count; all candidates are found in a small set."""
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((60, 8)) * rng.uniform(0.5, 3, 60)[:, None]).astype(np.float32)
    x[30:55] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    want = brute(list(range(60)), x.astype(np.float64), [0, 20, 40], 20)
    found = {}
    for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == want


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [0.5, 0.5]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [0.0, 2.0]), (20, [0.0, 2.0]), (40, None)]
    out = [tuple(r) for r in ann.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 8, 1.0), (0, 2, 6, 0.5), (0, 3, 20, 0.0), (20, 1, 8, 4.0), (20, 2, 6, 1.0), (20, 3, 0, 0.0)]
    assert ann.nearest(vectors(spark, rows[:1]), F.col("vec_id") == 0, 20).collect() == []
    assert ann.nearest(vectors(spark, []), F.col("vec_id") == 0, 20).collect() == []


def test_queries_that_are_not_vertices(spark):
    scratch, rng = Scratch(spark, "t"), np.random.default_rng(1)
    x = rng.standard_normal((400, 8))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("<f2")
    points = scratch.keep(spark.createDataFrame([(k, 1, bytearray(v.tobytes())) for k, v in enumerate(x)], "node long, shell int, x binary"), "points")
    graph = ann.build(scratch, points, 8)
    q = rng.standard_normal((10, 8)).astype("<f2")
    asked = spark.createDataFrame([(k, bytearray(v.tobytes()), None) for k, v in enumerate(q)], "query long, x binary, own long")
    beams = {}
    for r in ann.search(scratch, graph, points, asked, 10).collect():
        beams.setdefault(r["query"], set()).add(r.node)
    hits = [len(beams[k] & set(np.argsort(-(x.astype(np.float32) @ v.astype(np.float32)))[:10].tolist())) / 10 for k, v in enumerate(q)]
    assert np.mean(hits) >= 0.9
