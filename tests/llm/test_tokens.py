"""Token files, packing and byte-level BPE."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ashlar.llm import merge_replay, packing, token_store, units
from ashlar.llm.queries import tokenizer
from ashlar.llm.scratch import Scratch

from .helpers import FOLDER, documents

FILE = tokenizer("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", " ", "  a  b\n c", " x", "x ", "a\n\nb  c d\te   f", "it's  I'll 12 3 4,, !! é\x1c é \x1c x", "a\u3000 b \u2003c", "<|endoftext|> a", "a <|endoftext|> b", "  <|endoftext|><|endoftext|>\n x<|endoftext|>y  <|endoftext|>", "<|endoftext |>", "日本語 テキスト", "a" * 900, "x" * 80 + " " + "x" * 80, "The cat, the CAT's 99. éàü! \u1680 z"]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(FILE)  # as it comes
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.read_ranks(RANKS), special_tokens={})


def split(flat, at):
    return [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]


def test_parts_encode_as_the_whole(whole):
    small = units.hf_encoder(FILE)
    @settings(max_examples=60, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("ab é'\n\t .!1\u3000\x1c漢")), max_size=30) | st.none(), max_size=8))
    def check(texts):
        assert split(*small.encode(texts)) == [whole(t) for t in texts]

    check()
    assert split(*small.encode(ODD)) == [whole(t) for t in ODD]


def test_a_full_cache_changes_nothing(whole):
    full = units.hf_encoder(FILE)
    tiny = units.UnitCache(full.encode_many, full.encode_units, most=6, longest=3)
    words = ["aa", "bb", "cc", "dddd", "ee", "ff", "gg", "hh"]
    for seed in range(20):
        text = " ".join(random.Random(seed).choices(words, k=12))
        assert split(*tiny.encode([text])) == [whole(text)]
    many = " ".join(["the cat sat"] * 3 + [f"w{k} w{k}" for k in range(50)])  # more than there is room for
    for _ in range(3):
        assert split(*tiny.encode([many])) == [whole(many)]
    assert 0 < len(tiny.kept.young) <= 3


def test_elias_fano():
    @settings(max_examples=100, deadline=None)
    @given(st.lists(st.integers(0, 1 << 40) | st.integers(0, 300), max_size=300))
    def check(values):
        values = sorted(values)
        data = token_store.EliasFano.of(np.array(values, dtype=np.uint64)).to_bytes()
        back, end = token_store.EliasFano.read(memoryview(data), 0)
        assert end == len(data)
        assert [back.select(i) for i in range(len(values))] == values == back.all().tolist()
        with pytest.raises(IndexError):
            back.select(len(values))

    check()
    dense = token_store.EliasFano.of(np.arange(0, 3_000_000, 300)).to_bytes()
    assert len(dense) < 10_000 * 12 / 8  # against 64 bits each


def test_token_files(spark, whole):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").unionByName(documents(spark, (10_000, None), (10_001, "")).select("doc_id", "text"), allowMissingColumns=True)
    rows = token_store.store_and_read(spark, docs, FILE, 2).orderBy("doc_id").collect()
    start = 0
    for r, (i, text) in zip(rows, sorted((x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()), strict=True):
        ids = [*whole(text), 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


def test_many_files_and_marks(spark, whole, monkeypatch):
    """Blocks of a few ids, two to a file, several files to a partition; ids of tokens that stand in the texts."""
    monkeypatch.setattr(token_store, "FILE_BLOCKS", 2)
    texts = {k: ["a <|endoftext|> b " * (k % 7), "plain text " * 300][k % 2] for k in range(120)}
    docs = documents(spark, *texts.items())
    original = token_store._blocks
    monkeypatch.setattr(token_store, "_blocks", lambda *a: small_blocks(original(*a)))
    rows = token_store.store_and_read(spark, docs, FILE, 2).orderBy("doc_id").collect()
    start = 0
    for r, (k, text) in zip(rows, texts.items(), strict=True):
        ids = [*whole(text), 2]
        assert tuple(r) == (k, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) and (k % 2 or not k % 7 or 50256 in ids)
        start += len(ids)
    assert len(list(Path(spark.conf.get("spark.checkpoint.dir")).glob("token-store-*/files/part-*-c003*"))) >= 1


def small_blocks(run):
    """Each document in a block of its own: batches of one row."""
    return lambda batches: (out for batch in batches for k in range(batch.num_rows) for out in run(iter([batch.slice(k, 1)])))


def test_numbers_of_files(spark):
    paths = ["file:/x/part-7-c9.d/files/part-00012-c1234567-89ab-c123-8c45-c00000000001-c003.txt", "s3a://b/part-00000-2b-c1-c000.txt.zst"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select(*token_store._numbers(F.col("path"))).collect()
    assert [tuple(r) for r in rows] == [(12, 3), (0, 0)]


def test_widths():
    assert [token_store.width_for(n) for n in (50_257, 65_535, 65_536)] == [2, 2, 4]
    with pytest.raises(ValueError):
        token_store.width_for(65_536, 2)


def test_token_files_of_odd_tables(spark):
    docs = documents(spark, (3, "b c"), (None, "a"), (3, "b c"), (None, None), (-5, "x"))
    rows = token_store.store_and_read(spark, docs, FILE, 2).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, -5, 3, 3]
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    assert token_store.store_and_read(spark, docs.limit(0), FILE, 2).collect() == []


def test_small_blocks_hold_the_same(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": ["a b c " * (k % 5) for k in range(50)]})
    found = {}
    for size in (20, 1 << 20):
        monkeypatch.setattr(token_store, "BLOCK_BYTES", size)
        blocks = [b.column(0)[0].as_py() for b in token_store._blocks(FILE, 2, 2)(iter([batch]))]
        held = [(d, ids[([0, *ends.all()])[k] : ends.select(k)].tolist()) for b in blocks for docs, ends, ids in token_store.Blocks(b + b"\n") for k, d in enumerate(docs)]
        found[size] = len(blocks), held
    assert found[20][0] > 10 and found[1 << 20][0] == 1
    assert found[20][1] == found[1 << 20][1] and [d for d, _ in found[20][1]] == list(range(50))


def test_blocks_round_trip():
    data = token_store.block([None, 7, 9], np.array([3, 0, 5]), np.concatenate([np.arange(3), np.arange(5)]), 2) + b"\n"
    (one, two) = list(token_store.Blocks(data + data))
    assert one[0] == [None, 7, 9] and [one[1].select(k) for k in range(3)] == [3, 3, 8]
    assert two[2].tolist() == [0, 1, 2, 0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        list(token_store.Blocks(b"x" * 60))


def test_best_fit_is_best_fit():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 4, 3, 1]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 2, 1] and offsets.tolist() == [0, 0, 6, 5, 0, 9]
    assert [packing.cut(n, 4) for n in (1, 4, 5, 8, 9)] == [[(0, 1)], [(0, 4)], [(0, 1), (1, 4)], [(0, 4), (4, 4)], [(0, 1), (1, 4), (5, 4)]]


def check_packed(rows, texts, whole, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for members in by.values():
        members.sort(key=lambda r: r.offset)
        assert [r.offset for r in members] == list(np.cumsum([0] + [r.length for r in members])[:-1])
        assert sum(r.length for r in members) <= capacity
    for i, text in texts.items():
        ids = [*whole(text), 0]
        pieces = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [(r.start, r.length) for r in pieces] == packing.cut(len(ids), capacity)
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in pieces)
    return by


def test_packing(spark, whole):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").repartition(8)
    rows = packing.pack(spark, docs, FILE).collect()
    by = check_packed(rows, {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}, whole, 2048)
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 8 // 2  # half a bin for each partition


def test_packing_levels(spark, whole, monkeypatch):
    """Many partitions with few texts each: underfull bins meet in the tree."""
    monkeypatch.setattr(packing, "TASK_ITEMS", 20)
    docs = documents(spark, *[(k, "word " * (k % 37)) for k in range(300)]).repartition(32)
    rows = packing.pack(spark, docs, FILE, capacity=64).collect()
    by = check_packed(rows, {k: "word " * (k % 37) for k in range(300)}, whole, 64)
    assert len(by) <= 1.1 * sum(r.length for r in rows) / 64


def test_packing_of_odd_tables(spark):
    rows = packing.pack(spark, documents(spark, (None, None), (1, ""), (1, "")), FILE).collect()
    assert sorted((r.doc_id is None, r.length) for r in rows) == [(False, 1), (False, 1), (True, 1)]
    assert packing.pack(spark, documents(spark).limit(0), FILE).collect() == []


def test_merges_equal_the_library(tik):
    replay, cache = merge_replay.encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("aehnortist", k=rng.randint(1, 40))) for _ in range(2000)] + ["".join(rng.choices(["a", "b", " ", "\n", "字", "é", "1", "\u2009"], k=400)) for _ in range(30)]
    for text, ids in zip(texts, split(*cache.encode(texts)), strict=True):
        assert ids == tik.encode_ordinary(text)
        assert replay.decode(ids) == text.encode()


def test_a_merge_may_make_a_lower_pair():
    """Ranks where merging in rank order alone would go wrong."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 1, b"ab": 5, b"cd": 6, b"bc": 9, b"dd": 5000, b"abcab": 7}
    replay = merge_replay.MergeReplay(ranks, r"\S+|\s+")
    own = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(500):
        word = "".join(rng.choices("abcd", k=rng.randint(1, 14)))
        assert np.frombuffer(replay.replay([word.encode()])[0], "<u4").tolist() == own.encode_ordinary(word) or word.encode() in ranks


def test_merges_by_array_and_one_by_one_are_the_same(monkeypatch):
    replay, _ = merge_replay.encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(8)
    words = ["".join(rng.choices("aaabeinrst", k=rng.randint(1, 15))).encode() for _ in range(3000)]
    found = {}
    for few in (1, 24, 10**9):
        monkeypatch.setattr(merge_replay, "FEW", few)
        found[few] = replay.replay(words)
    assert found[1] == found[24] == found[10**9] == [np.array(replay.alone(w), dtype="<u4").tobytes() for w in words]


def test_round_trip(spark, tik):
    docs = documents(spark, (1, "Ça va? it's 12"), (2, None), (None, ""), (1, "Ça va? it's 12"))
    rows = merge_replay.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == 4
    for r, text in zip(rows, ["Ça va? it's 12", "", "", "Ça va? it's 12"], strict=True):
        ids = tik.encode_ordinary(text)
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert merge_replay.round_trip(docs.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []


def test_words_of_the_corpus_are_replayed_once(spark, tik, monkeypatch):
    """The table of words has the library's ids, and as many words as are allowed; what isn't in it is encoded all the same."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    counts = {}
    for text in texts.values():
        for unit in text.split(" ")[1:]:
            counts[unit] = counts.get(unit, 0) + 1
    plain = {u: n for u, n in counts.items() if u and u == u.strip() and n > 1 and len(u) <= 64}
    want = {i: hashlib.sha256(",".join(map(str, tik.encode_ordinary(t))).encode()).hexdigest() for i, t in texts.items()}
    for most in (400_000, 50, 0):
        monkeypatch.setattr(merge_replay, "BASE_UNITS", most)
        rows = merge_replay.corpus_codes(Scratch(spark, "t"), docs, RANKS, public_tokenizers.PATTERN).collect()
        assert len(rows) <= most and (most < 400_000 or {r.unit for r in rows} == set(plain)) and (most != 50 or rows)
        assert all(np.frombuffer(r.ids, "<u4").tolist() == tik.encode_ordinary(" " + r.unit) for r in rows)
        assert {r.doc_id: r.ids_sha256 for r in merge_replay.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()} == want
