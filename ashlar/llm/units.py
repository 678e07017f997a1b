"""Encoding whole texts through a cache of the parts between spaces.

A byte-level BPE splits a text by a pattern before any merge, and a token holds
a space only at its start or in a run of white space. So a text may be cut
before every space that stands between two characters that aren't white space,
and the ids of the parts, joined, are the ids of the whole.
"""

from __future__ import annotations

import gc
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CUT = re.compile(r"(?<=\S)(?= \S)")


class Kept:
    """What a worker keeps of strings' ids: at most ``most``, none longer than ``longest``, those used of late.

    It has two halves. A string found in the older one moves to the younger; when
    that is full, it becomes the older one. What has gone is made again, so the
    bounds change no result.
    """

    def __init__(self, most: int, longest: int):
        self.half, self.longest = most // 2, longest
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get_many(self, keys: list[str]) -> list[bytes | None]:
        out = list(map(self.young.get, keys))
        if self.old:
            get, put = self.old.get, self.young.__setitem__
            for k, x in enumerate(out):
                if x is None and (found := get(keys[k])) is not None:
                    out[k] = found
                    put(keys[k], found)
        return out

    def put_many(self, keys: list[str], values: Sequence[bytes]) -> None:
        keys = keys[: self.half]
        values = values[: self.half]
        if len(self.young) + len(keys) > self.half:
            self.old, self.young = self.young, {}
        if not keys:
            return
        short = zip(keys, values, strict=True)
        if max(map(len, keys)) > self.longest:
            short = ((k, x) for k, x in short if len(k) <= self.longest)
        self.young.update(short)


class UnitCache:
    """Ids of whole texts, as unsigned 32-bit integers.

    ``encode_many`` turns any strings into such ids' little-endian bytes. ``encode_units`` does so for
    strings that can't be cut, each with a space put before it; there are many of them.
    ``most`` and ``longest`` bound the parts kept between calls. Texts that hold one of ``marks``, tokens that the library
    looks for before it splits, are not cut: ``encode_whole`` gets them.
    """

    def __init__(
        self,
        encode_many: Callable[[Sequence[str]], list[bytes]],
        encode_units: Callable[[Sequence[str]], list[bytes]] | None = None,
        most: int = 300_000,
        longest: int = 64,
        marks: Sequence[str] = (),
        encode_whole: Callable[[Sequence[str]], list[bytes]] | None = None,
        largest: int = (1 << 32) - 1,
    ):
        self.encode_many = encode_many
        self.encode_units = encode_units or (lambda words: encode_many([" " + w for w in words]))
        self.kept = Kept(most, longest)  # by the part without its space
        self.base: dict[str, bytes] = {}  # parts whose ids are known from the start
        self.base_of: str | None = None  # what that table is of
        self.marks, self.encode_whole, self.largest = marks, encode_whole, largest  # no id is larger

    def _ids(self, words: pa.Array, counts: np.ndarray) -> tuple[list[bytes], list[int]]:
        """Ids of distinct parts, which stand here so often, and the places of those that begin or end with white space, where a cut is no cut."""
        wide = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(words), words), pc.equal(words, ""))
        odd = np.flatnonzero(wide.to_numpy(zero_copy_only=False)).tolist()
        words = words.to_pylist()
        if self.base:
            out = list(map(self.base.get, words))
            rest = [k for k, x in enumerate(out) if x is None]
            for k, x in zip(rest, self.kept.get_many([words[k] for k in rest]), strict=True):
                out[k] = x
        else:
            out = self.kept.get_many(words)
        for k in odd:
            out[k] = b""
        new = [k for k, x in enumerate(out) if x is None]
        parts = [words[k] for k in new]
        ids = self.encode_units(parts)
        for k, x in zip(new, ids, strict=True):
            out[k] = x
        often = np.flatnonzero(counts[new] > 1).tolist() if new else []  # those that stand here once may never come again
        self.kept.put_many([parts[k] for k in often], [ids[k] for k in often])
        return out, odd

    def encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin, with the end of the last. A null is an empty text."""
        collecting = gc.isenabled()
        gc.disable()  # there are many small objects, and no cycles
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts, "")
        if not len(texts):
            return np.zeros(0, dtype="<u4"), np.zeros(1, dtype=np.int64)
        marked = np.zeros(len(texts), dtype=bool)
        for mark in self.marks:
            marked |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._encode_unmarked(texts)
        flat, at = self._encode_unmarked(pc.if_else(pa.array(marked), "", texts))
        rows = np.flatnonzero(marked).tolist()
        own = [np.frombuffer(x, dtype="<u4") for x in self.encode_whole([texts[k].as_py() for k in rows])]
        parts, last = [], 0
        for k, ids in zip(rows, own, strict=True):
            parts += (flat[last : at[k]], ids)
            last = at[k]
        lengths = np.diff(at)
        lengths[rows] = [len(ids) for ids in own]
        return np.concatenate([*parts, flat[last:]]), np.concatenate(([0], np.cumsum(lengths)))

    def _encode_unmarked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        units = coded.indices.to_numpy().astype(np.int32)
        at = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        heads = coded.take(pa.array(at[:-1])).to_pylist()
        ids, odd = self._ids(coded.dictionary, np.bincount(units, minlength=len(coded.dictionary)))
        units[at[:-1]] = len(ids) + np.arange(len(heads))  # the first part has no space before it
        slow: dict[int, bytes] = {k: b"" for k, head in enumerate(heads) if head[-1:].isspace()}
        if odd:
            slow |= dict.fromkeys((np.searchsorted(at, np.flatnonzero(np.isin(units, odd)), "right") - 1).tolist(), b"")
        ids += self.encode_many(["" if k in slow else head for k, head in enumerate(heads)])
        for k in slow:
            ids.append(b"".join(self.encode_many(_CUT.split(texts[k].as_py()))))
            units[at[k]] = len(ids) - 1
        counts = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        starts = np.cumsum(counts, dtype=np.int32) - counts  # a block's ids are far fewer than 2^31
        lengths = counts[units]
        for k in slow:
            lengths[at[k] + 1 : at[k + 1]] = 0
        ends = np.cumsum(lengths, dtype=np.int32)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        places = np.repeat(starts[units] - ends + lengths, lengths)
        places += np.arange(len(places), dtype=np.int32)
        return flat[places], np.concatenate(([0], ends[at[1:] - 1].astype(np.int64)))


def count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``unit`` and ``n``: the parts after a space of all texts, the second column, that neither begin nor end with white space."""
    for _, texts in blocks(batches):
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        heads = np.zeros(len(split.flatten()), dtype=bool)
        heads[split.offsets.to_numpy()[:-1] - split.offsets[0].as_py()] = True
        found = pc.value_counts(split.flatten().filter(pa.array(~heads)))
        unit, n = found.field("values"), found.field("counts")
        plain = pc.and_(pc.equal(pc.utf8_trim_whitespace(unit), unit), pc.not_equal(unit, ""))
        yield pa.RecordBatch.from_arrays([unit.filter(plain), n.filter(plain)], names=["unit", "n"])


#: Bytes of text that a block gathers.
BLOCK_BYTES = 4_000_000


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], pa.Array]]:
    """doc_ids and texts, the first two columns, of some documents at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= BLOCK_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[list[int | None], pa.Array]:
    return pa.concat_arrays([b.column(0) for b in held]).to_pylist(), pa.concat_arrays([b.column(1) for b in held])


_ENCODERS: dict[str, UnitCache] = {}
#: Parts that one call encodes together.
_TOGETHER = 150


def hf_encoder(path: str) -> UnitCache:
    """The encoder of a byte-level ``tokenizers`` file, one for each Python worker.

    It gives what the library does without adding special tokens: those that stand in a text are found there.
    """
    if path not in _ENCODERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        n_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            n_bytes[i] = len(token)  # a byte is a character of the file's alphabet

        def many(parts: Sequence[str]) -> list[bytes]:
            return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(list(parts), add_special_tokens=False)]

        def units(words: Sequence[str]) -> list[bytes]:
            out: list[bytes] = []
            for i in range(0, len(words), _TOGETHER):
                some = words[i : i + _TOGETHER]
                ids = array("I", tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids)
                ends = np.cumsum([1 + (len(w) if w.isascii() else len(w.encode())) for w in some])
                at = (4 * (1 + np.searchsorted(np.cumsum(n_bytes[np.frombuffer(ids, dtype="<u4")]), ends))).tolist()
                data = ids.tobytes()
                out += [data[a:b] for a, b in zip([0, *at], at, strict=False)]
            return out

        marks = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        _ENCODERS[path] = UnitCache(many, units, marks=marks, encode_whole=many, largest=max(vocabulary.values()))
    return _ENCODERS[path]
