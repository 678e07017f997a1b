"""Masked pseudo-likelihood of documents under a bidirectional window network.

The network sees the two tokens before a place and the two after it, and gives
the distribution of the token there; a document's score is the sum over all its
tokens of the logarithm of what the network gives the token that stands there.

Tokens are words, lower-cased and without marks around them. The vocabulary is
every word that occurs at least twice and is at least MIN_SHARE of all tokens, so it
grows with the corpus up to 1 / MIN_SHARE words. Other words are, by length, one of
OTHERS tokens; such a word's own share there is the product of its bytes' shares.

Every token has a learned embedding, and one of the places of a hidden layer over
the four neighbours' embeddings. The output is a softmax in two levels over all
tokens: over classes, then over the tokens of a class, each with an output vector
of its own. Classes hold about equal sums of root frequencies, and are as many as make
both levels' rows together shortest, at most the root of the vocabulary. The biases start from the counts of all tokens of
all documents, so that training starts from the unigram distribution. The context's
part is trained in numpy: first on windows drawn from all partitions, whose number grows
with the corpus (``Settings.windows``), of which a part is left out and tells which pass
was best; then, unless those were all, on every window of every document. Tasks do that
from the same start, each over its partitions, and of what each parameter was changed by
those tasks that changed it the mean is taken. So the drawn windows are but the start.

Defined cases: a text that is null, empty or white space has no tokens, a sum of
0 and no mean; repeated rows stay (and count, in training, each time); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import BATCH_ROWS, Scratch, tune
from .units import blocks

#: Token 0 is the edge of a text; then come those of other words by length; then the vocabulary.
OTHERS, FIRST = 7, 8
#: The least share of all tokens of a word of the vocabulary: the proof that the model that is broadcast has a bound.
MIN_SHARE = 1 / 500_000
MARKS = ".,;:!?\"'()[]{}<>«»„“”‘’…#&%$*|-–—_/\\"
#: Tokens that are scored at once.
CHUNK = 65_536
#: Rows of a matrix of classes, so few that it stays in a core's cache.
ROWS = 512
#: Below it, neither a number's exponential nor a sum of them leaves the range of floats, so nothing need be taken off before.
SAFE = 60.0
#: Where a window's tokens stand, from the first.
AROUND = (0, 1, 3, 4)
#: Places of a run, and runs of a step over all documents.
RUN, RUNS = 64, 1024
#: Tasks that go over all documents, and numbers in a row of what a task has changed.
TRAINERS, PART = 64, 16_384


@dataclass(frozen=True)
class Settings:
    """Windows to start with: all up to ``windows``, beyond it grows by the fourth root of their number."""

    windows: int = 250_000
    passes: int = 3
    batch: int = 1024
    rate: float = 0.08
    embedding: int = 20
    hidden: int = 32
    left_out: float = 0.05
    seed: int = 7
    left_only: bool = False  # for comparison: the tokens after a place aren't seen

    def wanted(self, tokens: int) -> int:
        return int(self.windows * max(1.0, tokens / self.windows) ** 0.25)


def words_of(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words, the place among them of each word of all texts, and where each text's words begin."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    at = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    raw = coded.dictionary
    bare = pc.utf8_trim(raw, MARKS)
    bare = pc.if_else(pc.equal(bare, ""), raw, bare)
    distinct = pa.concat_arrays([pa.array([""], bare.type), bare]).dictionary_encode()
    to = distinct.indices.to_numpy()[1:]
    places = to[coded.indices.to_numpy()] if len(raw) else np.zeros(0, dtype=np.int64)
    full = places != 0  # a text that begins or ends with white space has an empty word there
    return distinct.dictionary.to_numpy(zero_copy_only=False).tolist(), places[full], np.concatenate(([0], np.cumsum(full)))[at]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in blocks(batches):
        words, places, _ = words_of(texts)
        counts = np.bincount(places, minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(words[1:], pa.string()), pa.array(counts[1:], pa.int64())], names=["word", "n"])


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of bytes, and by 256 of words."""
    total = np.zeros(257, dtype=np.int64)
    for batch in batches:
        counts = batch.column(1).to_numpy()
        data = [w.encode() for w in batch.column(0).to_pylist()]
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        total[:256] += np.bincount(np.frombuffer(b"".join(data), np.uint8), np.repeat(counts, lengths), 256).astype(np.int64)
        total[256] += counts.sum()
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(257)), pa.array(total)], names=["byte", "n"])


def other(words: list[str]) -> np.ndarray:
    """The tokens of words outside the vocabulary."""
    return 1 + np.minimum(OTHERS - 1, np.fromiter(map(len, words), np.int64, len(words)) // 3)


@dataclass
class Lexicon:
    """Token of each word, counts of all tokens, and the logarithms of bytes' shares."""

    tokens: dict[str, int]
    counts: np.ndarray
    byte_log: np.ndarray

    @classmethod
    def of(cls, words: list[str], counts: list[int], others: list[int], byte_counts: np.ndarray) -> Lexicon:
        smooth = byte_counts + 1.0
        return cls({w: FIRST + k for k, w in enumerate(words)}, np.array([0, *others, *counts], dtype=np.int64), np.log(smooth / smooth.sum()))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token of each word and the logarithm of its share of that token."""
        tokens = np.fromiter((self.tokens.get(w, 0) for w in words), np.int64, len(words))
        shares = np.zeros(len(words))
        rare = [k for k in np.flatnonzero(tokens == 0).tolist() if words[k]]
        if rare:
            some = [words[k] for k in rare]
            tokens[rare] = other(some)
            data = [w.encode() for w in some]
            ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)))
            logs = self.byte_log[np.frombuffer(b"".join(data), np.uint8)]
            shares[rare] = np.add.reduceat(logs, np.append(0, ends[:-1])) + self.byte_log[256]
        return tokens, shares


def stream(tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens in a row, with two edges before each text and after the last, and where the tokens are there."""
    own = np.arange(len(tokens)) + np.repeat(2 * np.arange(1, len(at)), np.diff(at))
    padded = np.zeros(len(tokens) + 2 * len(at), dtype=np.int32)
    padded[own] = tokens
    return padded, own


def windows(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each token of all texts, those before and after it and itself, as rows of five."""
    padded, own = stream(tokens, at)
    return np.stack([padded[own - 2], padded[own - 1], padded[own + 1], padded[own + 2], padded[own]], axis=1)


def runs(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The stream in rows of RUN places, each with the two before and the two after them."""
    padded, _ = stream(tokens, at)
    n = max(0, -(-(len(padded) - 4) // RUN))
    padded = np.concatenate([padded, np.zeros(n * RUN + 4 - len(padded), np.int32)]) if n else padded
    return np.lib.stride_tricks.sliding_window_view(padded, RUN + 4)[::RUN] if n else np.zeros((0, RUN + 4), np.int32)


def _safe(weights: np.ndarray, bias: np.ndarray, axis: int) -> bool:
    """Whether what comes out for hidden values, which are between -1 and 1, is below SAFE."""
    return bool((np.abs(weights).sum(axis=axis) + np.abs(bias)).max(initial=0.0) < SAFE)


def _exp(z: np.ndarray, safe: bool) -> np.ndarray:
    """Exponentials, up to a factor of each row."""
    if not safe:
        z -= z.max(axis=1, keepdims=True)
    return np.exp(z, out=z)


def _picked(z: np.ndarray, column: np.ndarray, safe: bool) -> np.ndarray:
    """The logarithm of the softmax at one column of each row."""
    if not safe:
        z -= z.max(axis=1)[:, None]
    picked = z[np.arange(len(z)), column]
    return picked - np.log(np.exp(z, out=z) @ np.ones(z.shape[1], z.dtype))


@dataclass
class Network:
    """Parameters, and where each token is in the output: its class and its place among the tokens sorted by class."""

    p: dict[str, np.ndarray]
    class_of: np.ndarray
    place: np.ndarray
    starts: np.ndarray  # of each class' tokens, with the end
    square: dict[str, np.ndarray] = field(default_factory=dict)  # sums of squared gradients, while it is trained
    room: dict[str, np.ndarray] = field(default_factory=dict, repr=False)  # memory used again, as new pages cost more than the sums

    def __getstate__(self) -> dict:
        return self.__dict__ | {"room": {}}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of that shape with anything in it, until that name is asked for again."""
        size, kind = int(np.prod(shape)), self.p["w"].dtype
        if name not in self.room or self.room[name].size < size or self.room[name].dtype != kind:
            self.room[name] = np.empty(size, kind)
        return self.room[name][:size].reshape(shape)

    @classmethod
    def start(cls, counts: np.ndarray, settings: Settings) -> Network:
        rng, n = np.random.default_rng(settings.seed), len(counts)
        smooth = counts + 0.5
        smooth[0] = 0  # an edge is never predicted
        order = np.argsort(-smooth[1:], kind="stable") + 1
        weight = np.sqrt(smooth[order])
        classes = max(1, int(np.ceil(weight.sum() / np.sqrt(smooth.sum()))))  # with so many, both levels' rows together are shortest; at most the root of n
        bins = np.minimum(classes - 1, ((np.cumsum(weight) - weight / 2) * classes / weight.sum()).astype(int))
        used, bins = np.unique(bins, return_inverse=True)
        class_of, place = np.zeros(n, dtype=np.uint16), np.zeros(n, dtype=np.int64)  # as 16 bits are sorted fastest; there are at most 708 classes
        class_of[order], place[order] = bins, np.arange(n - 1)
        starts = np.append(np.searchsorted(bins, np.arange(len(used))), n - 1)
        totals = np.add.reduceat(smooth[order], starts[:-1])
        d, h = settings.embedding, settings.hidden
        f = lambda x: np.asarray(x, dtype=np.float32)
        p = {
            "embed": f(0.3 * rng.standard_normal((n, d))),
            "w": f(rng.standard_normal((4 * d, h)) * (4 * d) ** -0.5),
            "b": np.zeros(h, np.float32),
            "class": np.zeros((h, len(used)), np.float32),
            "class_bias": f(np.log(totals / totals.sum())),
            "out": np.zeros((n - 1, h), np.float32),
            "out_bias": f(np.log(smooth[order] / np.repeat(totals, np.diff(starts)))),
        }
        return cls(p, class_of, place, starts)

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        h = np.matmul(x, self.p["w"], out=self._room("hidden", len(x), len(self.p["b"])))
        h += self.p["b"]
        return np.tanh(h, out=h)

    def hidden(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self._room("wide", 4 * len(rows), self.p["embed"].shape[1])
        x = np.take(self.p["embed"], rows[:, :4].ravel(), axis=0, out=x, mode="clip").reshape(len(rows), -1)
        return x, self._hidden(x)

    def hidden_along(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of all places of a row of tokens, or of many such rows, but two at either end; each embedding is looked up once."""
        n, d = tokens.shape[-1] - 4, self.p["embed"].shape[1]
        e = np.take(self.p["embed"], tokens.ravel(), axis=0, out=self._room("narrow", tokens.size, d), mode="clip").reshape(*tokens.shape, d)
        x = self._room("wide", *tokens.shape[:-1], n, 4, d)
        for j, k in enumerate(AROUND):
            x[..., j, :] = e[..., k : k + n, :]
        x = x.reshape(-1, 4 * d)
        return x, self._hidden(x)

    def _sorted(self, h: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The places whose token isn't an edge, by class; their hidden values and a one; their tokens' classes; and each class' first and last."""
        at = np.flatnonzero(tokens)
        own = self.class_of[tokens[at]]
        order = np.argsort(own, kind="stable")
        at, own = at[order], own[order]
        one = self._room("sorted", len(at), h.shape[1] + 1)
        one[:, -1] = 1
        for a in range(0, len(at), ROWS):
            one[a : a + ROWS, :-1] = h[at[a : a + ROWS]]
        classes, first = np.unique(own, return_index=True)
        return at, one, own, list(zip(classes.tolist(), first.tolist(), [*first[1:].tolist(), len(own)], strict=True))

    def _levels(self, n: int) -> tuple[np.ndarray, bool, bool]:
        """The classes' weights with their biases as the last row, and whether what comes out of them and of the tokens is safe, for so many rows."""
        p = self.p
        return np.vstack([p["class"], p["class_bias"]]), _safe(p["class"], p["class_bias"], 0), 4 * n > len(p["out"]) and _safe(p["out"], p["out_bias"], 1)

    def _log(self, h: np.ndarray, tokens: np.ndarray, levels: tuple[np.ndarray, bool, bool]) -> np.ndarray:
        """The logarithm of each token's probability; 0 of an edge."""
        weights, safe, safe_out = levels
        at, h, own, classes = self._sorted(h, tokens)
        found = np.zeros(len(at), dtype=np.float32)
        for a in range(0, len(at), ROWS):
            some = h[a : a + ROWS]
            z = np.matmul(some, weights, out=self._room("classes", len(some), weights.shape[1]))
            found[a : a + ROWS] = _picked(z, own[a : a + ROWS], safe)
        place = self.place[tokens[at]]
        for c, a, b in classes:
            members = slice(int(self.starts[c]), int(self.starts[c + 1]))
            if members.stop - members.start > 1:  # else it is certain
                z = h[a:b, :-1] @ self.p["out"][members].T
                z += self.p["out_bias"][members]
                found[a:b] += _picked(z, place[a:b] - members.start, safe_out)
        out = np.zeros(len(tokens))
        out[at] = found
        return out

    def log_prob(self, rows: np.ndarray) -> np.ndarray:
        """Of each window, the logarithm of its token's probability."""
        levels = self._levels(len(rows))
        parts = [rows[k : k + CHUNK] for k in range(0, len(rows), CHUNK)]
        return np.concatenate([np.zeros(0), *(self._log(self.hidden(some)[1], some[:, 4], levels) for some in parts)])

    def log_probs(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of each text, the sum of its tokens' ``log_prob``."""
        levels = self._levels(len(tokens))
        padded, _ = stream(tokens, at)
        parts = [padded[k : k + CHUNK + 4] for k in range(0, len(padded) - 4, CHUNK)]
        ends = np.cumsum(np.concatenate([np.zeros(3), *(self._log(self.hidden_along(some)[1], some[2:-2], levels) for some in parts)]))  # of the stream to each place
        first = at[:-1] + 2 * np.arange(1, len(at))
        return ends[first + np.diff(at)] - ends[first]

    @staticmethod
    def _updates(p: dict[str, np.ndarray], square: dict[str, np.ndarray], rate: float):
        """Each parameter's rate is by the squares it has seen."""

        def update(name: str, grad: np.ndarray, where=...) -> None:
            seen = square[name][where] + grad * grad
            square[name][where] = seen
            np.sqrt(seen, out=seen)
            seen += 1e-6
            np.divide(grad, seen, out=seen)
            seen *= rate
            p[name][where] -= seen

        return update

    def _step_out(self, h: np.ndarray, tokens: np.ndarray, update) -> np.ndarray:
        """Both levels' step; the gradient at the hidden values, of which those at edges have none."""
        p, width = self.p, h.shape[1]
        dh = self._room("back", *h.shape)
        weights, safe, safe_out = self._levels(len(h))
        at, h, own, classes = self._sorted(h, tokens)
        n = len(at)
        back = np.hstack([p["class"].T, np.ones((weights.shape[1], 1), h.dtype)])  # what it gives last is a row's sum
        found, to_class = self._room("found", n, width), np.zeros_like(back)
        for a in range(0, n, ROWS):
            some = h[a : a + ROWS]
            z = _exp(np.matmul(some, weights, out=self._room("classes", len(some), weights.shape[1])), safe)
            to = z @ back
            share = 1 / to[:, -1:]
            np.multiply(to[:, :-1], share, out=found[a : a + ROWS])
            to_class += z.T @ (some * share)
        place = self.place[tokens[at]]
        for c, a, b in classes:
            to_class[c] -= np.ones(b - a, h.dtype) @ h[a:b]  # these have the class that stands there
            found[a:b] -= p["class"][:, c]
            members = slice(int(self.starts[c]), int(self.starts[c + 1]))
            own_weights, ones = p["out"][members], np.ones(members.stop - members.start, h.dtype)
            if len(ones) == 1:  # it is certain
                continue
            grad, to_bias = np.zeros((len(ones), width), h.dtype), np.zeros(len(ones), h.dtype)
            step = max(1, min(b - a, ROWS * weights.shape[1] // len(ones)))
            for k in range(a, b, step):
                some = h[k : min(b, k + step), :-1]
                z = np.matmul(some, own_weights.T, out=self._room("classes", len(some), len(ones)))
                z += p["out_bias"][members]
                z = _exp(z, safe_out)
                z *= (1 / (z @ ones))[:, None]
                z[np.arange(len(some)), place[k : k + len(some)] - members.start] -= 1
                found[k : k + len(some)] += z @ own_weights
                grad += z.T @ some
                to_bias += np.ones(len(some), h.dtype) @ z
            update("out", grad / n, members)
            update("out_bias", to_bias / n, members)
        to_class /= max(1, n)
        update("class", np.ascontiguousarray(to_class[:, :-1].T))
        update("class_bias", to_class[:, -1])
        found /= max(1, n)
        if n < len(dh):
            dh[...] = 0
        dh[at] = found
        return dh

    def _step_in(self, x: np.ndarray, h: np.ndarray, dh: np.ndarray, update) -> np.ndarray:
        """The hidden layer's step; the gradient at what goes into it."""
        np.multiply(h, h, out=h)
        np.subtract(1, h, out=h)
        dh *= h
        dx = np.matmul(dh, self.p["w"].T, out=self._room("into", *x.shape))
        update("w", x.T @ dh)
        update("b", dh.sum(axis=0))
        return dx

    def _step_embed(self, tokens: np.ndarray, dx: np.ndarray, update) -> None:
        order = np.argsort(tokens)
        seen, at = np.unique(tokens[order], return_index=True)
        update("embed", np.add.reduceat(np.take(dx, order, axis=0, out=self._room("wide", *dx.shape), mode="clip"), at), seen)

    def step(self, rows: np.ndarray, square: dict[str, np.ndarray], rate: float) -> None:
        """One minibatch of gradient descent."""
        update = self._updates(self.p, square, rate)
        x, h = self.hidden(rows)
        dx = self._step_in(x, h, self._step_out(h, rows[:, 4], update), update)
        self._step_embed(rows[:, :4].ravel(), dx.reshape(4 * len(rows), -1), update)

    def step_along(self, rows: np.ndarray, square: dict[str, np.ndarray], rate: float) -> None:
        """The same over all windows of ``runs``."""
        update = self._updates(self.p, square, rate)
        x, h = self.hidden_along(rows)
        dx = self._step_in(x, h, self._step_out(h, rows[:, 2:-2].ravel(), update), update).reshape(len(rows), rows.shape[1] - 4, 4, -1)
        de = self._room("narrow", *rows.shape, dx.shape[-1])
        de[...] = 0
        for j, k in enumerate(AROUND):
            de[:, k : k + dx.shape[1]] += dx[:, :, j]
        self._step_embed(rows.ravel(), de.reshape(rows.size, -1), update)


def train(rows: np.ndarray, counts: np.ndarray, settings: Settings) -> tuple[Network, dict[str, float]]:
    """The network of the pass that was best on windows left out, and the losses there, a token: of the counts alone, and of the network."""
    network = Network.start(counts, settings)
    rng = np.random.default_rng(settings.seed)
    rows = rows[rng.permutation(len(rows))]
    if settings.left_only:
        rows[:, 2:4] = 0
    out = int(settings.left_out * len(rows))
    held, rows = rows[:out], rows[out:]
    loss = lambda: float(-network.log_prob(held).mean()) if out else 0.0
    losses = {"unigram": loss()}
    best, least = {k: v.copy() for k, v in network.p.items()}, losses["unigram"]
    square = {k: np.zeros_like(v) for k, v in network.p.items()}
    for turn in range(settings.passes):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), settings.batch):
            network.step(rows[order[k : k + settings.batch]], square, settings.rate / (1 + turn))
        if (now := loss()) <= least:
            best, least = {k: v.copy() for k, v in network.p.items()}, now
        else:
            break
    network.p, network.square = best, square
    return network, losses | {"network": least}


@dataclass
class Model:
    lexicon: Lexicon
    network: Network
    losses: dict[str, float] = field(default_factory=dict)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each text, and the sum of their conditional log-probabilities."""
        tokens, at, shares = _encoded(self.lexicon, texts)
        return np.diff(at), self.network.log_probs(tokens, at) + shares


def _encoded(lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens, where each text's begin, and the sum of its tokens' shares."""
    words, places, at = words_of(texts)
    tokens, shares = lexicon.encode(words)
    ends = np.concatenate(([0.0], np.cumsum(shares[places])))[at]
    return tokens.astype(np.int32)[places], at, np.diff(ends)


#: Documents once their words are tokens, as little-endian 32-bit integers.
KEPT = "doc_id long, tokens binary, shares double"


def _encoder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            tokens, at, shares = _encoded(shared.value, texts)
            data, at = tokens.astype("<i4").tobytes(), (4 * at).tolist()
            own = [data[a:b] for a, b in zip(at, at[1:], strict=False)]
            for k in range(0, len(own), BATCH_ROWS):
                some = slice(k, k + BATCH_ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), pa.array(own[some], pa.binary()), pa.array(shares[some])], names=["doc_id", "tokens", "shares"])

    return run


def _kept_tokens(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens, and where each text's begin."""
    at = np.cumsum(np.append(0, pc.binary_length(own).to_numpy(zero_copy_only=False))).astype(np.int64) // 4
    return np.frombuffer(b"".join(own.to_pylist()), "<i4"), at


def _trainer(shared, settings: Settings):
    """Train on all windows of a task's tokens; rows of what has changed. ``shared``: the network to start from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        rng = np.random.default_rng(settings.seed)
        network = Network({k: v.copy() for k, v in start.p.items()}, start.class_of, start.place, start.starts)
        square = {k: v.copy() for k, v in start.square.items()}
        for _, own in blocks(batches):
            rows = windows(*_kept_tokens(own)) if settings.left_only else runs(*_kept_tokens(own))
            if settings.left_only:
                rows[:, 2:4] = 0
            step, size = (network.step, RUN * RUNS) if settings.left_only else (network.step_along, RUNS)
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), size):
                step(rows[order[k : k + size]], square, 1.5 * settings.rate)  # steps so large have little noise
        for name, value in network.p.items():
            change = (value - start.p[name]).ravel()
            for part in range(-(-len(change) // PART)):
                own = change[part * PART : (part + 1) * PART]
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([own.astype("<f4").tobytes()], pa.binary())], names=["name", "part", "data"])

    return run


def _mean_change(table: pa.Table) -> pa.Table:
    """Of each number the mean over the tasks that changed it."""
    total, n = 0.0, 0
    for data in table.column("data"):
        own = np.frombuffer(data.as_buffer(), "<f4")
        total, n = total + own.astype(np.float64), n + (own != 0)
    return table.slice(0, 1).select(["name", "part"]).append_column("data", pa.array([(total / np.maximum(n, 1)).astype("<f4").tobytes()], pa.binary()))


def train_on_all(kept: DataFrame, network: Network, settings: Settings) -> None:
    """Go on with the network over every window of all documents' tokens."""
    shared = kept.sparkSession.sparkContext.broadcast(network)  # bounded by the vocabulary
    schema = "name string, part int, data binary"
    changes = kept.select("doc_id", "tokens").coalesce(TRAINERS).mapInArrow(_trainer(shared, settings), schema)
    for row in changes.groupBy("name", "part").applyInArrow(_mean_change, schema).collect():  # as many numbers as the network has
        own = np.frombuffer(row.data, "<f4")
        network.p[row["name"]].ravel()[row.part * PART : row.part * PART + len(own)] += own
    shared.unpersist()


def learn(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Count all words of all documents, and train on all their windows, starting from what some of them teach."""
    return _learn(docs, settings)[0]


def _learn(docs: DataFrame, settings: Settings) -> tuple[Model, DataFrame]:
    """Also all documents as tokens (``KEPT``), so that texts are read for the counts and for these only."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pseudo-lm")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = scratch.keep(texts.mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") >= F.greatest(F.lit(2.0), F.lit(MIN_SHARE * total))
    top = words.where(common).orderBy(F.desc("n"), "word").collect()  # at most 1 / MIN_SHARE rows
    length = F.least(F.lit(OTHERS - 1), F.floor(F.length("word") / 3)).cast("int")
    rare = {r.length: r.n for r in words.where(~common).groupBy(length.alias("length")).agg(F.sum("n").alias("n")).collect()}
    byte_rows = words.mapInArrow(_count_bytes, "byte long, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect()
    byte_counts = np.zeros(257)
    for row in byte_rows:
        byte_counts[row.byte] = row.n
    lexicon = Lexicon.of([r.word for r in top], [r.n for r in top], [rare.get(k, 0) for k in range(OTHERS)], byte_counts)
    shared = spark.sparkContext.broadcast(lexicon)  # bounded by the vocabulary

    share = min(1.0, settings.wanted(total) / total) if total else 1.0
    drawn = min(1.0, 4 * share)  # of the texts; then of their windows
    bound = 1 << 30

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, own in blocks(batches):
            rows = windows(*_kept_tokens(own))
            if share < drawn:
                seed = [len(rows), *(i or 0 for i in ids[:1])]
                rows = rows[np.random.default_rng(np.abs(seed)).random(len(rows)) < share / drawn]
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(rows, "<i4").tobytes()], pa.binary())], names=["rows"])

    kept = scratch.keep(texts.mapInArrow(_encoder(shared), KEPT), "tokens")
    chosen = kept.where(F.pmod(F.xxhash64("doc_id", "tokens"), F.lit(bound)) < F.lit(int(drawn * bound))).select("doc_id", "tokens")
    found = scratch.keep(chosen.mapInArrow(draw, "rows binary"), "windows").orderBy(F.xxhash64("rows")).toArrow()  # about as many as wanted
    rows = np.frombuffer(b"".join(found.column("rows").to_pylist()), "<i4").reshape(-1, 5)
    network, losses = train(rows, lexicon.counts, settings)
    if share < 1:
        train_on_all(kept, network, settings)
    network.square, network.room = {}, {}
    return Model(lexicon, network, losses), kept


SCORED = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"


def _scored(ids: pa.Array, n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
    return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sums, pa.float64()), mean], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, log_prob (the sum) and mean_log_prob of every document."""
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in blocks(batches):
            yield _scored(pa.array(ids, pa.int64()), *shared.value.score(texts))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, SCORED)


def _score_kept(kept: DataFrame, network: Network) -> DataFrame:
    """The same of documents that are tokens already."""
    shared = kept.sparkSession.sparkContext.broadcast(network)  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, at = _kept_tokens(batch.column(1))
            yield _scored(batch.column(0), np.diff(at), shared.value.log_probs(tokens, at) + batch.column(2).to_numpy())

    return kept.mapInArrow(run, SCORED)


def pseudo_likelihood(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every document's score under the model of all of them."""
    model, kept = _learn(docs, settings)
    return _score_kept(kept, model.network)
