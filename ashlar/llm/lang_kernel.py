"""Language identification by a string kernel.

The kernel of two texts is the number of distinct n-grams (n from 1 to 4, over
folded characters) that both hold, divided by the root of the product of their
own numbers: the blended-spectrum presence kernel. Nyström landmarks, some
labelled texts of each language, span the feature space; one-versus-rest kernel
ridge regression is fitted in it. To predict, a batch of texts becomes a matrix
of n-gram presence, whose product with the landmarks' presence gives the kernel
and, times the fitted weights, the languages' values.

n-grams are counted by a hash into ``SPACE`` places, for landmarks and texts
alike. Letters are lower-cased, runs of anything else become one space, and only
letters and such spaces form n-grams, so digits, symbols and case don't matter.

One-versus-rest values sum to 2 minus the number of languages for any text, so
the best of them can't tell a text in none of the languages. That is told by
familiarity: the share of the text's trigrams that the sample has, plus one over
the root of their number, as few trigrams tell little. The least familiarity to
pass is learned from texts that are left out: between what the texts of one half
of the sample have by the other half and what they have with their letters
shuffled. Words of letters and digits, such as keys, are in no language and don't
count there, unless a text has nothing else. With ``reject``, texts below it are ``und``.

The fit reads a bounded sample of ``Sample.texts`` whole texts, of which the driver
gets places of n-grams only; prediction reads every whole text. As the kernel is
linear in a text's presence, landmarks and weights are multiplied once, in the fit.

Defined cases: a text that is null or without a letter is ``und`` with score 0;
with no labelled text, every text is ``und`` with score 0; with one label, it is
every other text's; labels that are null teach nothing; repeated rows stay; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .scratch import quoted, tune

SPACE = 1 << 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Texts whose presence forms one matrix.
MATRIX_ROWS = 48
#: Places of trigrams, for familiarity.
TRIGRAMS = 1 << 22


@dataclass(frozen=True)
class Sample:
    """Bounds of what the fit reads."""

    texts: int = 600
    landmarks: int = 96
    ridge: float = 1e-2


def _folding() -> np.ndarray:
    """A table from each code point of the basic plane to itself lower-cased if a letter, or to 32."""
    out = np.full(0x10000, 32, dtype=np.uint32)
    for c in range(0x10000):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_FOLD: list[np.ndarray] = []


def letters(text: str | None) -> np.ndarray:
    """Code points of the text's letters, each run of others one 32, with a 32 at either end; empty without letters."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    if not _FOLD:
        _FOLD.append(_folding())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    high = points >= 0x10000
    folded = _FOLD[0][np.where(high, 0, points)] if high.any() else _FOLD[0][points]
    if high.any():
        folded = np.where(high & np.fromiter((chr(p).isalpha() for p in points), bool, len(points)), points, folded)
    folded = np.concatenate(([32], folded, [32])).astype(np.uint32)
    keep = np.ones(len(folded), dtype=bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32)
    folded = folded[keep]
    return folded if len(folded) > 1 else folded[:0]


def presence(text: str | None, row: np.ndarray) -> bool:
    """Set the places of the text's n-grams in ``row``; False if it has no letter."""
    points = letters(text)
    if not len(points):
        return False
    value = np.zeros(len(points), dtype=np.uint32)
    for n in ORDERS:
        if len(points) < n:
            break
        value = value[: len(points) - n + 1] * np.uint32(0x9E3779B1) + points[n - 1 :] * np.uint32(0x85EBCA6B)
        mixed = value ^ (value >> np.uint32(15))
        row[(mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - SPACE.bit_length() + 1)] = 1
    return True


def matrix(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Presence of each text, divided by the root of its n-grams' number; which texts have letters."""
    rows = np.zeros((len(texts), SPACE), dtype=np.uint8)
    known = np.array([presence(t, row) for t, row in zip(texts, rows, strict=True)], dtype=bool)
    return normed(rows), known


def normed(rows: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.maximum(rows.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
    out = rows.astype(np.float32)
    out /= norms[:, None]
    return out


#: A run of letters and digits with a digit in it. Attempts start where a run does, so long runs are read once.
_CODE = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z_]*[0-9][A-Za-z0-9_]*")


def prose(text: str | None) -> str | None:
    """The text with a space for each of its codes, or as it is if no letter were left."""
    if not text:
        return text
    rest = _CODE.sub(" ", text)
    return rest if any(map(str.isalpha, rest)) else text


def trigrams(text: str | None) -> np.ndarray:
    """The place of each trigram of the text."""
    points = letters(text)
    if len(points) < 3:
        return np.zeros(0, dtype=np.uint32)
    value = (points[:-2] * np.uint32(0x9E3779B1) + points[1:-1]) * np.uint32(0x85EBCA6B) + points[2:]
    mixed = value ^ (value >> np.uint32(15))
    return (mixed * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - TRIGRAMS.bit_length() + 1)


def counted(places: np.ndarray) -> np.ndarray:
    """The distinct places and how often each occurs, as two rows."""
    return np.stack(np.unique(places, return_counts=True)).astype(np.uint32)


def familiarity(grams: np.ndarray, seen: np.ndarray) -> float:
    """The share of a text's trigrams that is known, and one over the root of their number."""
    n = int(grams[1].sum())
    return float(grams[1][seen[grams[0]]].sum() / n + n**-0.5) if n else 0.0


def shuffled(text: str) -> str:
    """The text's letters in another order, its spaces where they were; the same for the same text."""
    points = letters(text)
    at = np.flatnonzero(points != 32)
    points[at] = np.random.default_rng(zlib.crc32(points.tobytes())).permutation(points[at])
    return points.tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class Taught:
    """What the fit needs of a text with letters."""

    lang: str
    presence: np.ndarray  # one byte a place
    trigrams: np.ndarray  # with their counts
    shuffled: np.ndarray  # those of its letters shuffled

    @classmethod
    def of(cls, text: str, lang: str) -> Taught | None:
        row = np.zeros(SPACE, dtype=np.uint8)
        own = prose(text)
        return cls(lang, row, counted(trigrams(own)), counted(trigrams(shuffled(own)))) if presence(text, row) else None


def seen_in(places: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(TRIGRAMS, dtype=bool)
    for some in places:
        out[some] = True
    return out


def least_familiarity(taught: list[Taught]) -> float:
    """A bound between the texts' familiarity by others and that of their shuffled letters; 0 if no text is left out."""
    turns: dict[str, int] = {}
    halves: tuple[list[Taught], list[Taught]] = [], []
    for t in taught:  # every other text of each language
        turns[t.lang] = turns.get(t.lang, -1) + 1
        halves[turns[t.lang] % 2].append(t)
    clean, none = [], []
    for own, other in (halves, halves[::-1]):
        seen = seen_in([t.trigrams[0] for t in other])
        for t in own if other else ():
            clean.append(familiarity(t.trigrams, seen))
            none.append(familiarity(t.shuffled, seen))
    if not clean:
        return 0.0
    low, high = float(np.quantile(clean, 0.01)), float(np.quantile(none, 0.99))
    return min(low, (low + high) / 2)


@dataclass(frozen=True)
class Model:
    labels: list[str]
    weights: np.ndarray  # SPACE x labels: the landmarks' presence times their weights
    bias: np.ndarray
    seen: np.ndarray  # trigrams of the sample
    least: float  # familiarity of texts in one of the languages

    def foreign(self, text: str | None) -> bool:
        """Whether the text is in none of the languages."""
        return familiarity(counted(trigrams(prose(text))), self.seen) < self.least

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.labels or not texts:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        x, known = matrix(texts)
        values = x @ self.weights + self.bias
        best = values.argmax(axis=1)
        top = values[np.arange(len(texts)), best]
        score = np.clip((top + 1) / 2, 0, 1)  # a value of 1 is the target of a right label, -1 of a wrong one
        return [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0).astype(float).tolist()


def fit(taught: list[Taught], landmarks: int, ridge: float) -> Model:
    labels = sorted({t.lang for t in taught})
    if not labels:
        return Model([], np.zeros((SPACE, 0), np.float32), np.zeros(0, np.float32), seen_in([]), 0.0)
    x = np.stack([t.presence for t in taught])
    langs = np.array([t.lang for t in taught])
    by = [np.flatnonzero(langs == label).tolist() for label in labels]
    chosen = [places[turn] for turn in range(max(map(len, by))) for places in by if turn < len(places)]  # in turn from each language
    marks = normed(x[chosen[:landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])  # Nyström: K_mm to the power -1/2
    z = np.concatenate([normed(x[k : k + MATRIX_ROWS]) @ marks.T for k in range(0, len(x), MATRIX_ROWS)]).astype(np.float64) @ whiten
    y = np.where(langs[:, None] == np.array(labels), 1.0, -1.0)
    weight = np.ones(len(langs))
    for places in by:  # each language weighs the same
        weight[places] = len(langs) / len(labels) / len(places)
    mean_z, mean_y = np.average(z, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    zc, yc = z - mean_z, y - mean_y
    w = np.linalg.solve(zc.T @ (zc * weight[:, None]) + ridge * len(langs) * np.eye(zc.shape[1]), zc.T @ (yc * weight[:, None]))
    return Model(labels, marks.T @ (whiten @ w).astype(np.float32), (mean_y - mean_z @ w).astype(np.float32), seen_in([t.trigrams[0] for t in taught]), least_familiarity(taught))


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal digits, modulo 3; fold 1 is held out."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3


_TAUGHT = "lang string, ord long, id long, presence binary, trigrams binary, shuffled binary"


def _taught(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for lang, order, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if t := Taught.of(text, lang):
                rows.append((lang, order, i, np.packbits(t.presence).tobytes(), t.trigrams.tobytes(), t.shuffled.tobytes()))
        kinds = (pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * 3)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[c.split()[0] for c in _TAUGHT.split(", ")])


def learn(docs: DataFrame, sample: Sample = Sample()) -> Model:
    """Fit on a sample, the same for the same rows, of labelled texts that aren't held out.

    The sample takes texts by hash in turn from each language, so that all give
    their first before any gives its second, and a language with few gives all
    it can. It is chosen by numbers; only then are the chosen whole texts read.
    """
    tune(docs.sparkSession)
    labelled = docs.select(F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    taught = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("id")), F.lit(0)) != 1))
    taught = taught.select("lang", F.xxhash64("id", "text").alias("ord"), "id", "text")
    # Buckets of each language's texts by hash; one text of each is kept, so no task holds more than the sample's bound a language.
    bucket = F.pmod(F.xxhash64("ord", "lang"), F.lit(sample.texts))
    one = taught.groupBy("lang", bucket.alias("bucket")).agg(F.min("ord").alias("ord"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("bucket"))  # at most the bound's rows a language
    chosen = one.withColumn("turn", turn).orderBy("turn", "lang").limit(sample.texts).select("lang", "ord").collect()
    if not chosen:
        return fit([], sample.landmarks, sample.ridge)
    wanted = docs.sparkSession.createDataFrame([(r.lang, r.ord) for r in chosen], "lang string, ord long")
    rows = taught.join(F.broadcast(wanted), ["lang", "ord"], "left_semi").dropDuplicates(["lang", "ord"]).select("lang", "ord", "id", "text")
    found = {(r.lang, r.ord): r for r in rows.mapInArrow(_taught, _TAUGHT).collect()}
    places = lambda data: np.frombuffer(data, dtype=np.uint32).reshape(2, -1)
    use = [found[r.lang, r.ord] for r in chosen if (r.lang, r.ord) in found]
    return fit([Taught(r.lang, np.unpackbits(np.frombuffer(r.presence, np.uint8)), places(r.trigrams), places(r.shuffled)) for r in use], sample.landmarks, sample.ridge)


def _predicted(rows: DataFrame, model: Model, carried: int, reject: bool) -> DataFrame:
    """The first ``carried`` columns, as c0, c1, ..., and ``lang_pred`` and ``score`` of the column after them, the text."""
    spark = rows.sparkSession
    tune(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded by SPACE, the languages and TRIGRAMS
    names = [f"c{k}" for k in range(carried)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, MATRIX_ROWS):
                part = batch.slice(at, MATRIX_ROWS)
                texts = part.column(carried).to_pylist()
                langs, scores = shared.value.predict(texts)
                if reject:
                    kept = [not shared.value.foreign(t) for t in texts]
                    langs, scores = [x if k else UNKNOWN for x, k in zip(langs, kept, strict=True)], [x * k for x, k in zip(scores, kept, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:carried], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = StructType([StructField(name, f.dataType) for name, f in zip(names, rows.schema.fields, strict=False)])
    schema = schema.add("lang_pred", StringType()).add("score", DoubleType())
    return rows.toDF(*names, "text").mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, *, reject: bool = False) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; with ``reject``, a text in none of the languages is ``und`` with score 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _predicted(rows, model, 1, reject).withColumnRenamed("c0", "doc_id")


def in_known_languages(docs: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns as they are, whose text has letters and is in one of the model's languages."""
    rows = docs.select(*map(quoted, docs.columns), F.col("text").cast("string").alias("__text"))
    found = _predicted(rows, model, len(docs.columns), True).where(F.col("lang_pred") != UNKNOWN)
    return found.drop("lang_pred", "score").toDF(*docs.columns)


def held_out_crc(doc_id: int) -> bool:
    """The same fold in Python."""
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def identify(docs: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    out = predict(docs, learn(docs, sample))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
