"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is its words, split at white space. Of each run of K words, the minimal
word by hash is found; the run is a closed syncmer, and its hash an anchor, if
that word is the run's first or last. Whether a run is chosen depends on the run
alone, so an edit moves no anchors beyond its own K words. The fingerprint has
all anchors of the text, however many, in text order, as sixteen hex digits each.

Two fingerprints are matched by position: of the distinct anchors that both have, in
the order of their first ones, those count that follow the same shared anchor in both,
and one more. The likeness is their share of the distinct anchors of both together.
A passage that was moved, put in or taken out so breaks the order at its ends alone.

Defined cases: a text of fewer than K words has one anchor, the hash of all its
words; without words (or null, which is the empty text) the fingerprint is the
empty string; two empty fingerprints have likeness 1, an empty and another 0.
Rows with equal doc_ids are ordered by the hash of their text, those with a null
doc_id come first; after the last document comes the first, and a sole document
is its own next. An empty table gives no rows; other columns are ignored.
doc_id is taken to be a key: rows of one id stand in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

K = 3
#: Intervals of doc_id with about equally many rows; each is cut evenly into buckets.
INTERVALS = 128
#: Buckets of neighbouring documents to a shuffle partition, and bytes of text of a partition.
BUCKETS_A_PARTITION, PARTITION_BYTES = 8, 32 << 20


def anchors(words: Column) -> Column:
    """The anchors of an array of words' hashes, in text order."""
    n = F.size(words)
    some = F.greatest(n - (K - 1), F.lit(0))
    shift = lambda i: F.slice(words, F.lit(i + 1), some)
    ends = F.zip_with(shift(0), shift(2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    runs = F.zip_with(ends, shift(1), lambda e, m: F.when(F.least(e["a"], e["b"]) <= m, F.xxhash64(e["a"], m, e["b"])))
    short = F.when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))
    return F.when(n >= K, F.array_compact(runs)).otherwise(short)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the fingerprint of a text column that isn't null, as an array of long."""
    df = df.withColumn("__words", F.transform(F.array_remove(F.split(F.col(text), r"\s+"), ""), lambda w: F.xxhash64(w)))
    return df.withColumn(out, anchors(F.col("__words"))).drop("__words")


def as_text(prints: Column) -> Column:
    return F.array_join(F.transform(prints, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with the likeness, from 0 to 1, of two columns of fingerprints."""
    df = df.withColumns({"__both": F.size(F.array_union(a, b)), "__a": F.array_intersect(a, b), "__b": F.array_intersect(b, a)})

    def follow(shared: str) -> Column:
        """Each shared anchor, distinct and in the order of its first, with the one before it."""
        rest = F.greatest(F.size(shared) - 1, F.lit(0))
        return F.zip_with(F.slice(shared, F.lit(1), rest), F.slice(shared, F.lit(2), rest), lambda x, y: F.xxhash64(x, y))

    same = F.size(F.array_intersect(follow("__a"), follow("__b"))) + F.when(F.size("__a") > 0, 1).otherwise(0)
    return df.withColumn(out, F.when(F.col("__both") == 0, 1.0).otherwise(same / F.col("__both"))).drop("__both", "__a", "__b")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its text whose second half is the next document's beginning.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. Each text is shuffled once, into buckets of
    neighbouring doc_ids; each bucket also gets the document that follows it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "syncmers")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.select(F.percentile_approx("doc_id", [i / INTERVALS for i in range(INTERVALS + 1)]).alias("bounds"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bounds = sorted(set(size.bounds or [0]))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // PARTITION_BYTES)  # as many as the texts need
    parts = -(-BUCKETS_A_PARTITION * tasks // INTERVALS)
    least, most = F.lit(bounds[0]), bounds[-1]
    step = F.array(*[F.lit(x) for x in bounds])
    place = F.size(F.filter(step, lambda x: x <= F.col("doc_id")))  # of the interval, from 1; 0 for a null
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("__place", F.when(F.col("doc_id").isNull(), 0).otherwise(F.greatest(place, F.lit(1))))
    low, high = F.coalesce(F.get(step, F.col("__place") - 1), least), F.coalesce(F.get(step, F.col("__place")), F.lit(most + 1))
    inside = F.least(F.lit(parts - 1), F.floor((F.col("doc_id") - low) * parts / F.greatest(high - low, F.lit(1)))).cast("long")
    rows = rows.withColumn("bucket", F.coalesce(F.col("__place") * parts + F.greatest(inside, F.lit(0).cast("long")), F.lit(-1).cast("long"))).drop("__place")

    firsts = rows.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h")).alias("first"))
    ring = Window.orderBy("bucket")  # a row for each bucket, without texts
    before = F.coalesce(F.lag("bucket").over(ring), F.max("bucket").over(Window.partitionBy()))
    ghosts = scratch.keep(firsts.select(before.alias("bucket"), "first.doc_id", "first.h"), "ghosts")
    follow = rows.drop("bucket").join(F.broadcast(ghosts) if parts * INTERVALS <= 1 << 17 else ghosts, (rows.doc_id.eqNullSafe(ghosts.doc_id)) & (rows.h == ghosts.h), "inner")
    follow = follow.select(rows.doc_id, rows.text, rows.h, ghosts.bucket).dropDuplicates(["bucket"])
    every = rows.select("doc_id", "text", "h", "bucket", F.lit(0).alias("ghost")).unionByName(follow.withColumn("ghost", F.lit(1)))

    every = with_fingerprint(every.repartition(tasks, "bucket"), "text", "print")  # anchors aren't shuffled, but made where texts arrive
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").asc_nulls_first(), "h")
    every = every.select("doc_id", "ghost", "text", "print", F.lead("text").over(order).alias("next"), F.lead("print").over(order).alias("next_print")).where("ghost = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), F.expr("left(next, cast(floor(length(text) / 2) as int))"))
    every = every.select("doc_id", n.cast("long").alias("n_chars"), F.when(half > 0, edited).otherwise(F.col("text")).alias("edited"), "print", "next_print")
    every = with_fingerprint(every.withColumn("edited_sha256", F.sha2(F.col("edited"), 256)), "edited", "edited_print").drop("edited")
    every = likeness(likeness(every, "print", "edited_print", "near_edited"), "print", "next_print", "near_next")
    return every.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("print")).alias("fingerprint"), as_text(F.col("edited_print")).alias("edited_fingerprint"), "near_edited", "near_next")
