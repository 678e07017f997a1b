"""Search in class texts and in string literals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings
from .paging import first, int_arg

INDEX, SUBSTRING, SCAN, NONE = "index", "substring", "scan", "none"
LINES_A_CLASS, SNIPPET = 3, 240
#: Folders of stored postings, and the trigrams of a term that choose the texts to read.
BUCKETS, RAREST = 64, 3
_REGEX_SIGNS = re.compile(r"[\\^$.|?*+()\[\]{}]")


def looks_like_regex(term: str) -> bool:
    """Whether the term, on one line, has a sign with a meaning in patterns."""
    return "\n" not in term and _REGEX_SIGNS.search(term) is not None


def engine_for(term: str, regex: bool) -> str:
    """A term of three characters (not code units) or more without signs goes by the index, else lines are scanned."""
    if not term:
        return NONE
    return INDEX if not regex and len(term) >= 3 and not looks_like_regex(term) else SCAN


def search_bodies(bodies: DataFrame, term: str) -> DataFrame:
    """One row for each class whose text holds the term, case aside and line feeds included."""
    found = bodies.where(strings.contains_folded(F.col("body"), term))
    return found.select(F.coalesce("fqn", F.concat(F.lit("#"), F.col("cls_idx"))).alias("class"), "cls_idx")


def scan_lines(bodies: DataFrame, pattern: str, regex: bool) -> DataFrame:
    """The first lines of each class that hold the pattern, case and all, cut to a snippet; equal ones of a class once.

    A pattern that can't be compiled is an error. Its language is Java's.
    """
    if regex:
        bodies.sparkSession.sql("SELECT '' RLIKE :p", args={"p": pattern}).collect()
    lines = bodies.select("cls_idx", "fqn", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    hits = lines.where(F.rlike("line", F.lit(pattern)) if regex else F.contains("line", F.lit(pattern)))
    rank = F.row_number().over(Window.partitionBy("cls_idx").orderBy("line_no"))
    hits = hits.withColumn("r", rank).where(F.col("r") <= LINES_A_CLASS)
    hits = hits.withColumn("text", strings.trim_controls(F.col("line"))).groupBy("cls_idx", "fqn", "text").agg(F.min("line_no").alias("line_no"))
    cut = F.when(F.length("text") > SNIPPET, F.concat(F.substring("text", 1, SNIPPET), F.lit("…"))).otherwise(F.col("text"))
    return hits.select(F.coalesce("fqn", F.concat(F.lit("#"), F.col("cls_idx"))).alias("class"), "cls_idx", "line_no", cut.alias("snippet"))


def search_code(bodies: DataFrame, term: str, regex: bool = False, limit: object = 100, index: DataFrame | None = None) -> DataFrame:
    """engine, class, cls_idx and (from a scan) snippet, in class order.

    With stored postings, the engine of a plain term is the index, which names the texts to read; without, all texts are read.
    """
    engine = engine_for(term, regex)
    if engine == INDEX and index is None:
        engine = SUBSTRING
    if engine == NONE:
        rows = bodies.select(F.col("fqn").alias("class"), "cls_idx", F.lit(0).alias("line_no"), F.lit("").alias("snippet")).where(F.lit(False))
    elif engine in (INDEX, SUBSTRING):
        hits = search_bodies(bodies, term) if index is None else search_by_index(bodies, index, term)
        rows = hits.withColumns({"line_no": F.lit(0), "snippet": F.lit(None).cast("string")})
    else:
        rows = scan_lines(bodies, term, regex)
    rows = first(rows, limit, "cls_idx", "line_no", default=100, most=1000)
    return rows.select(F.lit(engine).alias("engine"), "class", "cls_idx", "snippet")


def postings(bodies: DataFrame) -> DataFrame:
    """The inverted index: a row for each trigram of each class' lower-cased text."""
    return bodies.select(F.explode(strings.trigrams(F.col("body"))).alias("gram"), "cls_idx")


def gram_bucket(gram: Column) -> Column:
    """The folder of stored postings that a trigram is in."""
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(term: str) -> list[str]:
    low = term.lower()
    return sorted({low[k : k + 3] for k in range(len(low) - 2)})


def _of_grams(index: DataFrame, grams: list[str]) -> DataFrame:
    """The postings of some trigrams; stored ones are read from those trigrams' folders only."""
    if "bucket" in index.columns:
        rows = index.sparkSession.createDataFrame([(g,) for g in grams], "gram string").select(gram_bucket(F.col("gram")).alias("b")).distinct().collect()
        index = index.where(F.col("bucket").isin([r.b for r in rows]))
    return index.where(F.col("gram").isin(grams))


def candidates(index: DataFrame, term: str) -> DataFrame:
    """The classes that have all of the term's trigrams. Those that hold the term are among them."""
    grams = _grams(term)
    if not grams:
        return index.select("cls_idx").distinct()
    hits = _of_grams(index, grams).groupBy("cls_idx").agg(F.count_distinct("gram").alias("n"))
    return hits.where(F.col("n") == len(grams)).select("cls_idx")


def search_by_index(bodies: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """As ``search_bodies``, reading only texts that have the term's RAREST trigrams of fewest postings."""
    grams = _grams(term)
    if "bucket" in index.columns and len(grams) > RAREST:
        counts = {r.gram: r.n for r in _of_grams(index, grams).groupBy("gram").agg(F.count("*").alias("n")).collect()}  # a row for each of the term's
        grams = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    if not grams:
        return search_bodies(bodies, term)
    hits = _of_grams(index, grams).groupBy("cls_idx").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    return search_bodies(bodies.join(hits.select("cls_idx"), "cls_idx", "left_semi"), term)


def const_strings(bodies: DataFrame) -> DataFrame:
    """Distinct string literals of each class' text."""
    return bodies.select(F.explode(strings.literals(F.col("body"))).alias("str"), "cls_idx")


def _with_class(found: DataFrame, classes: DataFrame) -> DataFrame:
    return found.join(classes.select("cls_idx", "fqn"), "cls_idx", "left")


def search_strings(literals: DataFrame, classes: DataFrame, term: str, limit: object = 200) -> DataFrame:
    """Literals that hold the term; terms of under three characters go by LIKE."""
    holds = strings.contains_folded(F.col("str"), term) if len(term) >= 3 else strings.like_contains(F.col("str"), term)
    rows = _with_class(literals.where(holds), classes).select(F.col("str").alias("string"), F.col("fqn").alias("class"), "cls_idx")
    return first(rows, limit, "cls_idx", "string").select("string", "class")


def string_usages(literals: DataFrame, classes: DataFrame, value: str, contains: bool = False, limit: object = 200) -> DataFrame:
    """Distinct classes and literals equal to the value, or LIKE it."""
    found = literals.where(strings.like_contains(F.col("str"), value) if contains else F.col("str") == value)
    rows = _with_class(found, classes).select(F.col("fqn").alias("class"), F.col("str").alias("string")).distinct()
    return first(rows, limit, "class", "string")


def capped_note(returned: int, limit: object, default: int = 100, most: int = 1000) -> str | None:
    """The note on a result that may have been cut; a result as long as the limit has it too."""
    return "capped at limit" if returned >= int_arg(limit, default, 1, most) else None
