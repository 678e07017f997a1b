"""Column functions that keep to the engine's string rules."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A quoted literal: escapes stay as written, a raw line feed ends the search for its end. Possessive, so that no input is too long.
LITERAL = r'"((?:[^"\\\n]|\\[\s\S])*+)"'
#: All runs of three characters, overlapping.
TRIGRAM = r"(?s)(?=(.{3}))"
STRING_RESOURCE = r'(?s)<string[^>]*name="([^"]+)"[^>]*>(.*?)</string>'
#: What a trim of all characters up to the space takes away.
EDGES = r"^[\x00-\x20]+|[\x00-\x20]+$"


def ascii_fold(text: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def like_contains(text: Column, value: str) -> Column:
    """LIKE '%value%', case aside in ASCII; % and _ in the value are wildcards, a backslash is itself."""
    pattern = value.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)).replace("\\", "\\\\")
    return ascii_fold(text).like(f"%{pattern}%")


def contains_folded(text: Column, value: str) -> Column:
    """Whether the lower-cased text holds the lower-cased value, line feeds included."""
    return F.contains(F.lower(text), F.lower(F.lit(value)))


def trim_controls(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def member_id(owner: Column, signature: Column) -> Column:
    """The structural key of a method or field; an unknown owner is ``?``."""
    return F.concat(F.coalesce(owner, F.lit("?")), F.lit("->"), F.coalesce(signature, F.lit("")))


def content_key(size: Column, content: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of size and content."""
    return F.substring(F.sha2(F.concat(size.cast("string"), content), 256), 1, 16)


def literals(body: Column, most: int = 4000, longest: int = 512) -> Column:
    """Distinct string literals in order of first appearance, none empty or longer than ``longest``."""
    found = F.regexp_extract_all(body, F.lit(LITERAL), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda s: F.length(s).between(1, longest))), 1, most)


def trigrams(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(body), F.lit(TRIGRAM), F.lit(1)))
