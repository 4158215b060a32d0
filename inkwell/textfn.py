"""Column functions on text: words, script counts, stripping and n-grams.

Spark's ``\\w`` is ASCII and its ``trim`` removes spaces only; these follow Unicode instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
#: Kana, Han, compatibility Han and half-width kana.
CJK = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once.

    An expensive array that feeds a lambda and then an ``explode`` is otherwise copied into the
    lambda by filter pushdown and evaluated at every element.
    """
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    """Lower-cased word runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def units(text: Column, english: Column) -> Column:
    """What n-grams are made of: pieces between white space in English, else single characters."""
    pieces = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda x: x != "")
    return F.when(english, pieces).otherwise(F.filter(F.split(text, ""), lambda x: x != ""))


def strip(text: Column) -> Column:
    """Without leading and trailing white space, Unicode's included. Only a text that has some is searched for it,
    and a run of white space within it once, not from each of its places."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(F.rlike(ends, F.lit(r"(?U)\s")), F.regexp_replace(text, r"(?U)^\s+|\s(?<!\s\s)\s*$", "")).otherwise(text)


def ngrams(tokens: Column, n: int, whole_if_short: bool = False, hashed: bool = False) -> Column:
    """The distinct n-grams of an array of strings, joined by spaces; of fewer tokens none, or one
    of them all if ``whole_if_short`` (none of no tokens). ``hashed`` gives 64-bit hashes of the
    tokens' hashes: no string is built, and duplicates are found by a hash set, not by comparing
    all pairs."""
    of = F.xxhash64 if hashed else (lambda g: F.array_join(g, " "))
    none = F.array().cast("array<bigint>" if hashed else "array<string>")

    def body(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: of(F.slice(w, i, n)))
        short = F.array(of(w)) if whole_if_short else none
        return F.when(F.size(w) >= n, F.array_distinct(grams)).when(F.size(w) > 0, short).otherwise(none)

    return let(F.transform(tokens, lambda t: F.xxhash64(t)) if hashed else tokens, body)
