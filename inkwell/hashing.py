"""Seeded choice by SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.textfn import let


def nul_joined(*parts: Column) -> Column:
    """The parts as strings, joined by NUL."""
    return F.concat_ws("\0", *[p.cast("string") for p in parts])


def sha_key(*parts: Column) -> Column:
    """SHA-256 hex of the NUL-joined parts: a stable order key."""
    return F.sha2(nul_joined(*parts), 256)


def sha_modulo(modulus: int | Column, *parts: Column) -> Column:
    """The SHA-256 of the NUL-joined parts as a 256-bit integer, modulo ``modulus`` (under 2**31)."""
    step = (F.lit(1 << 32) if isinstance(modulus, Column) else 1 << 32) % modulus

    def fold(digest: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
        return F.aggregate(chunks, F.lit(0).cast("long"), lambda acc, c: (acc * step + c) % modulus)

    return let(sha_key(*parts), fold)


def pick(pool: list, *parts: Column) -> Column:
    """One of ``pool`` by the seeded hash of the parts."""
    return F.element_at(F.array(*map(F.lit, pool)), (sha_modulo(len(pool), *parts) + 1).cast("int"))


def weighted_pick(pool: list[tuple], *parts: Column) -> Column:
    """As ``pick`` where each (value, weight) stands in the pool ``weight`` times."""
    return pick([v for v, w in pool for _ in range(w)], *parts)
