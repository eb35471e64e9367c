"""Identities and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(c: Column) -> Column:
    """``sha256:`` and the hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """``prefix_`` and the first digits of the SHA-256 of the parts joined by the unit separator; null if a part is."""
    joined = F.concat(*[x for p in parts for x in (F.lit("\x1f"), p.cast("string"))][1:])
    return F.concat(F.lit(prefix + "_"), F.left(F.sha2(joined.cast("binary"), 256), F.lit(length)))


def key128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes of a value: an equality key of fixed width."""
    return [F.xxhash64(c), F.xxhash64(F.lit(0x5EED), c)]
