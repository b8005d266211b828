"""Hashes that any SQL engine can follow: md5 as a big-endian number, modulo a Mersenne number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _half(text: Column, first: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), first, 16), 16, 10).cast("decimal(20,0)")


def hash64(text: Column) -> Column:
    """md5 mod 2^63 - 1. As 2^64 is 2 to that modulus, the upper half counts twice."""
    return ((_half(text, 1) * 2 + _half(text, 17)) % F.lit(2**63 - 1).cast("decimal(20,0)")).cast("long")


def hash32(text: Column) -> Column:
    """md5 mod 2^31 - 1, to which 2^64 is 4."""
    m = F.lit(2**31 - 1).cast("decimal(20,0)")
    return ((_half(text, 1) % m * 4 + _half(text, 17) % m) % m).cast("long")


def hash_bucket(text: Column, n: int) -> Column:
    return hash64(text) % n


def sample_by_hash(key: Column, rate: float, seed: str = "") -> Column:
    """A Bernoulli filter which picks the same rows in every run."""
    return hash32(F.concat(key.cast("string"), F.lit(seed))) < int((2**31 - 1) * rate)
