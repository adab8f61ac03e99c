"""Hash buckets, seeds and fingerprints."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

TWO64 = "18446744073709551616"


def bucket(feature: Column, n: int) -> Column:
    """MD5 bucket in [0, n), the same in any SQL engine."""
    return F.pmod(F.conv(F.substring(F.md5(feature.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(n)).cast("int")


def trial_seed(content: Column, index: Column, version: str) -> Column:
    """The first 8 bytes, little-endian and unsigned, of SHA-256 of content, index and version, parted by NUL."""
    h = F.sha2(F.concat(content.cast("binary"), F.lit("\0").cast("binary"), index.cast("string").cast("binary"), F.lit("\0" + version).cast("binary")), 256)
    flipped = F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(8))])
    return F.conv(flipped, 16, 10).cast("decimal(20,0)")


def sniff_seed(seed: Column, n: Column) -> Column:
    """Wrap-around sum in 64 unsigned bits."""
    return F.expr(f"cast((cast({_sql(seed)} as decimal(38,0)) + {_sql(n)}) % {TWO64} as decimal(20,0))") if isinstance(seed, str) else ((seed.cast("decimal(38,0)") + n.cast("decimal(38,0)")) % F.lit(TWO64).cast("decimal(38,0)")).cast("decimal(20,0)")


def salted_seed(seed: Column, salt: int, tag: bytes = b"salt") -> Column:
    """Another stream for the same seed: xor with the first 8 bytes, little-endian, of SHA-256 of salt and tag; salt 0 changes nothing."""
    if salt == 0:
        return seed
    mask = int.from_bytes(hashlib.sha256(salt.to_bytes(8, "little", signed=True) + tag).digest()[:8], "little", signed=True)
    bits = F.conv(seed.cast("string"), 10, -10).cast("bigint").bitwiseXOR(F.lit(mask).cast("bigint"))
    return F.conv(F.hex(bits), 16, 10).cast("decimal(20,0)")


def argument_index(candidate: Column, argument: Column) -> Column:
    """A number for an argument of a candidate, apart from those of candidates."""
    return F.lit(1_000_000).cast("bigint") + candidate * 1000 + argument


def _sql(x) -> str:
    return str(x)


def fingerprint(*columns: Column) -> Column:
    """SHA-256 of columns in a fixed order, null apart from empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)


@F.pandas_udf(IntegerType())
def blake_bucket(feature: pd.Series, n: pd.Series, salt: pd.Series, k: pd.Series) -> pd.Series:
    """Salted BLAKE2b, 8 bytes, little-endian, mod n; further hashes of a feature are marked by k."""
    out = []
    for f, size, s, i in zip(feature, n, salt, k, strict=True):
        raw = f if not i else f"{f}\x1e{i}"
        out.append(int.from_bytes(hashlib.blake2b(raw.encode(), digest_size=8, salt=s.encode()[:16]).digest(), "little") % size)
    return pd.Series(out, dtype="int32")
