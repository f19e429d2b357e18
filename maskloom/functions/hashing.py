"""Seeded, partition-independent randomness.

Every random choice is an md5 of stable keys (salt, seed, row id, ...), so a
row gets the same draw on any partitioning, after any retry, and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hkey(*parts) -> Column:
    """md5 hex of ``'|'``-joined parts (literals or columns)."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hunit(*parts) -> Column:
    """Uniform double in [0, 1) from the first 8 hex digits of ``hkey``."""
    return F.conv(F.substring(hkey(*parts), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def seed_salt(epoch: int, rand_seed: int) -> int:
    """The per-epoch seed schedule ``epoch + 100 * rand_seed``."""
    return int(epoch) + 100 * int(rand_seed)
