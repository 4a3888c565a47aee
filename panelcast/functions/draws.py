"""Portable, partition-independent pseudo-random draws.

``F.rand`` depends on the partition layout, so a lost and recomputed task or a
different partition count would change the result. Instead a draw is a pure
function of its keys: the first 8 hex digits of ``md5('k1|k2|...|seed')`` read as
an unsigned 32-bit integer and divided by 2^32. The same expression in SQL
(DuckDB: ``('0x'||substr(md5(concat_ws('|', ...)),1,8))::bigint``) gives the
same numbers, so stochastic operators keep a full oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys) -> Column:
    """U[0,1) from the key columns (last key is usually the seed literal)."""
    cols = [k if isinstance(k, Column) else F.lit(k) for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8)
    return F.conv(h, 16, 10).cast("bigint").cast("double") / F.lit(4294967296.0)


def draw_index(n: Column, *keys) -> Column:
    """Row index in 1..n drawn uniformly with replacement: ``floor(u n) + 1``."""
    return (F.floor(uniform(*keys) * n) + F.lit(1)).cast("int")


def noise_factor(*keys, spread: float = 0.1) -> Column:
    """Multiplicative noise ``1 + spread (2u - 1)``, i.e. U(1-spread, 1+spread)."""
    return F.lit(1.0) + F.lit(spread) * (F.lit(2.0) * uniform(*keys) - F.lit(1.0))
