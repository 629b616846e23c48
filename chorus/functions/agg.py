"""Aggregate helpers whose results do not depend on partitioning.

A double ``avg`` depends on the order of partial sums, so the same query can differ in the last
bits between runs with a different partition count. These helpers sum exact decimals instead, so
the result is the same whatever the plan (and equal to any other engine doing the same).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(18,9)"
DEC_SQ = "decimal(38,18)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def exact_avg(x) -> Column:
    """Mean of the non-null values, order-independent."""
    return F.sum(_c(x).cast(DEC)).cast("double") / F.count(_c(x))


def exact_std(x) -> Column:
    """Sample standard deviation, 0 when fewer than two values."""
    d = _c(x).cast(DEC)
    n = F.count(_c(x))
    s = F.sum(d).cast("double")
    ss = F.sum(d * d).cast("double")
    var = (ss - s * s / n) / (n - 1)
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))


def share(count_col, total_col) -> Column:
    return _c(count_col).cast("double") / _c(total_col)


def first_seen_key(seq, pos) -> Column:
    """Order key of (seq, position) as one exact decimal: ``min`` of it keeps the aggregate a
    hash aggregate (a ``min`` over a struct would force a sort of every row first)."""
    return (_c(seq).cast("decimal(38,0)") * F.lit(10 ** 10).cast("decimal(38,0)") + _c(pos)).cast("decimal(38,0)")
