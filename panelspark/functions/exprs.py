"""Small expression builders shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

TWO_POW_32 = 4294967296.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def keyed_uniform(*parts) -> Column:
    """Uniform draw in [0, 1) that is a pure function of its key parts.

    Python strings are literal key parts; Columns are evaluated per row.

    ``md5('p1|p2|...')``; its first 8 hex digits read as an unsigned 32-bit integer / 2^32.
    The draw does not depend on partitioning or task order, so generated data and sampled
    orders repeat on any cluster and can be recomputed in plain SQL.
    """
    key = F.concat_ws("|", *[_col(p).cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") / F.lit(TWO_POW_32)


def normal_draw(u1: Column, u2: Column, mean, std) -> Column:
    """Box-Muller normal draw from two uniforms in [0, 1).  ``1 - u1`` keeps the log finite."""
    z = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    m = F.lit(float(mean)) if isinstance(mean, (int, float)) else _col(mean)
    s = F.lit(float(std)) if isinstance(std, (int, float)) else _col(std)
    return m + s * z


def clip(c, lo, hi) -> Column:
    return F.least(F.greatest(_col(c), F.lit(lo)), F.lit(hi))


def days_between(later, earlier) -> Column:
    """Whole days from ``earlier`` to ``later`` (timestamps or dates)."""
    return F.datediff(F.to_date(_col(later)), F.to_date(_col(earlier)))


def softplus(z) -> Column:
    """log(1 + e^z) without overflow."""
    z = _col(z)
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def round6(c) -> Column:
    """Round a double to 6 decimals: summation order differs between engines."""
    return F.round(_col(c), 6)
