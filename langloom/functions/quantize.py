"""Integer encodings of probabilities, with 32-bit float steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1.1754943508222875e-38


def _float(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def ratio(a: Column, b: Column) -> Column:
    """A 32-bit division: that of 64 bits, rounded."""
    return (_float(a).cast("double") / _float(b).cast("double")).cast("float")


def logprob(p: Column) -> Column:
    """round(ln(p) * 4096) in the range of 16 bits, halves away from zero."""
    ln = F.ln(F.greatest(_float(p), _float(TINY)).cast("double")).cast("float")
    return F.greatest(F.least(F.round(ln.cast("double") * 4096), F.lit(32767.0)), F.lit(-32768.0)).cast("int")


def from_logprob(q: Column) -> Column:
    return q / F.lit(4096.0)


def idf(x: Column) -> Column:
    return F.round(F.greatest(F.least(_float(x), _float(63.0)), _float(0.0)).cast("double") * 1024).cast("int")


def from_idf(q: Column) -> Column:
    return q / F.lit(1024.0)


def probability(p: Column) -> Column:
    scaled = F.greatest(F.least(_float(p), _float(1.0)), _float(0.0)) * _float(65535.0)
    return F.round(scaled.cast("double")).cast("int")


def smoothed(count: Column, total: Column, top: float = 0.5, bottom: float = 0.5) -> Column:
    """(count + top) / (total + bottom) in 32-bit steps."""
    return ratio(_float(count) + _float(top), _float(total) + _float(bottom))


def mean(total: Column, n: Column) -> Column:
    """total / (4096 n), 0 for none."""
    return F.when(n == 0, F.lit(0.0)).otherwise(total / (F.lit(4096.0) * n))
